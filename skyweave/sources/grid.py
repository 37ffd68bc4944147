"""Observations: the long table of cells and times, and what describes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions import calendar as C
from skyweave.functions.stats import nan_to_null
from skyweave.sources import manifest as M

OBS = "dataset string, res string, variable string, time date, lat_i int, lon_i int, lat double, lon double, value double"

#: The grid that the shipped tables give rise to: south-west centre and step.
LAT0, LON0, STEP = -2.0, 30.0, 0.5


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily 5 by 5 grid ``(time, lat_i, lon_i, lat, lon, precip, tmin,
    tmax)`` derived from ``lineitem``; days without an item are absent."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = F.col("l_partkey")
    quantity = F.col("l_quantity")
    rows = items.groupBy(F.col("l_shipdate").cast("date").alias("time"), F.floor((part % 25) / 5.0).cast("int").alias("lat_i"), (part % 5).cast("int").alias("lon_i")).agg(
        (F.sum(quantity).cast("bigint") % 50).cast("double").alias("precip"), F.min(quantity).alias("tmin"), F.max(quantity).alias("tmax")
    )
    return rows.select("time", "lat_i", "lon_i", (LAT0 + STEP * F.col("lat_i")).alias("lat"), (LON0 + STEP * F.col("lon_i")).alias("lon"), "precip", "tmin", "tmax")


def read_obs(spark: SparkSession, path: str, dataset: str, res: str, variable: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One variable of a store that :func:`write_obs` keeps. The folder names
    prune by variable and year, the files by time."""
    df = spark.read.parquet(path).where((F.col("dataset") == dataset) & (F.col("res") == res) & (F.col("variable") == variable))
    if start:
        df = df.where((F.col("time") >= F.lit(start).cast("date")) & (F.col("year") >= int(start[:4])))
    if end:
        df = df.where((F.col("time") <= F.lit(end).cast("date")) & (F.col("year") <= int(end[:4])))
    return df


def field(spark: SparkSession, path: str, dataset: str, res: str, variable: str, time: str, box: tuple[float, float, float, float] | None = None) -> DataFrame | None:
    """One step of a variable, in the box (west, south, east, north) if there
    is one; none where the store has nothing for that step. Only the folder
    of its year is read."""
    found = stored_obs(spark, path)
    if found is None:
        return None
    found = read_obs(spark, path, dataset, res, variable, time, time)
    if found.isEmpty():
        return None
    return found if box is None else found.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))


def morton(i: Column, j: Column) -> Column:
    """A cell's place on a curve that keeps neighbours together: the bits of
    either index by turns."""

    def spread(x: Column) -> Column:
        x = x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    return spread(i).bitwiseOR(F.shiftleft(spread(j), 1))


def write_obs(obs: DataFrame, path: str, mode: str = "append", rows_a_file: int = 1 << 21) -> None:
    """Keep ``obs`` by dataset, resolution, variable and year. NaN becomes
    null.

    Within these, cells lie along the Morton curve and a cell's times follow
    each other; tasks take stretches of that order and files have
    ``rows_a_file`` rows at most, so there are as many as the rows need, and
    each is about a small part of the grid, which its statistics tell."""
    rows = obs.withColumn("value", nan_to_null(F.col("value"))).withColumns({"year": F.year("time"), "_z": morton(F.col("lat_i"), F.col("lon_i"))})
    key = ["dataset", "res", "variable", "year"]
    laid = rows.repartitionByRange(*key, "_z").sortWithinPartitions(*key, "_z", "time").drop("_z")
    laid.write.mode(mode).option("maxRecordsPerFile", rows_a_file).partitionBy(*key).parquet(path)


def unseen(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` a store does not have yet."""
    return incoming.join(stored.select(*keys).distinct(), keys, "left_anti")


def stored_obs(spark: SparkSession, path: str) -> DataFrame | None:
    """The store at ``path``; none if nothing is there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_unseen(incoming: DataFrame, path: str) -> None:
    """Append what is new to a store; the first call makes it. New is what the
    store has no row of for that time and cell: of a step that comes in two
    parts, both stay. What it has is told by its manifest, without a look at
    any row of it; an append that was cut short is made up for first. Rows
    without a time have no place and are left out."""
    M.append(incoming.where("time is not null"), path)


def grid_axis(obs: DataFrame) -> DataFrame:
    """``(axis, i, coord)`` of the grid's two axes, gathered in one aggregate
    that is as long as they are."""
    def ends(a: str) -> Column:
        return F.transform(F.collect_set(F.struct(F.col(f"{a}_i").alias("i"), F.col(a).alias("coord"))), lambda s: F.struct(F.lit(a).alias("axis"), s["i"].alias("i"), s["coord"].alias("coord")))

    return obs.agg(F.concat(ends("lat"), ends("lon")).alias("all")).select(F.inline("all"))


def info(obs: DataFrame, by: list[str], res: str = "daily") -> DataFrame:
    """For each of ``by`` the box (six decimals), the mean step of either axis,
    the times covered as labels, and how many there are."""
    # Sets as long as an axis: distinct counts would read each row three times.
    distinct = lambda k: F.size(F.collect_set(k)).cast("long")
    steps = lambda k: F.try_divide(F.max(k) - F.min(k), (distinct(k) - 1).cast("double"))
    box = [F.round(f(k), 6).alias(n) for f, k, n in ((F.min, "lon", "west"), (F.max, "lon", "east"), (F.min, "lat", "south"), (F.max, "lat", "north"))]
    out = obs.groupBy(*by).agg(*box, F.round(steps("lon"), 6).alias("step_lon"), F.round(steps("lat"), 6).alias("step_lat"), F.min("time").alias("_a"), F.max("time").alias("_b"), distinct("time").alias("n_times"))
    name = lambda d: C.label(F.col(d), res)
    return out.withColumns({"start": name("_a"), "end": name("_b")}).drop("_a", "_b")


def dated_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``(path, time)`` of a folder's files whose names fit a date pattern, in
    order of names; a row's content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern.replace("%Y", "*").replace("%m", "*").replace("%-d", "*").replace("%d", "*")).load(folder).select("path")
    found = files.withColumn("time", C.file_date(F.substring_index("path", "/", -1), pattern))
    return found.where("time is not null").orderBy("path")


def read_dated(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """Parquet files, one a step, with ``time`` from their names."""
    glob = pattern.replace("%Y", "*").replace("%m", "*").replace("%-d", "*").replace("%d", "*")
    df = spark.read.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return df.withColumn("time", C.file_date(F.col("_metadata.file_name"), pattern)).where("time is not null")


def tables(spark: SparkSession, config: dict) -> DataFrame:
    """``(dataset, res, variable, name, units, input, function, min_frac)`` of
    a configuration ``{dataset: {res: {variable: {...}}}}``."""
    keys = ("name", "units", "input", "function", "min_frac")
    rows = [(d, r, v, *(m.get(k) for k in keys)) for d, rs in config.items() for r, vs in rs.items() for v, m in vs.items()]
    return spark.createDataFrame(rows, "dataset string, res string, variable string, name string, units string, input string, function string, min_frac double")


def resolve(config: dict, dataset: str, res: str, variable: str) -> tuple[str, str, str | None]:
    """``(res, variable, function)`` of what to read for a request: the entry
    itself, or the one that its ``input``, ``res`` or ``res/variable``, names,
    with the function that makes one of the other; inputs of inputs too.
    Raises ``KeyError`` for what the configuration does not have and
    ``ValueError`` where inputs go round in a ring."""
    function, seen = None, []
    while True:
        if (res, variable) in seen:
            raise ValueError(f"inputs of {variable} form a ring")
        seen.append((res, variable))
        entry = config[dataset][res][variable]
        if not entry.get("input"):
            return res, variable, function
        function = function or entry.get("function")
        name, _, other = entry["input"].partition("/")
        res, variable = name, other or variable
