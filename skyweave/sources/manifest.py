"""What a store of observations has, without reading it.

Beside the rows a store keeps bitmaps: for each dataset, resolution, variable
and year, and each block of 8 by 8 cells of the grid, which cells have which
days. Cells of a block that have the same days share a row, so a full field of
any length is one row a block and year. Rows that come in are tested against
the bitmaps, and what a store covers is summed up from them.

An append says in the log that it begins, writes its rows, then their bitmaps,
and says that it is done. One that was cut short between the two is seen by
the log; the bitmaps of the years it touched are then made from their rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions import calendar as C

KEY = ["dataset", "res", "variable", "year"]
#: Days in a word of a bitmap, and words of a year.
DAYS, WORDS = 61, 6
_BITS = [f"d{k}" for k in range(WORDS)]
SCHEMA = f"dataset string, res string, variable string, year int, block long, cells long, {', '.join(f'{b} long' for b in _BITS)}, row0 int, row1 int, col0 int, col1 int, south double, north double, west double, east double"
LOG = "id string, state string, dataset string, res string, variable string, year int"


def _bit(place: Column) -> Column:
    """``place`` from 0 to 63; Spark shifts by a column in SQL only."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _block(i: Column, j: Column) -> Column:
    """Number of a cell's block: its row and column in either half."""
    return F.shiftleft(F.floor(i / 8).cast("long"), 32).bitwiseOR(F.floor(j / 8).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def _cell(i: Column, j: Column) -> Column:
    return _bit(F.pmod(i, F.lit(8)) * 8 + F.pmod(j, F.lit(8)))


def days(rows: DataFrame) -> DataFrame:
    """The bitmaps of ``rows``, as :data:`SCHEMA` has them."""
    day = F.dayofyear("time") - 1
    own = [F.bit_or(F.when(F.floor(day / DAYS) == k, _bit(day % DAYS)).otherwise(F.lit(0).cast("long"))).alias(f"d{k}") for k in range(WORDS)]
    cells = rows.withColumn("year", F.year("time")).groupBy(*KEY, "lat_i", "lon_i").agg(*own, F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    i, j = F.col("lat_i"), F.col("lon_i")
    ends = [F.min(i).alias("row0"), F.max(i).alias("row1"), F.min(j).alias("col0"), F.max(j).alias("col1"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east")]
    return cells.groupBy(*KEY, _block(i, j).alias("block"), *_BITS).agg(F.bit_or(_cell(i, j)).alias("cells"), *ends).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table beside the rows; empty where it is not there. Spark passes over
    folders whose names begin so when it reads the store."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(f"{path}/{name}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read(spark: SparkSession, path: str) -> DataFrame:
    """The bitmaps of the store at ``path``; those of one block may be spread
    over several rows."""
    return _table(spark, path, "_days", SCHEMA)


def _keep(bitmaps: DataFrame, path: str) -> None:
    bitmaps.write.mode("append").partitionBy(*KEY).parquet(f"{path}/_days")


def _say(spark: SparkSession, path: str, id_: str, state: str, keys: list[tuple]) -> None:
    rows = [(id_, state, *k) for k in keys] or [(id_, state, None, None, None, None)]
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{path}/_log")


def missing(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The ``rows(dataset, res, variable, time, lat_i, lon_i, …)`` that the
    bitmaps do not have. A block's bitmaps, few, meet its rows."""
    held = bitmaps.groupBy(*KEY, "block").agg(F.collect_list(F.struct("cells", *_BITS)).alias("_held"))
    day = F.dayofyear("time") - 1
    placed = rows.withColumns({"year": F.year("time"), "block": _block(F.col("lat_i"), F.col("lon_i")), "_cell": _cell(F.col("lat_i"), F.col("lon_i")), "_word": F.floor(day / DAYS).cast("int"), "_day": _bit(day % DAYS)})
    found = placed.join(held, [*KEY, "block"], "left")
    word = lambda h: F.element_at(F.array(*[h[b] for b in _BITS]), F.col("_word") + 1)
    there = F.exists("_held", lambda h: (h["cells"].bitwiseAND(F.col("_cell")) != 0) & (word(h).bitwiseAND(F.col("_day")) != 0))
    return found.where(~F.coalesce(there, F.lit(False))).select(*rows.columns)


def append(incoming: DataFrame, path: str) -> None:
    """Append the rows of ``incoming`` whose time and cell a store does not
    have, and keep its manifest."""
    from skyweave.sources import grid

    spark = incoming.sparkSession
    repair(spark, path)
    keys = [tuple(r) for r in incoming.select("dataset", "res", "variable", F.year("time").alias("year")).distinct().collect()]  # one a variable and year
    if not keys:
        return
    years = sorted({k[3] for k in keys})
    fresh = missing(incoming, read(spark, path).where(F.col("year").isin(years)))
    id_ = uuid.uuid4().hex
    _say(spark, path, id_, "begun", keys)
    grid.write_obs(fresh, path)
    # The bitmaps have not changed yet: the same rows are new as when they were written.
    _keep(days(fresh), path)
    _say(spark, path, id_, "done", [])


def repair(spark: SparkSession, path: str) -> int:
    """Make the bitmaps of what appends have begun and not done; returns how
    many such appends there were. A store without any log is taken in whole,
    so that one that was written otherwise can be appended to."""
    from skyweave.sources import grid

    log = _table(spark, path, "_log", LOG)
    stored = grid.stored_obs(spark, path)
    if log.isEmpty():
        if stored is not None:
            _keep(days(stored), path)
            _say(spark, path, uuid.uuid4().hex, "done", [])
            return 1
        return 0
    open_ = log.where("state = 'begun'").join(log.where("state = 'done'").select("id"), "id", "left_anti")
    found = open_.select("id", *KEY).collect()  # what appends of late have touched
    if not found:
        return 0
    if stored is not None:
        touched = F.broadcast(spark.createDataFrame(sorted({tuple(r)[1:] for r in found}), ", ".join(LOG.split(", ")[2:])))
        _keep(days(stored.join(touched, KEY, "left_semi")), path)
    for id_ in sorted({r["id"] for r in found}):
        _say(spark, path, id_, "done", [])
    return len({r["id"] for r in found})


def compact(spark: SparkSession, path: str) -> DataFrame:
    """The bitmaps with one row for each set of days of a block: what many
    appends have spread is put together. The cells of a block are laid out for
    that, 64 at most."""
    cell = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftright", F.col("cells"), k).bitwiseAND(F.lit(1).cast("long")) == 1)).alias("_k")
    ends = {"row0": F.min, "row1": F.max, "col0": F.min, "col1": F.max, "south": F.min, "north": F.max, "west": F.min, "east": F.max}
    each = read(spark, path).select("*", cell).groupBy(*KEY, "block", "_k").agg(*[F.bit_or(b).alias(b) for b in _BITS], *[f(c).alias(c) for c, f in ends.items()])
    one = each.groupBy(*KEY, "block", *_BITS).agg(F.bit_or(_bit(F.col("_k"))).alias("cells"), *[f(c).alias(c) for c, f in ends.items()])
    return one.select(*[c.split()[0] for c in SCHEMA.split(", ")])


def coverage(bitmaps: DataFrame, res: str = "daily") -> DataFrame:
    """``(dataset, res, variable, west, east, south, north, step_lon,
    step_lat, n_times, n_rows, start, end)`` of a store, from its bitmaps
    alone: the box of its cells' centres (six decimals), the mean step of
    either axis, the first and the last day as labels, how many days there
    are, and how many cells and days, of :func:`compact` ones. Resolutions
    other than daily are told by their days too."""
    name = KEY[:3]
    own = F.bit_count("cells") * sum((F.bit_count(b) for b in _BITS), F.lit(0))
    year = bitmaps.groupBy(*KEY).agg(
        *[F.bit_or(b).alias(b) for b in _BITS], F.sum(own).alias("n_rows"),
        *[f(c).alias(c) for f, c in ((F.min, "row0"), (F.max, "row1"), (F.min, "col0"), (F.max, "col1"), (F.min, "south"), (F.max, "north"), (F.min, "west"), (F.max, "east"))],
    )
    there = F.filter(F.sequence(F.lit(0), F.lit(365)), lambda d: F.call_function("shiftright", F.element_at(F.array(*_BITS), F.floor(d / DAYS).cast("int") + 1), d % DAYS).bitwiseAND(F.lit(1).cast("long")) == 1)
    at = lambda d: F.date_add(F.make_date(F.col("year"), F.lit(1), F.lit(1)), d)
    year = year.withColumn("_days", there).withColumns({"_a": at(F.array_min("_days")), "_b": at(F.array_max("_days"))})
    step = lambda a, b, i, j: F.round(F.try_divide(F.max(b) - F.min(a), (F.max(j) - F.min(i)).cast("double")), 6)
    out = year.groupBy(*name).agg(
        F.round(F.min("west"), 6).alias("west"), F.round(F.max("east"), 6).alias("east"), F.round(F.min("south"), 6).alias("south"), F.round(F.max("north"), 6).alias("north"),
        step("west", "east", "col0", "col1").alias("step_lon"), step("south", "north", "row0", "row1").alias("step_lat"),
        F.sum(F.size("_days")).cast("long").alias("n_times"), F.sum("n_rows").alias("n_rows"), F.min("_a").alias("_a"), F.max("_b").alias("_b"),
    )
    return out.withColumns({"start": C.label(F.col("_a"), res), "end": C.label(F.col("_b"), res)}).drop("_a", "_b")
