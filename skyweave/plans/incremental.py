"""Climatologies that take in new years without the old ones.

For each key and slot a table keeps the yearly values, in order of size, and
their moments. New years are merged in by one join of the new values with the
table; every statistic follows from a row of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions.compare import compare
from skyweave.functions.stats import exceedance
from skyweave.sources.manifest import _table

LOG = "step long, id string"
_VALUES = "array<struct<value:double,year:int>>"


def state(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``(keys…, values, n, mean, m2)`` of ``series(keys…, year, value)``:
    ``values`` by size, then year, missing ones left out; a key with none of
    them has an empty list. A key's values are as many as its years."""
    kept = F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), F.struct(F.col(value).cast("double").alias("value"), F.col("year").cast("int").alias("year")))
    return _with_moments(series.groupBy(*keys).agg(F.array_sort(F.collect_list(kept)).alias("values")))


def _moments(values: Column) -> Column:
    """``(n, mean, m2)`` of a list, centred."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v["value"]) / n
    m2 = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v["value"] - mean) * (v["value"] - mean))
    return F.struct(n.cast("long").alias("n"), F.when(n > 0, mean).alias("mean"), F.when(n > 0, m2).alias("m2"))


def _with_moments(df: DataFrame) -> DataFrame:
    return df.withColumn("_m", _moments(F.col("values"))).select(*df.columns, "_m.n", "_m.mean", "_m.m2")


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Two states as one. A year that both have is taken from ``new``, so a
    merge that runs twice changes nothing the second time. Moments of disjoint
    years are put together from either side's; where a year is replaced they
    are made from the values."""
    a, b = old.select(*keys, *[F.col(c).alias(f"_a{c}") for c in ("values", "n", "mean", "m2")]), new.select(*keys, *[F.col(c).alias(f"_b{c}") for c in ("values", "n", "mean", "m2")])
    both = a.join(b, keys, "full_outer")
    none = F.array().cast(_VALUES)
    va, vb = F.coalesce("_avalues", none), F.coalesce("_bvalues", none)
    years = F.transform(vb, lambda v: v["year"])
    apart = F.filter(va, lambda v: ~F.array_contains(years, v["year"]))
    whole = both.withColumns({"values": F.array_sort(F.concat(apart, vb)), "_gone": F.size(va) - F.size(apart)})
    na, nb = F.coalesce("_an", F.lit(0)), F.coalesce("_bn", F.lit(0))
    ma, mb = F.coalesce("_amean", F.lit(0.0)), F.coalesce("_bmean", F.lit(0.0))
    n, off = na + nb, mb - ma
    some = n > 0
    fast = F.struct(n.alias("n"), F.when(some, ma + off * nb / n).alias("mean"), F.when(some, F.coalesce("_am2", F.lit(0.0)) + F.coalesce("_bm2", F.lit(0.0)) + off * off * na * nb / n).alias("m2"))
    return whole.withColumn("_m", F.when(F.col("_gone") == 0, fast).otherwise(_moments(F.col("values")))).select(*keys, "values", "_m.n", "_m.mean", "_m.m2")


def percentile(values: Column, percent: float) -> Column:
    """Linear between the sorted values."""
    at = F.lit(percent / 100) * (F.size(values) - 1)
    low, part = F.floor(at).cast("int"), at - F.floor(at)
    get = lambda k: F.element_at(values, k + 1)["value"]
    return F.when(F.size(values) > 0, get(low) + F.when(part > 0, part * (get(F.least(low + 1, F.size(values) - 1)) - get(low))).otherwise(0.0))


def statistic(kept: DataFrame, keys: list[str], name: str, min_years: int = 30, op: str = ">=", threshold: float = 1.0, percent: float = 50.0, in_percent: bool = True) -> DataFrame:
    """``(keys…, n, value)`` from a state."""
    n, plain = F.col("n"), F.transform("values", lambda v: v["value"])
    sd = F.sqrt(F.col("m2") / n)
    scale = 100.0 if in_percent else 1.0
    value = {
        "mean": lambda: F.col("mean"),
        "stdev": lambda: sd,
        "cv": lambda: F.coalesce(100 * F.try_divide(sd, F.col("mean")), F.lit(0.0)),
        "min": lambda: F.array_min(plain),
        "max": lambda: F.array_max(plain),
        "median": lambda: percentile(F.col("values"), 50.0),
        "percentile": lambda: percentile(F.col("values"), percent),
        "frequency": lambda: F.try_divide(100.0 * F.size(F.filter(plain, lambda v: compare(v, op, threshold))), n),
        "probExc": lambda: exceedance(plain, threshold) * scale,
        "probNoExc": lambda: scale - exceedance(plain, threshold) * scale,
    }[name]()
    return kept.select(*keys, "n", F.when(n >= min_years, value).alias("value"))


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as it is now; none before the first year."""
    last = _table(spark, path, "_log", LOG).orderBy(F.desc("step"), "id").limit(1).collect()
    return spark.read.parquet(f"{path}/{last[0]['id']}") if last else None


def take_in(series: DataFrame, keys: list[str], path: str, value: str = "value") -> DataFrame:
    """Merge ``series(keys…, year, value)`` into the table at ``path``, the
    first call makes it; returns the table. A new table is written beside the
    old one and counts once the log names it: a run that is cut short changes
    nothing."""
    spark = series.sparkSession
    new, old = state(series, keys, value), read(spark, path)
    step = (_table(spark, path, "_log", LOG).agg(F.max("step")).first()[0] or 0) + 1
    id_ = f"t-{uuid.uuid4().hex}"
    (new if old is None else merged(old, new, keys)).write.parquet(f"{path}/{id_}")
    spark.createDataFrame([(step, id_)], LOG).coalesce(1).write.mode("append").parquet(f"{path}/_log")
    return spark.read.parquet(f"{path}/{id_}")
