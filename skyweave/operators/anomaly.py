"""Anomalies against a climatology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("difference", "percentage", "standardized")


def departure(kind: str, v: Column, mean: Column, stdev: Column) -> Column:
    """A value's distance from the mean, as it is, in percent of the mean or in
    standard deviations. A mean or deviation under 1e-4 gives 0. Missing stays
    missing."""
    if kind == "difference":
        return F.round(v - mean, 2)
    if kind == "percentage":
        return F.round(F.when(v.isNull() | mean.isNull(), None).when(mean < 1e-4, 0.0).otherwise(100 * (v - mean) / mean), 2)
    if kind == "standardized":
        return F.round(F.when(v.isNull() | stdev.isNull(), None).when(stdev < 1e-4, 0.0).otherwise((v - mean) / stdev), 4)
    raise ValueError(f"no anomaly {kind!r}; one of {', '.join(KINDS)}")


def anomaly(series: DataFrame, base: DataFrame, keys: list[str], value: str, kind: str, min_years: int = 30) -> DataFrame:
    """``series`` with ``value`` as anomaly; ``base`` holds the base period's
    values, ``keys`` what a climatology is for, slot included."""
    v = F.col(value)
    clim = base.groupBy(*keys).agg(F.count(v).alias("_n"), F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_sd"))
    enough = F.col("_n") >= min_years
    joined = series.join(clim, keys, "left")
    return joined.withColumn(value, departure(kind, v, F.when(enough, F.col("_mean")), F.when(enough, F.col("_sd")))).drop("_n", "_mean", "_sd")
