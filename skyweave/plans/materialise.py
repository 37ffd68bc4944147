"""Computed variables, kept in a store beside what they are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.operators import derive as D
from skyweave.sources import grid as G

CELL = ["lat_i", "lon_i"]

#: What each computed variable is made of.
INPUTS = {"et0": ("tmin", "tmax", "precip"), "et0fao": ("tmin", "tmax"), "tmean": ("tmin", "tmax"), "trange": ("tmin", "tmax")}


def _value(name: str, res: str) -> Column:
    tmin, tmax, ra = F.col("tmin"), F.col("tmax"), D.radiation_on(F.col("time"), F.col("lat"), res)
    return {
        "et0": lambda: D.et0_modified(tmin, tmax, F.col("precip"), ra, res),
        "et0fao": lambda: D.et0_fao(tmin, tmax, ra),
        "tmean": lambda: (tmin + tmax) / 2,
        "trange": lambda: F.when(tmin.isNotNull() & tmax.isNotNull(), F.greatest(tmax - tmin, F.lit(0.0))),
    }[name]()


def computed(spark: SparkSession, store: str, dataset: str, res: str, name: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Variable ``name`` in the store's own form, on the times and cells that
    all of its inputs have there. The inputs are rows of one table: they meet
    in one aggregate and not in joins."""
    parts = INPUTS[name]
    rows = None
    for v in parts:
        mine = G.read_obs(spark, store, dataset, res, v, start, end)
        rows = mine if rows is None else rows.unionByName(mine)
    pick = [F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in parts]
    met = rows.groupBy("time", *CELL).agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.count_distinct("variable").alias("_n"), *pick)
    whole = met.where(F.col("_n") == len(parts))
    return whole.select(F.lit(dataset).alias("dataset"), F.lit(res).alias("res"), F.lit(name).alias("variable"), "time", *CELL, "lat", "lon", _value(name, res).alias("value"))


def materialise(spark: SparkSession, store: str, dataset: str, res: str, names: list[str], start: str | None = None, end: str | None = None) -> None:
    """Compute ``names`` from the store and append what it does not have yet;
    running it again appends nothing."""
    for name in names:
        G.append_unseen(computed(spark, store, dataset, res, name, start, end), store)
