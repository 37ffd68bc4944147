"""Summed-area tables: sums over all cells up to a corner, step by step.

The mean over any box is then a matter of four cells of the table, however
many cells the box has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .support import CELL, Axes


def summed_area(obs: DataFrame, axes: Axes, values: list[str]) -> DataFrame:
    """``(time, lat_i, lon_i, s_…, n_…, rows)`` for every time of ``obs`` and
    every cell of the grid, whose ``rows`` and ``cols`` must be known: sums and
    counts of the values, and counts of rows, at cells of neither greater row
    nor greater column. Missing
    values and cells count as none. Rows of a time and cell that repeat are
    counted each; those outside the grid, or without a time, are left out.

    Sums run along rows, then along columns, in windows no longer than the
    grid is."""
    if not axes.rows or not axes.cols:
        raise ValueError("the grid's rows and columns must be known")
    inside = obs.where(F.col("time").isNotNull() & F.col("lat_i").between(0, axes.rows - 1) & F.col("lon_i").between(0, axes.cols - 1))
    own = inside.groupBy("time", *CELL).agg(*[F.sum(F.col(v).cast("double")).alias(f"s_{v}") for v in values], *[F.count(v).alias(f"n_{v}") for v in values], F.count("*").alias("rows"))
    every = inside.select("time").distinct().withColumn("lat_i", F.explode(F.sequence(F.lit(0), F.lit(axes.rows - 1)))).withColumn("lon_i", F.explode(F.sequence(F.lit(0), F.lit(axes.cols - 1))))
    names = [*(f"{k}_{v}" for v in values for k in ("s", "n")), "rows"]
    out = every.join(own, ["time", *CELL], "left").select("time", *CELL, *[F.coalesce(c, F.lit(0.0 if c.startswith("s_") else 0)).alias(c) for c in names])
    for line, along in (("lat_i", "lon_i"), ("lon_i", "lat_i")):
        so_far = Window.partitionBy("time", line).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
        out = out.select("time", *CELL, *[F.sum(c).over(so_far).alias(c) for c in names])
    return out


def boxes(axes: Axes, places: DataFrame) -> DataFrame:
    """``(site, row0, row1, col0, col1)`` of ``places(site, west, south, east,
    north)``: the cells whose centres lie in the boxes, ends included; boxes
    without a cell are left out."""

    def ends(low: str, high: str, start: float, step: float, n: int) -> tuple:
        # Centres decide; the quotient says where about.
        guess = [F.floor((F.col(c) - start) / step) + k for c in (low, high) for k in (-1, 0, 1, 2)]
        fits = lambda j: (j >= 0) & (j < n) & (start + step * j).between(F.col(low), F.col(high))
        near = F.filter(F.array(*guess, F.lit(0).cast("long"), F.lit(n - 1).cast("long")), fits)
        return F.array_min(near).cast("int"), F.array_max(near).cast("int")

    (r0, r1), (c0, c1) = ends("south", "north", axes.lat0, axes.dlat, axes.rows), ends("west", "east", axes.lon0, axes.dlon, axes.cols)
    return places.select("site", r0.alias("row0"), r1.alias("row1"), c0.alias("col0"), c1.alias("col1")).where("row0 is not null and col0 is not null")


def box_mean(table: DataFrame, chosen: DataFrame, values: list[str], by: list[str] = ("time",)) -> DataFrame:
    """``(site, time, values…)``: means over :func:`boxes` from a table of
    :func:`summed_area`. Each box asks for four corners, one join for all
    boxes; corners before the first row or column are nothing. As with
    ``spatial_mean``, a time at which a box has no row is left out, and one at
    which it has rows without a value gives null."""
    corner = lambda i, j, sign: F.struct(F.col(i).alias("i") if i[-1] == "1" else (F.col(i) - 1).alias("i"), F.col(j).alias("j") if j[-1] == "1" else (F.col(j) - 1).alias("j"), F.lit(sign).alias("sign"))
    four = F.array(corner("row1", "col1", 1), corner("row0", "col1", -1), corner("row1", "col0", -1), corner("row0", "col0", 1))
    asked = chosen.select("site", F.explode(four).alias("c")).select("site", F.col("c.i").alias("lat_i"), F.col("c.j").alias("lon_i"), F.col("c.sign").alias("_sign")).where("lat_i >= 0 and lon_i >= 0")
    sums = table.join(asked, CELL).groupBy("site", *by).agg(*[F.sum(F.col("_sign") * F.col(c)).alias(c) for c in (*(f"{k}_{v}" for v in values for k in ("s", "n")), "rows")])
    return sums.where("rows > 0").select("site", *by, *[F.try_divide(F.col(f"s_{v}"), F.col(f"n_{v}")).alias(v) for v in values])
