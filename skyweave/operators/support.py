"""Supports: which cells of a grid a request is about.

Every support comes down to a small table of cells, ``(site, lat_i, lon_i)``,
joined to observations on whole numbers; coordinates are never join keys.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = ["lat_i", "lon_i"]


@dataclass(frozen=True)
class Axes:
    """A regular grid: cell ``(i, j)`` has its centre at ``lat0 + dlat * i``
    and ``lon0 + dlon * j``; steps may be negative (axes that descend). What
    cells a support has follows from this alone, observations are not read.
    ``rows`` and ``cols``, where known, cut supports off at the grid's edge;
    beyond it no observation meets them anyway."""

    lat0: float
    lon0: float
    dlat: float
    dlon: float
    rows: int | None = None
    cols: int | None = None

    def lat(self) -> Column:
        return self.lat0 + self.dlat * F.col("lat_i")

    def lon(self) -> Column:
        return self.lon0 + self.dlon * F.col("lon_i")

    def located(self, df: DataFrame) -> DataFrame:
        """``df`` with its cells' centres."""
        return df.withColumns({"lat": self.lat(), "lon": self.lon()})

    def spread(self, df: DataFrame, west: Column, south: Column, east: Column, north: Column) -> DataFrame:
        """``df`` once for each cell of the box that a row names, with centres.
        Rows of the grid are dealt out before they are spread into cells."""

        def steps(low: Column, high: Column, start: float, step: float, size: int | None) -> Column:
            a, b = F.floor((low - start) / step), F.floor((high - start) / step)
            first, last = F.least(a, b), F.greatest(a, b) + 1
            if size is not None:
                first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(size - 1))
            return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))

        box = df.withColumns({"_w": west, "_s": south, "_e": east, "_n": north})
        lines = box.withColumn("lat_i", F.explode(steps(F.col("_s"), F.col("_n"), self.lat0, self.dlat, self.rows))).repartition("lat_i")
        found = self.located(lines.withColumn("lon_i", F.explode(steps(F.col("_w"), F.col("_e"), self.lon0, self.dlon, self.cols))))
        return found.where(F.col("lon").between(F.col("_w"), F.col("_e")) & F.col("lat").between(F.col("_s"), F.col("_n"))).drop("_w", "_s", "_e", "_n")


def bbox(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows whose cell centre lies in the box, edges included."""
    return df.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def bbox_cells(spark: SparkSession, axes: Axes, west: float, south: float, east: float, north: float, name: str = "rectangle") -> DataFrame:
    """Cells whose centre lies in the box, edges included."""
    one = spark.range(1).select(F.lit(name).alias("site"))
    return axes.spread(one, *[F.lit(float(x)) for x in (west, south, east, north)]).select("site", *CELL)


def point_cells(axes: Axes, sites: DataFrame, pad: int = 0) -> DataFrame:
    """Cells whose centre is within ``(pad + 0.5)`` steps of a site ``(loc,
    lon, lat)``, edges included, so a site on an edge takes both cells. They
    follow from the site's coordinates. Sites outside have no cell."""
    h, v = (pad + 0.5) * abs(axes.dlon), (pad + 0.5) * abs(axes.dlat)
    x, y = F.col("_x"), F.col("_y")
    wanted = sites.select(F.col("loc").alias("site"), F.col("lon").alias("_x"), F.col("lat").alias("_y"))
    # The box is wider than need be; the exact rule is that of distances.
    near = axes.spread(wanted, x - 1.01 * h, y - 1.01 * v, x + 1.01 * h, y + 1.01 * v)
    return near.where((F.abs(F.col("lon") - x) <= h) & (F.abs(F.col("lat") - y) <= v)).select("site", *CELL)


def _edges(ring: Column, x: Column, y: Column) -> Column:
    """``(inside, on edge)`` of a point and one ring, by crossings."""

    def step(acc: Column, i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        on = (cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        straddles = (a["y"] > y) != (b["y"] > y)
        right = F.when(straddles, x < a["x"] + (y - a["y"]) / (b["y"] - a["y"]) * (b["x"] - a["x"])).otherwise(F.lit(False))
        return F.struct((acc["inside"] != right).alias("inside"), (acc["on"] | on).alias("on"))

    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("on"))
    return F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), start, step)


def within(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point lies strictly inside the rings: crossings of all rings
    count together, so a hole is a ring inside another."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("on"))

    def merge(acc: Column, ring: Column) -> Column:
        one = _edges(ring, x, y)
        return F.struct((acc["inside"] != one["inside"]).alias("inside"), (acc["on"] | one["on"]).alias("on"))

    return F.aggregate(rings, start, merge, lambda s: s["inside"] & ~s["on"])


def bounds(zones: DataFrame) -> DataFrame:
    """``zones(zone, rings)`` with the box around each."""
    flat = F.flatten("rings")
    low = lambda k: F.array_min(F.transform(flat, lambda p: p[k]))
    high = lambda k: F.array_max(F.transform(flat, lambda p: p[k]))
    return zones.withColumns({"west": low("x"), "east": high("x"), "south": low("y"), "north": high("y")})


def edges(zones: DataFrame) -> DataFrame:
    """``(zone, ax, ay, bx, by)``: the sides of all rings, those from a point
    to itself left out. A ring that does not end where it begins is closed."""
    ring = F.col("ring")
    closed = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    rings = zones.select("zone", F.explode("rings").alias("ring")).where(F.size("ring") > 0).withColumn("ring", closed)
    sides = rings.select("zone", F.explode(F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("a"), F.slice("ring", 2, F.size("ring") - 1).alias("b"))).alias("s"))
    found = sides.select("zone", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    return found.where("ax <> bx or ay <> by")


def polygon_runs(axes: Axes, zones: DataFrame) -> DataFrame:
    """``(zone, lat_i, first, last)``: the runs of columns whose centres lie
    strictly inside a zone, row by row of the grid.

    Each side of a ring is dealt to the rows that it reaches; there it gives
    the longitude at which it crosses. Sorted, a row's crossings bound its runs
    by pairs, so cost grows with sides and the rows they span, not with the
    cells of a box times its sides. Centres on a side are outside: runs leave
    out crossings, and what lies level with a row, corners and flat sides,
    is cut out of its runs."""
    lat, lon = axes.lat(), lambda j: axes.lon0 + axes.dlon * j
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    a, b = F.floor((low - axes.lat0) / axes.dlat), F.floor((high - axes.lat0) / axes.dlat)
    first, last = F.least(a, b), F.greatest(a, b) + 1
    if axes.rows is not None:
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(axes.rows - 1))
    reach = F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))
    lines = edges(zones).withColumn("lat_i", F.explode(reach)).withColumn("y", lat)
    crosses = (F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))
    at = F.col("ax") + (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    ends = F.array_sort(F.array("ax", "bx"))
    flat = (F.col("ay") == F.col("y")) & (F.col("by") == F.col("y"))
    level = F.when(flat, F.struct(ends[0].alias("a"), ends[1].alias("b"))).when(F.col("ay") == F.col("y"), F.struct(F.col("ax").alias("a"), F.col("ax").alias("b")))
    rows = lines.groupBy("zone", "lat_i").agg(F.array_sort(F.collect_list(F.when(crosses, at))).alias("x"), F.collect_set(level).alias("level"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("x") - 1, F.lit(2)), lambda k: F.struct(F.element_at("x", k).alias("a"), F.element_at("x", k + 1).alias("b")))
    spans = rows.where(F.size("x") > 1).select("zone", "lat_i", F.array_sort("level").alias("level"), F.explode(pairs).alias("s"))
    # What lies between the level parts of a row; of those that overlap, the farthest end counts.
    since = F.transform(F.sequence(F.lit(0), F.size("level")), lambda k: F.greatest(F.col("s.a"), F.array_max(F.transform(F.slice("level", 1, k), lambda p: p["b"]))))
    until = F.concat(F.transform("level", lambda p: F.least(F.col("s.b"), p["a"])), F.array("s.b"))
    free = spans.select("zone", "lat_i", F.explode(F.arrays_zip(since.alias("a"), until.alias("b"))).alias("s"))
    inside = lambda j: (lon(j) > F.col("s.a")) & (lon(j) < F.col("s.b"))
    u, v = (F.col("s.a") - axes.lon0) / axes.dlon, (F.col("s.b") - axes.lon0) / axes.dlon
    one, other = F.floor(F.least(u, v)), F.ceil(F.greatest(u, v))
    # The quotients say where about a run begins and ends; the centres themselves decide.
    first = F.coalesce(*[F.when(inside(one + k), one + k) for k in range(-1, 3)])
    last = F.coalesce(*[F.when(inside(other - k), other - k) for k in range(-1, 3)])
    if axes.cols is not None:
        first, last = F.when(first.isNotNull(), F.greatest(first, F.lit(0))), F.when(last.isNotNull(), F.least(last, F.lit(axes.cols - 1)))
    return free.select("zone", "lat_i", first.cast("int").alias("first"), last.cast("int").alias("last")).where("first <= last")


def polygon_cells(axes: Axes, zones: DataFrame) -> DataFrame:
    """Cells whose centre lies strictly inside a zone, from
    :func:`polygon_runs`."""
    return polygon_runs(axes, zones).select(F.col("zone").alias("site"), "lat_i", F.explode(F.sequence("first", "last")).alias("lon_i"))


#: Columns of the grid that are looked up together when rows meet runs.
WIDTH = 32


def on_runs(obs: DataFrame, runs: DataFrame) -> DataFrame:
    """``obs`` with ``site``, once for each run that a row's cell lies in: a
    join of ranges. Runs are cut at every ``WIDTH`` columns, so that rows meet
    only runs of their row and stretch, by an ordinary join of keys."""
    cut = F.sequence(F.floor(F.col("first") / WIDTH).cast("int"), F.floor(F.col("last") / WIDTH).cast("int"))
    near = runs.select(F.col("zone").alias("site"), "lat_i", F.col("first").alias("_first"), F.col("last").alias("_last"), F.explode(cut).alias("_w"))
    met = obs.withColumn("_w", F.floor(F.col("lon_i") / WIDTH).cast("int")).join(near, ["lat_i", "_w"])
    return met.where(F.col("lon_i").between(F.col("_first"), F.col("_last"))).select(*[obs[c] for c in obs.columns], "site")


def mask(obs: DataFrame, chosen: DataFrame, value: str) -> DataFrame:
    """``obs`` with ``value`` null outside the chosen cells."""
    hit = chosen.select(*CELL).distinct().withColumn("_hit", F.lit(True))
    return obs.join(hit, CELL, "left").withColumn(value, F.when(F.col("_hit"), F.col(value))).drop("_hit")


def run_mean(obs: DataFrame, runs: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """:func:`spatial_mean` over zones given by their runs."""
    return on_runs(obs, runs).groupBy("site", *by).agg(*[F.avg(v).alias(v) for v in values])


def spatial_mean(obs: DataFrame, chosen: DataFrame, values: list[str], by: list[str]) -> DataFrame:
    """Unweighted means over each site's cells; missing cells are left out."""
    return obs.join(chosen, CELL).groupBy("site", *by).agg(*[F.avg(v).alias(v) for v in values])


def centroid(ring: Column) -> Column:
    """A ring's centroid ``(lon, lat)``: that of its image in the Web Mercator
    plane, taken back and rounded to six decimals."""
    r = 6378137.0
    to_x = lambda p: p["x"] * math.pi / 180 * r
    to_y = lambda p: F.log(F.tan(math.pi / 4 + p["y"] * math.pi / 360)) * r
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc: Column, i: Column) -> Column:
        p, q = F.element_at(ring, i), F.element_at(ring, i + 1)
        px, py, qx, qy = to_x(p), to_y(p), to_x(q), to_y(q)
        c = px * qy - qx * py
        return F.struct((acc["a"] + c).alias("a"), (acc["x"] + (px + qx) * c).alias("x"), (acc["y"] + (py + qy) * c).alias("y"))

    def finish(s: Column) -> Column:
        x, y = s["x"] / (3 * s["a"]), s["y"] / (3 * s["a"])
        lat = (F.atan(F.exp(y / r)) * 2 - math.pi / 2) * 180 / math.pi
        return F.struct(F.round(x / r * 180 / math.pi, 6).alias("lon"), F.round(lat, 6).alias("lat"))

    return F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), start, step, finish)


def zone_points(zones: DataFrame) -> DataFrame:
    """``(loc, lon, lat)``: each zone's centroid, the mean of its rings' where
    it has several."""
    rings = zones.select("zone", F.explode("rings").alias("ring")).withColumn("c", centroid(F.col("ring")))
    return rings.groupBy(F.col("zone").alias("loc")).agg(F.round(F.avg("c.lon"), 6).alias("lon"), F.round(F.avg("c.lat"), 6).alias("lat"))
