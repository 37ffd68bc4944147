"""Faster forms of grid operators against their plain ones."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from skyweave.operators import climatology, resample, season, support
from skyweave.sources import places


def star(draw, cx, cy, n, step):
    out = []
    for k in range(n):
        a, r = 2 * math.pi * k / n, draw.uniform(0.4, 3)
        x, y = cx + r * math.cos(a), cy + r * math.sin(a)
        out.append((round(x / step) * step, round(y / step) * step) if step else (x, y))
    return out


@pytest.fixture(scope="module")
def shapes(spark):
    """Stars, half of them with corners on cells' centres, a hole, a notch that
    ends at a row, a flat side within a row, and a point."""
    draw = random.Random(1)
    zones = {f"z{k}": [star(draw, draw.uniform(29, 35), draw.uniform(-3, 3), draw.randint(3, 12), 0.5 * (k % 2))] for k in range(30)}
    zones["hole"] = [[(30, -2), (34, -2), (34, 2), (30, 2)], [(31, -1), (33, -1), (33, 1), (31, 1)]]
    zones["notch"] = [[(30, -2), (34, -2), (34, 1), (32, 0), (31, 1)]]
    zones["step"] = [[(30, -2), (34, -2), (34, 0), (32, 0), (32, 1), (30, 1)], [(30.5, 0), (31, -0.5), (31.5, 0)]]
    zones["point"] = [[(31, 0), (31, 0)]]
    return places.zones(spark, zones)


@pytest.mark.parametrize("axes", [support.Axes(-2.0, 30.0, 0.5, 0.5, 9, 9), support.Axes(2.0, 34.0, -0.5, -0.5), support.Axes(-3.11317, 29.03771, 0.13171, 0.17393)])
def test_runs_are_the_cells_that_rays_find(shapes, axes):
    found = {tuple(r) for r in support.polygon_cells(axes, shapes).collect()}
    box = axes.spread(support.bounds(shapes), *[F.col(k) for k in ("west", "south", "east", "north")])
    rays = box.where(support.within(F.col("rings"), F.col("lon"), F.col("lat"))).select("zone", "lat_i", "lon_i")
    assert found == {tuple(r) for r in rays.collect()} and len(found) > 300
    runs = support.polygon_runs(axes, shapes).collect()
    assert sum(r["last"] - r["first"] + 1 for r in runs) == len(found) > 2 * len(runs)


def test_rows_meet_runs(spark, shapes):
    axes = support.Axes(-3.0, 29.0, 0.05, 0.05)
    cells = spark.range(120 * 120).selectExpr("cast(id div 120 as int) lat_i", "cast(id % 120 as int) lon_i", "cast(id as double) v", "'x' site_name")
    met = {(r["site"], r["lat_i"], r["lon_i"]) for r in support.on_runs(cells, support.polygon_runs(axes, shapes)).collect()}
    inside = {tuple(r) for r in support.polygon_cells(axes, shapes).where("lat_i between 0 and 119 and lon_i between 0 and 119").collect()}
    assert met == inside
    assert support.on_runs(cells, support.polygon_runs(axes, shapes.limit(0))).count() == 0


def days(spark, years, keys=2, seed=4):
    draw = random.Random(seed)
    d, end, rows = dt.date(years[0], 1, 1), dt.date(years[1], 12, 31), []
    while d <= end:
        rows += [(k, d, draw.choice([None, round(draw.gauss(10, 5), 3)])) for k in range(keys) if draw.random() < 0.9]
        d += dt.timedelta(1)
    return spark.createDataFrame(rows, "cell int, time date, v double")


@pytest.mark.parametrize("window", [1, 7, 40])
def test_windows_from_parts(spark, window):
    obs = days(spark, (1995, 2004))
    parts = climatology.windowed(obs, ["cell"], "v", 1996, 2003, window, threshold=9.0)
    plain = climatology.slots(obs, "daily", 1996, 2003, window, "time")
    for name in climatology.FROM_PARTS:
        how = {"threshold": 9.0} if name == "frequency" else {}
        a = climatology.windowed_statistic(parts, ["cell"], name, 5).collect()
        b = climatology.climatology(plain, ["cell", "slot"], "v", name, 5, **how).collect()
        a, b = ({(r["cell"], r["slot"]): (r["n"], r["value"]) for r in x} for x in (a, b))
        assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and (a[k][1] is None) == (b[k][1] is None) and abs((a[k][1] or 0) - (b[k][1] or 0)) < 1e-9 for k in a)


@pytest.mark.parametrize("function", [*resample.MERGED, "median"])
def test_rolling_seasons_from_months(spark, function):
    obs = days(spark, (1999, 2001))
    got = resample.resample(obs, ["cell"], "v", "seasonal", function, min_frac=0.2, threshold=9.0, full_year=True, length=4)
    rows = resample.assign_period(obs, "seasonal", length=4, full_year=True)
    want = rows.groupBy("cell", "period").agg(F.count("v").alias("n"), resample.reducer(function, F.col("v"), ">=", 9.0).alias("x")).collect()
    got = {(r["cell"], r["period"]): (r["n_valid"], r["v"]) for r in got.collect()}
    want = {(r["cell"], r["period"]): (r["n"], r["x"]) for r in want}
    assert len(got) > 60 and all(got[k][0] == want[k][0] and (got[k][1] is None or abs(got[k][1] - want[k][1]) < 1e-9) for k in got)


def test_no_task_holds_a_period(spark):
    """Times of a period are counted by partial sums: no window, and no
    exchange by period but that of one row a task and period."""
    plan = resample.resample(days(spark, (1999, 1999)), ["cell"], "v", "monthly")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastHashJoin" in plan


def test_times_and_spans_may_be_given(spark):
    obs = days(spark, (1999, 2000))
    every = spark.sql("select explode(sequence(date'1998-01-01', date'2000-12-31')) time")
    some = obs.where("day(time) <= 10")
    bare = resample.resample(some, ["cell"], "v", "monthly", mode="R2", min_frac=0.3)
    told = resample.resample(some, ["cell"], "v", "monthly", mode="R2", min_frac=0.3, times=every)
    # Told of the other days, a key lacks most of them.
    assert bare.where("v is not null").count() > 40 and told.where("v is not null").count() == 0 < told.count()
    s = season.Season(1101, 228, min_frac=0.0)
    rain = obs.withColumnRenamed("v", "precip")
    a = season.index(rain, ["cell"], "NumWD", s).count()
    b = season.index(rain, ["cell"], "NumWD", s, season.span_of(every)).count()
    assert (a, b) == (2 * 3, 2 * 4)
