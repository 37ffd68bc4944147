"""Kernels against values worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from skyweave.functions import calendar as C
from skyweave.functions import stats
from skyweave.functions.compare import compare
from skyweave.operators import anomaly, climatology, derive, resample, season, support
from skyweave.sources import places


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def d(text):
    return F.lit(text).cast("date")


@pytest.mark.parametrize(("values", "threshold", "expected"), [([1, 2, 4, 9], 2, 0.6), ([1, 2, 4, 9], 3, 0.5), ([1, 2, 4, 9], -0.5, 0.95), ([1, 2, 4, 9], -2, 1.0), ([1, 2, 4, 9], 10, 0.1), ([1, 2], 1, None), ([2, 2, 5], 2, 0.75), ([3, 3, 3], 2, 1.0), ([3, 3, 3], 4, 0.0)])
def test_exceedance(spark, values, threshold, expected):
    got = value(spark, stats.exceedance(F.lit([float(v) for v in values]), threshold))
    assert got == expected if expected is None else abs(got - expected) < 1e-12


@pytest.mark.parametrize(("t", "df", "p"), [(2.0, 1, 0.2951672), (2.0, 2, 0.1835034), (2.5, 3, 0.0877066), (-2.228139, 10, 0.05), (0.0, 5, 1.0), (3.0, 4, 0.0399421)])
def test_student_t(spark, t, df, p):
    assert abs(value(spark, stats.two_sided_t(F.lit(t), F.lit(df))) - p) < 1e-6


def test_calendar(spark):
    assert [value(spark, C.dekad(d(f"2001-05-{x}"))) for x in ("10", "11", "20", "21", "31")] == [1, 2, 2, 3, 3]
    assert value(spark, C.slot(d("2000-02-29"), "daily")) == 59 == value(spark, C.slot(d("2001-02-28"), "daily"))
    assert value(spark, C.slot(d("2000-12-31"), "daily")) == 365
    assert value(spark, C.season_year(d("2000-01-15"), 1101, 228)) == 1999
    assert value(spark, C.season_length(F.lit(1999), 1101, 229)) == 121 and value(spark, C.season_length(F.lit(2000), 1101, 229)) == 120
    assert value(spark, C.season_label(F.lit(1999), 1101, 228)) == "1999-11-01_2000-02-28"
    assert [value(spark, C.steps(d(x), "dekadal", "daily")) for x in ("2000-02-21", "2001-02-21", "2001-03-01")] == [9, 8, 10]
    assert value(spark, C.steps(d("2000-01-01"), "annual", "daily")) == 366 and value(spark, C.steps(d("2000-01-01"), "annual", "dekadal")) == 36
    assert value(spark, C.label(d("2000-11-01"), "seasonal")) == "2000-11_2001-01"
    assert value(spark, C.parse_label(F.lit("2000-02-3"), "dekadal")) == dt.date(2000, 2, 21)
    assert value(spark, C.stamp(d("2000-02-21"), "dekadal")) == dt.date(2000, 2, 26)
    assert [x.day for x in value(spark, C.dekads(d("2000-01-05"), d("2000-02-11")))] == [1, 11, 21, 1, 11]
    assert len(value(spark, C.days_of(d("2000-02-21"), "dekadal"))) == 9
    assert value(spark, C.slot_label(F.lit(5), "dekadal", 1991, 2020)) == "1991-2020_02-2"
    assert value(spark, C.file_date(F.lit("rr_2000022.nc"), "rr_%Y%m%-d.nc")) == dt.date(2000, 2, 16)
    assert value(spark, C.file_date(F.lit("rr_20000203.nc"), "rr_%Y%m%d.nc")) == dt.date(2000, 2, 3)
    assert value(spark, C.file_date(F.lit("other.nc"), "rr_%Y%m%d.nc")) is None


def series(spark, values, start="2001-01-01"):
    first = dt.date.fromisoformat(start)
    return spark.createDataFrame([(0, first + dt.timedelta(k), v) for k, v in enumerate(values)], "cell int, time date, precip double")


@pytest.mark.parametrize(("values", "name", "expected"), [([9.0] * 15, "NumWS", 2.0), ([9.0] * 6 + [None] + [9.0] * 6, "NumWS", 0.0), ([9.0] * 6 + [None] + [9.0] * 4, "LongWS", 6.0), ([0.0] * 8 + [9.0] + [0.0] * 7, "NumDS", 2.0), ([None] * 9, "LongDS", 0.0)])
def test_spells(spark, values, name, expected):
    found = season.index(series(spark, values), ["cell"], name, season.Season(101, 131, min_frac=0.0)).collect()
    assert [r["value"] for r in found] == [expected]


def test_degree_days_and_validation(spark):
    temps = spark.createDataFrame([(0, dt.date(2001, 1, 1 + k), v, v) for k, v in enumerate([20.0, 15.0, None, 19.0])], "cell int, time date, tmin double, tmax double")
    assert season.index(temps, ["cell"], "CDD", season.Season(101, 131, min_frac=0.0)).first()["value"] == 3
    with pytest.raises(ValueError):
        season.Season(1301, 101)
    with pytest.raises(ValueError):
        compare(F.lit(1), "__import__", 2)


def test_properties_of_indices(spark):
    import random

    rng = random.Random(3)
    days = series(spark, [rng.choice([0.0, 0.0, 2.0, 30.0, None]) for _ in range(120)])
    get = lambda n: season.index(days, ["cell"], n, season.Season(101, 430, spell=2, min_frac=0.0)).first()["value"]
    wet, dry = get("NumWD"), get("NumDD")
    assert wet + dry == season.index(days, ["cell"], "NumWD", season.Season(101, 430, min_frac=0.0)).first()["n_valid"]
    assert abs(get("TotRain") - get("RainInt") * wet) < 1e-9
    assert get("NumDS") * 2 <= dry and get("LongDS") <= dry


def test_resample_is_consistent(spark):
    obs = series(spark, [float(k % 7) for k in range(365)])
    month = resample.resample(obs, ["cell"], "precip", "monthly", "sum", min_frac=1.0)
    dekads = resample.resample(obs, ["cell"], "precip", "dekadal", "sum", min_frac=1.0).select("cell", F.col("period").alias("time"), "precip")
    again = resample.resample(dekads, ["cell"], "precip", "monthly", "sum", "dekadal", min_frac=1.0)
    key = lambda df: sorted((r["period"], r["precip"]) for r in df.collect())
    assert key(month) == key(again) and len(key(month)) == 12


def test_trend_with_gaps(spark):
    rows = [(0, 1995 + k, float(v)) for k, v in enumerate([1, 3, 2, 5, 4]) if k != 1]
    got = climatology.trend(spark.createDataFrame(rows, "cell int, year int, v double"), ["cell"], "v", 1995, 1999, 3).first()
    y = [(k, v) for k, v in enumerate([1, 3, 2, 5, 4]) if k != 1]
    my = sum(v for _, v in y) / 4
    cov = sum((k - 2) * (v - my) for k, v in y) / 3
    slope = cov / 2.5
    intercept = my - slope * 2
    sigma = math.sqrt(sum((v - intercept - slope * k) ** 2 for k, v in y) / 2)
    assert abs(got["slope"] - slope) < 1e-12 and abs(got["sigma"] - sigma) < 1e-9
    assert abs(got["std_slope"] - sigma / math.sqrt(10)) < 1e-9


def test_anomaly_and_percentiles(spark):
    assert value(spark, anomaly.departure("standardized", F.lit(5.0), F.lit(3.0), F.lit(0.0))) == 0
    assert value(spark, anomaly.departure("percentage", F.lit(None).cast("double"), F.lit(3.0), F.lit(1.0))) is None
    df = spark.createDataFrame([(0, v) for v in (1.0, 2.0, 4.0, 9.0)], "cell int, v double")
    assert [round(r["value"], 9) for r in climatology.percentiles(df, ["cell"], "v", [5, 25, 95], 4).collect()] == [1.15, 1.75, 8.25]
    assert abs(climatology.climatology(df, ["cell"], "v", "stdev", 4).first()["value"] - 3.0822070) < 1e-6
    assert climatology.climatology(df, ["cell"], "v", "mean", 5).first()["value"] is None


def test_radiation_without_sunset(spark):
    assert value(spark, derive.radiation(F.lit(355), F.lit(70.0))) == 0
    assert value(spark, derive.radiation(F.lit(172), F.lit(70.0))) > 40
    assert 33 < value(spark, derive.radiation(F.lit(80), F.lit(0.0))) < 40


def test_polygons_with_holes_and_edges(spark):
    zone = places.zones(spark, {"z": [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]]})
    grid = support.Axes(0.5, 0.0, 1.0, 1.0, 5, 5)
    got = {(r["lat_i"], r["lon_i"]) for r in support.polygon_cells(grid, zone).collect()}
    assert got == {(i, j) for i in (0, 3) for j in (1, 2, 3)}
    c = value(spark, support.centroid(F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D, 'y', 0D), named_struct('x', 2D, 'y', 2D), named_struct('x', 0D, 'y', 2D), named_struct('x', 0D, 'y', 0D))")))
    assert c["lon"] == 1.0 and abs(c["lat"] - 1.0) < 1e-3
    # The same cells on axes that descend, without knowing where they end.
    down = support.Axes(4.5, 4.0, -1.0, -1.0)
    assert {(4 - r["lat_i"], 4 - r["lon_i"]) for r in support.polygon_cells(down, zone).collect()} == got
    sites = places.sites(spark, [("a", 1.0, 1.5), ("b", 1.5, 1.5), ("c", 99.0, 9.0)])
    near = lambda axes: sorted(map(tuple, axes.located(support.point_cells(axes, sites)).select("site", "lat", "lon").collect()))
    assert near(grid) == [("a", 1.5, 1.0), ("b", 1.5, 1.0), ("b", 1.5, 2.0)] and [x for x in near(down) if x[0] != "c"] == near(grid)


def test_absent_days_are_days_without_a_value(spark):
    """Seasons of sparse rows against the definition day by day."""
    import random

    rng = random.Random(12)
    first = dt.date(1999, 11, 20)
    have = {c: {first + dt.timedelta(k): rng.choice([0.0, 5.0, 30.0, None]) for k in range(800) if rng.random() < 0.8 and (c != 1 or k > 500)} for c in range(3)}
    obs = spark.createDataFrame([(c, t, v) for c, x in have.items() for t, v in x.items()], "cell int, time date, precip double")
    s = season.Season(1015, 120, threshold=5.0, spell=2, min_frac=0.0)
    a, b = (f(t for x in have.values() for t in x) for f in (min, max))
    expected = {}
    for c in have:
        for year in range(1998, 2003):
            days = [dt.date(year, 10, 15) + dt.timedelta(k) for k in range(98)]
            days = [t for t in days if a <= t <= b]
            if not days:
                continue
            v = [have[c].get(t) for t in days]
            text = "".join("-" if x is None else "w" if x >= 5 else "d" for x in v)
            runs = [len(r) for r in text.replace("-", " ").replace("w", " ").split()]
            expected[c, year] = (sum(x is not None for x in v), float(max(runs, default=0)), float(sum(r // 2 for r in runs)), float(text.count("w")))
    got = {}
    for k, name in enumerate(("LongDS", "NumDS", "NumWD")):
        for r in season.index(obs, ["cell"], name, s).collect():
            got.setdefault((r["cell"], r["season_year"]), [r["n_valid"]]).append(r["value"])
    assert {k: tuple(v) for k, v in got.items()} == expected


def test_steps_are_those_of_all_keys(spark):
    """Completeness by the times that any key has, in periods of every length."""
    rows = [(c, dt.date(2001, 1, 1) + dt.timedelta(k), 1.0) for c in range(2) for k in range(365) if (k + c) % 2 == 0 and k != 100]
    obs = spark.createDataFrame(rows, "cell int, time date, precip double")
    for res, count in (("annual", 364), ("monthly", None)):
        full = resample.resample(obs, ["cell"], "precip", res, "sum", mode="R1", min_frac=0.5)
        if count:
            assert [r["n_valid"] for r in full.orderBy("cell").collect()] == [182, 182]
            assert all(r["precip"] is None for r in resample.resample(obs, ["cell"], "precip", res, "sum", mode="R1", min_frac=0.51).collect())
    assert resample.resample(obs, ["cell"], "precip", "annual", "sum", min_frac=364.5 / 365).count() == 0


def test_trend_of_large_means(spark):
    rows = [(0, 1995 + k, 1.0e9 + v) for k, v in enumerate([1.0, 3.0, 2.0, 5.0, 4.0])]
    plain = [(0, y, v - 1.0e9) for _, y, v in rows]
    get = lambda r: climatology.trend(spark.createDataFrame(r, "cell int, year int, v double"), ["cell"], "v", 1995, 1999, 3).first()
    for m in ("slope", "sigma", "r2", "p_value_slope"):
        assert abs(get(rows)[m] - get(plain)[m]) < 1e-6
