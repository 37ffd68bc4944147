"""Results that are kept, climatologies that grow, summed-area tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skyweave.operators import climatology, summed, support
from skyweave.operators.season import Season
from skyweave.plans import incremental, results, specs
from skyweave.sources import grid


def store_of(spark, path, years):
    draw = random.Random(years[0])
    rows, d = [], dt.date(years[0], 1, 1)
    while d.year <= years[-1]:
        rows += [("d", "daily", v, d, i, j, -2.0 + 0.5 * i, 30.0 + 0.5 * j, float(draw.randint(0, 40))) for v in ("precip", "tmax") for i in range(2) for j in range(2)]
        d += dt.timedelta(1)
    grid.append_unseen(spark.createDataFrame(rows, grid.OBS), path)


def test_a_request_is_computed_once(spark, tmp_path, monkeypatch):
    store, folder = str(tmp_path / "s"), str(tmp_path / "r")
    store_of(spark, store, [1999, 2000])
    made = []
    plain = results.Engine.climatology
    monkeypatch.setattr(results.Engine, "climatology", lambda self, *a: made.append(a) or plain(self, *a))

    def ask(low=-2.2, percent=(50, 95)):
        e = results.of_store(spark, store, "d", "daily", ("precip", "tmax"), -2.0, 30.0, 0.5, 0.5, rows=2, cols=2)
        r = results.Results(e, store, folder)
        return r.request("climatology", specs.Series("precip", "monthly", "1999-01-01", "2001-12-31", specs.BBox(29, low, 31, 0, True)), specs.Climatology("percentile", 1999, 2001, 1, percent=percent)), r

    first, _ = ask()
    again, r = ask(percent=(50.0, 95.0))
    assert len(made) == 1 and sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect())) and again.count() == 24
    assert store not in again._jdf.queryExecution().executedPlan().toString()
    ask(low=-2.25)
    assert len(made) == 2 and r.stale().count() == 0
    store_of(spark, store, [2001])  # another version
    later, r = ask()
    assert len(made) == 3 and r.stale().count() == 2
    assert sorted(map(tuple, later.collect())) != sorted(map(tuple, first.collect()))
    store_of(spark, store, [2001])  # nothing new came, but an append it was: computed again, the same
    same, _ = ask()
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, later.collect()))
    with pytest.raises(ValueError):
        r.request("weather")


def test_digests_tell_requests_apart(spark, tmp_path):
    e = results.Engine(spark.createDataFrame([], "time date"), 0, 0, 1, 1)
    r = results.Results(e, str(tmp_path / "s"), str(tmp_path / "r"))
    season = lambda **k: specs.SeasonIndex("NumWD", Season(101, 331, **k))
    points = lambda *p: specs.SeasonIndex("NumWD", Season(101, 331), specs.Points(tuple(p)))
    assert r.digest("season", season(threshold=2)) == r.digest("season", season(threshold=2.0)) != r.digest("season", season(threshold=3))
    assert r.digest("season", points(("A", 1, 2))) == r.digest("season", points({"lat": 2.0, "loc": "A", "lon": 1})) != r.digest("season", points(("A", 2, 1)))
    (tmp_path / "g.json").write_text('{"a": 1}')
    geo = specs.SeasonIndex("NumWD", Season(101, 331), specs.GeoJSON(str(tmp_path / "g.json"), "n"))
    before = r.digest("season", geo)
    (tmp_path / "g.json").write_text('{"a": 2}')
    assert r.digest("season", geo) != before
    assert results.Results(e, str(tmp_path / "s"), str(tmp_path / "r"), "b").digest("season", season()) != r.digest("season", season())


def yearly(draw, years):
    return [(k, s, y, draw.choice([None, round(draw.gauss(50, 20), 2)] + [float(y % 7)] * 2)) for k in range(3) for s in (1, 2) for y in years if draw.random() < 0.9]


def test_years_are_taken_in(spark, tmp_path):
    draw, path, keys = random.Random(5), str(tmp_path / "c"), ["cell", "slot"]
    frame = lambda rows: spark.createDataFrame(rows, "cell int, slot int, year int, value double")
    lots = [yearly(draw, range(1991, 2001)), yearly(draw, [2001]), yearly(draw, range(2002, 2006)) + [(9, 1, 2002, 1.0)]]
    for lot in lots:
        incremental.take_in(frame(lot), keys, path)
    incremental.take_in(frame(lots[1]), keys, path)  # a year that is there already
    lots[1] = [(*r[:3], 7.5) for r in lots[1]]
    kept = incremental.take_in(frame(lots[1]), keys, path)  # a year that is corrected
    every = frame([r for lot in lots for r in lot])
    assert sorted(map(tuple, incremental.read(spark, path).collect())) == sorted(map(tuple, kept.collect()))
    plain = incremental.state(every, keys)
    for a, b in zip(*(sorted(map(tuple, x.select(*keys, "values", "n", F.round("mean", 9), F.round("m2", 6)).collect())) for x in (kept, plain))):
        assert a == b
    for name in ("mean", "stdev", "cv", "min", "max", "median", "frequency"):
        how = {"threshold": 40.0} if name == "frequency" else {}
        same(incremental.statistic(kept, keys, name, 3, **how), climatology.climatology(every, keys, "value", name, 3, **how))
    same(incremental.statistic(kept, keys, "percentile", 3, percent=95.0), climatology.percentiles(every, keys, "value", [95.0], 3).drop("stat"))
    for exceeding, name in ((True, "probExc"), (False, "probNoExc")):
        same(incremental.statistic(kept, keys, name, 3, threshold=45.0), climatology.probability(every, keys, "value", 45.0, exceeding, min_years=3))
    assert incremental.read(spark, str(tmp_path / "none")) is None


def same(a, b):
    a, b = ({(r["cell"], r["slot"]): (r["n"], r["value"]) for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0] and (a[k][1] is None) == (b[k][1] is None) and abs((a[k][1] or 0) - (b[k][1] or 0)) < 1e-9


def test_boxes_by_four_corners(spark):
    draw = random.Random(6)
    for axes in (support.Axes(-2.0, 30.0, 0.5, 0.5, 7, 9), support.Axes(3.0, 34.0, -0.5, -0.25, 7, 9)):
        cells = [(dt.date(2001, 1, d), i, j, draw.choice([None, float(draw.randint(0, 99))])) for d in (1, 2, 9) for i in range(7) for j in range(9) if draw.random() < 0.7]
        cells += [(None, 0, 0, 5.0), (dt.date(2001, 1, 1), 70, 0, 5.0)]
        obs = axes.located(spark.createDataFrame(cells, "time date, lat_i int, lon_i int, v double"))
        ends = lambda a, s, n: sorted((a + s * draw.uniform(-1, n), a + s * draw.randint(0, n - 1)))
        asked = [(f"b{k}", *(x for p in zip(ends(axes.lon0, axes.dlon, 9), ends(axes.lat0, axes.dlat, 7)) for x in p)) for k in range(12)]
        asked = [(n, w, s, e, t) for n, w, s, e, t in asked] + [("all", -99.0, -99.0, 99.0, 99.0), ("none", 0.0, 0.0, 1.0, 1.0)]
        places = spark.createDataFrame(asked, "site string, west double, south double, east double, north double")
        table = summed.summed_area(obs, axes, ["v"])
        assert table.count() == 3 * 63
        got = {(r["site"], r["time"]): r["v"] for r in summed.box_mean(table, summed.boxes(axes, places), ["v"]).collect()}
        good = obs.where("time is not null and lat_i < 7")
        want = {(n, r["time"]): r["v"] for n, *b in asked for r in support.bbox(good, *b).groupBy("time").agg(F.avg("v").alias("v")).collect()}
        assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and abs((got[k] or 0) - (want[k] or 0)) < 1e-9 for k in want) and len(want) > 20
    with pytest.raises(ValueError):
        summed.summed_area(obs, support.Axes(0, 0, 1, 1), ["v"])
