"""A store's layout and its manifest."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skyweave.sources import grid, manifest

D0 = dt.date(2000, 1, 1)


def obs(spark, cells, variable="precip"):
    """``cells``: (day, row, column) each."""
    rows = [("d", "daily", variable, D0 + dt.timedelta(d), i, j, -2.0 + 0.5 * i, 30.0 + 0.5 * j, float(d + i)) for d, i, j in cells]
    return spark.createDataFrame(rows, grid.OBS)


def kept(spark, store, variable="precip"):
    return sorted(((r["time"] - D0).days, r["lat_i"], r["lon_i"]) for r in grid.read_obs(spark, store, "d", "daily", variable).collect())


def test_unseen_by_bits(spark, tmp_path):
    store, draw = str(tmp_path / "s"), random.Random(3)
    every = [(d, i, j) for d in (0, 59, 60, 61, 121, 365, 366, 730, 731) for i in (0, 7, 8, 20) for j in (3, 63, 64)]
    have: set = set()
    for _ in range(3):
        part = draw.sample(every, 40)
        grid.append_unseen(obs(spark, part), store)
        have |= set(part)
        assert kept(spark, store) == sorted(have)
    assert not set(kept(spark, store, "tmin"))
    grid.append_unseen(obs(spark, every[:5], "tmin"), store)  # another variable has its own
    assert len(kept(spark, store, "tmin")) == 5
    left = manifest.missing(obs(spark, every), manifest.read(spark, store))
    assert {((r["time"] - D0).days, r["lat_i"], r["lon_i"]) for r in left.collect()} == set(every) - have


def test_no_row_is_read_to_append(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "s")
    grid.append_unseen(obs(spark, [(1, 0, 0)]), store)
    monkeypatch.setattr(manifest, "repair", lambda *_: 0)
    plans = []
    plain = grid.write_obs
    monkeypatch.setattr(grid, "write_obs", lambda df, path: (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df, path)))
    grid.append_unseen(obs(spark, [(1, 0, 0), (2, 0, 0)]), store)
    assert plans[0].count("FileScan parquet") == 1 and "ReadSchema: struct<block:bigint,cells:bigint," in plans[0]
    assert kept(spark, store) == [(1, 0, 0), (2, 0, 0)]


def test_an_append_that_was_cut_short(spark, tmp_path, monkeypatch):
    """Rows are there, their bitmaps are not: running it again adds none."""
    store, rows = str(tmp_path / "s"), [(d, i, 0) for d in range(5) for i in range(3)]
    grid.append_unseen(obs(spark, rows[:6]), store)
    monkeypatch.setattr(manifest, "_keep", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        grid.append_unseen(obs(spark, rows), store)
    monkeypatch.undo()
    grid.append_unseen(obs(spark, rows), store)
    assert kept(spark, store) == sorted(rows) and manifest.repair(spark, store) == 0


def test_a_store_without_a_manifest(spark, tmp_path):
    store = str(tmp_path / "s")
    grid.write_obs(obs(spark, [(0, 0, 0), (1, 0, 0)]), store)
    grid.append_unseen(obs(spark, [(1, 0, 0), (2, 0, 0)]), store)
    assert kept(spark, store) == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]


def test_coverage_and_compact(spark, tmp_path):
    store = str(tmp_path / "s")
    assert manifest.coverage(manifest.read(spark, store)).count() == 0
    cells = [(d, i, j) for d in range(40) for i in range(10) for j in range(12) if d != 7]
    for k in range(3):
        grid.append_unseen(obs(spark, cells[k::3] + cells[:9]), store)
    one = manifest.compact(spark, store)
    assert one.count() == 4 < manifest.read(spark, store).count()  # two by two blocks, all cells alike
    assert manifest.missing(obs(spark, cells), one).count() == 0
    got = manifest.coverage(one).first()
    want = grid.info(grid.read_obs(spark, store, "d", "daily", "precip"), ["dataset"]).first()
    assert {c: got[c] for c in want.asDict()} == want.asDict() and got["n_rows"] == len(cells) and got["n_times"] == 39


def test_morton_layout(spark, tmp_path):
    """Files grow in number with rows, and a box has few of them."""
    i, j = F.col("lat_i"), F.col("lon_i")
    z = {(r["lat_i"], r["lon_i"]): r["z"] for r in spark.range(64).selectExpr("cast(id div 8 as int) lat_i", "cast(id % 8 as int) lon_i").withColumn("z", grid.morton(i, j)).collect()}
    assert sorted(z.values()) == list(range(64)) and z[0, 1] == 2 and z[1, 0] == 1 and z[3, 5] == 0b100111
    store = str(tmp_path / "s")
    field = spark.range(64 * 64 * 4).selectExpr(
        "'d' dataset", "'daily' res", "'precip' variable", "date_add(date'2001-01-01', cast(id % 4 as int)) time", "cast(id div 4 div 64 as int) lat_i", "cast(id div 4 % 64 as int) lon_i"
    ).selectExpr("*", "lat_i / 2D lat", "lon_i / 2D lon", "1D value")
    grid.write_obs(field, store, rows_a_file=512)
    files = spark.read.parquet(store).withColumn("_f", F.input_file_name())
    assert files.select("_f").distinct().count() >= 32
    boxes = files.groupBy("_f").agg(F.min(i).alias("a"), F.max(i).alias("b"), F.min(j).alias("c"), F.max(j).alias("d")).collect()
    touched = [r for r in boxes if r["a"] < 8 and r["c"] < 8 and r["b"] >= 0 and r["d"] >= 0]
    assert len(touched) <= 4 and max((r["b"] - r["a"] + 1) * (r["d"] - r["c"] + 1) for r in boxes) <= 1024
