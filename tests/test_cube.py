"""The Zarr data source: what is planned, and writes in two phases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from skyweave.operators.support import Axes
from skyweave.sources import cube, zarr

AXES = Axes(-2.0, 30.0, 0.5, 0.5, 5, 6)
D0 = dt.date(2001, 1, 1)


def rows(days, skip=()):
    return [(D0 + dt.timedelta(d), i, j, float(100 * d + 10 * i + j)) for d in days for i in range(5) for j in range(6) if (d, i, j) not in skip]


def frame(spark, data):
    return spark.createDataFrame(data, "time date, lat_i int, lon_i int, value double").repartition(3)


def kept(spark, path):
    return {(r["time"], r["lat_i"], r["lon_i"]): r["value"] for r in cube.read_cube(spark, path, "rain").collect()}


def test_round_trip_and_appends(spark, tmp_path):
    path = str(tmp_path / "z")
    assert cube.append_cube(frame(spark, rows(range(8), {(3, 1, 1)})), path, "rain", AXES, (5, 2, 4), "<f8") == 8
    assert cube.append_cube(frame(spark, rows(range(4, 13))), path, "rain", AXES) == 5  # the chunk of steps 5 to 9 is filled up
    assert cube.append_cube(frame(spark, rows(range(13))), path, "rain", AXES) == 0
    want = {r[:3]: r[3] for r in rows(range(13))} | {(D0 + dt.timedelta(3), 1, 1): None}
    assert kept(spark, path) == want
    assert {(r["time"], r["lat_i"], r["lon_i"]): r["value"] for r in zarr.read_zarr(spark, path, "rain").collect()} == want
    one = cube.read_cube(spark, path, "rain").where("lat_i = 2 and lon_i = 5").first()
    assert one["lat"] == -1.0 and one["lon"] == 32.5


def test_conditions_decide_what_is_opened(spark, tmp_path):
    path = tmp_path / "z"
    cube.append_cube(frame(spark, rows(range(20))), str(path), "rain", AXES, (5, 2, 4), "<f8")
    every = sorted(p for p in (path / "rain").iterdir() if not p.name.startswith("."))
    assert len(every) == 4 * 3 * 2
    reader = cube.Reader({"path": str(path), "variable": "rain"})
    asked = [GreaterThanOrEqual(("time",), D0 + dt.timedelta(6)), LessThan(("time",), D0 + dt.timedelta(9)), In(("lat",), (-2.0, -1.5)), EqualTo(("lon_i",), 5)]
    assert list(reader.pushFilters(asked)) == asked
    assert [p.places for p in reader.partitions()] == [[(1, 0, 1)]]
    for p in every:  # what need not be opened cannot be
        if p.name != "1.0.1":
            p.write_bytes(b"not a chunk")
    a, b = D0 + dt.timedelta(6), D0 + dt.timedelta(8)
    want = sorted(r for r in rows(range(6, 9)) if r[1] < 2 and r[2] == 5)
    found = cube.read_cube(spark, str(path), "rain").where(F.col("time").between(a, b) & F.col("lat").between(-2.2, -1.4) & (F.col("lon") == 32.5))
    assert sorted((r["time"], r["lat_i"], r["lon_i"], r["value"]) for r in found.collect()) == want
    other = zarr.read_zarr(spark, str(path), "rain", start=str(a), end=str(b), box=(32.4, -2.2, 32.6, -1.4))
    assert sorted((r["time"], r["lat_i"], r["lon_i"], r["value"]) for r in other.collect()) == want
    assert cube.read_cube(spark, str(path), "rain").where("lat > 80").count() == 0 == zarr.read_zarr(spark, str(path), "rain", start="2020-01-01").count()


def test_a_task_that_dies_leaves_nothing(spark, tmp_path):
    path = tmp_path / "z"
    cube.append_cube(frame(spark, rows(range(7))), str(path), "rain", AXES, (5, 2, 4), "<f8")
    before = {p: p.read_bytes() for p in path.rglob("*") if p.is_file()}
    bad = frame(spark, rows(range(20)))
    dies = bad.withColumn("value", F.when((F.col("lat_i") == 4) & (F.col("time") == D0 + dt.timedelta(15)), F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        cube.append_cube(dies, str(path), "rain", AXES)
    assert {p: p.read_bytes() for p in path.rglob("*") if p.is_file()} == before
    assert cube.append_cube(bad, str(path), "rain", AXES) == 13
    assert kept(spark, str(path)) == {r[:3]: r[3] for r in rows(range(20))}


def test_a_commit_that_is_cut_short_is_made_up_for(spark, tmp_path, monkeypatch):
    """Chunks are in place, the description is not: nothing is seen, and the
    next run leaves what one run would."""
    path = tmp_path / "z"
    cube.append_cube(frame(spark, rows(range(7))), str(path), "rain", AXES, (5, 2, 4), "<f8")
    meta = (path / "rain" / ".zarray").read_bytes()
    cube.append_cube(frame(spark, rows(range(7, 12))), str(path), "rain", AXES)
    (path / "rain" / ".zarray").write_bytes(meta)
    assert kept(spark, str(path)) == {r[:3]: r[3] for r in rows(range(7))}
    assert cube.append_cube(frame(spark, rows(range(12))), str(path), "rain", AXES) == 5
    assert kept(spark, str(path)) == {r[:3]: r[3] for r in rows(range(12))}


def test_odd_rows(spark, tmp_path):
    path = str(tmp_path / "z")
    odd = [(None, 0, 0, 1.0), (D0, 9, 0, 1.0), (D0, 0, -1, 1.0), (D0, 1, 1, 5.0), (D0, 1, 1, 7.0), (D0, 1, 1, None), (D0, 2, 2, float("nan"))]
    assert cube.append_cube(frame(spark, []), path, "rain", AXES) == 0
    assert cube.append_cube(frame(spark, odd), path, "rain", AXES) == 1
    found = kept(spark, path)
    assert found.pop((D0, 1, 1)) == 7.0 and set(found.values()) == {None} and len(found) == 29
    with pytest.raises(ValueError):
        cube.append_cube(frame(spark, rows([1])), path, "rain", Axes(0, 0, 1, 1))
    with pytest.raises(ValueError):
        cube.append_cube(frame(spark, rows([1])), path, "rain", Axes(0, 0, 1, 1, 4, 4))
    with pytest.raises(Exception, match="no array"):
        cube.read_cube(spark, path, "snow").count()
