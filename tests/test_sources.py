import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from skyweave.operators import derive
from skyweave.plans import materialise, specs
from skyweave.plans.engine import Engine, materialise_climatologies
from skyweave.operators.season import Season
from skyweave.sources import grid, places, sinks
from skyweave.streaming import ingest

SF = "/root/testdata/sf0.001"


def obs_rows(spark, days):
    rows = [("d", "daily", "precip", dt.date(2001, 1, k), i, 0, float(i), 0.0, float(k)) for k in days for i in range(3)]
    return spark.createDataFrame(rows, grid.OBS)


def test_store_appends_only_unseen_times(spark, tmp_path):
    store = str(tmp_path / "store")
    grid.append_unseen(obs_rows(spark, range(1, 11)), store)
    grid.append_unseen(obs_rows(spark, range(5, 16)), store)
    kept = grid.read_obs(spark, store, "d", "daily", "precip")
    assert kept.count() == 45 and grid.read_obs(spark, store, "d", "daily", "precip", "2001-01-03", "2001-01-04").count() == 6
    assert "PartitionFilters" in kept._jdf.queryExecution().executedPlan().toString()


def test_parts_of_a_step_are_all_kept(spark, tmp_path):
    """A time that comes in two parts loses neither; a second run adds
    nothing; the lookup reads the years that come in."""
    store = str(tmp_path / "store")
    rows = obs_rows(spark, range(1, 4))
    for part in (rows.where("lat_i < 2"), rows.where("lat_i > 0"), rows):
        grid.append_unseen(part, store)
    kept = grid.read_obs(spark, store, "d", "daily", "precip")
    assert kept.count() == 9 == kept.select("time", "lat_i").distinct().count()
    with pytest.raises(Exception, match="NOT_FOUND|not found|CANNOT|cannot"):
        grid.append_unseen(rows.select("time"), store)


def test_one_field(spark, tmp_path):
    store = str(tmp_path / "store")
    assert grid.field(spark, store, "d", "daily", "precip", "2001-01-02") is None
    grid.append_unseen(obs_rows(spark, range(1, 4)), store)
    assert grid.field(spark, store, "d", "daily", "precip", "2001-01-02").count() == 3
    assert [r["lat_i"] for r in grid.field(spark, store, "d", "daily", "precip", "2001-01-02", (-1, 0.5, 1, 1.5)).collect()] == [1]
    assert grid.field(spark, store, "d", "daily", "precip", "2002-01-02") is None and grid.field(spark, store, "d", "daily", "tmin", "2001-01-02") is None


def test_running_totals(spark, tmp_path):
    """Totals of whole months, each given out once, when a month has come that
    ends long enough after it; a late row counts while its month is open."""
    def month(k, days=28):
        return [("d", "daily", "precip", dt.date(2001, k, x), i, 0, float(i), 0.0, 1.0) for x in range(1, days + 1) for i in range(2)]

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [month(1, 20), month(2), month(1)[40:56], month(3), month(4), month(1, 3), month(5)]
    for rows in batches:
        spark.createDataFrame(rows, grid.OBS).coalesce(1).write.mode("append").parquet(source)
        stream = ingest.running_totals(ingest.read_stream(spark, source, grid.OBS), "monthly", "40 days")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["period"].isoformat(), r["lat_i"], r["value"], r["n_valid"]) for r in spark.read.parquet(out).collect())
    assert got[:4] == [("2001-01-01", 0, 28.0, 28), ("2001-01-01", 1, 28.0, 28), ("2001-02-01", 0, 28.0, 28), ("2001-02-01", 1, 28.0, 28)]
    assert len({x[:2] for x in got}) == len(got) and max(got)[0] < "2001-05"
    plain = ingest.running_totals(spark.createDataFrame(month(1), grid.OBS), "dekadal").collect()
    assert sorted((r["period"].day, r["value"]) for r in plain if r["lat_i"] == 0) == [(1, 10.0), (11, 10.0), (21, 8.0)]


def test_computed_variables(spark, tmp_path):
    """What is kept is what the formula gives on the days that all inputs
    have; new days are appended, old ones are not."""
    store = str(tmp_path / "store")
    rows = lambda v, days, x: [("d", "daily", v, dt.date(2001, 1, k), i, 0, 2.0 * i, 30.0, None if k == 3 and v == "tmax" else x + k) for k in days for i in range(2)]
    add = lambda r: grid.append_unseen(spark.createDataFrame(r, grid.OBS), store)
    for v, x in (("tmin", 10.0), ("tmax", 20.0), ("precip", 0.0)):
        add(rows(v, range(1, 6 if v != "precip" else 5), x))
    for _ in range(2):
        materialise.materialise(spark, store, "d", "daily", ["et0", "trange"])
    et0 = {(r["time"].day, r["lat_i"]): r["value"] for r in grid.read_obs(spark, store, "d", "daily", "et0").collect()}
    assert set(et0) == {(k, i) for k in range(1, 5) for i in range(2)} and et0[3, 0] is None
    at = spark.createDataFrame([(dt.date(2001, 1, 2), 2.0, 12.0, 22.0, 2.0)], "time date, lat double, tmin double, tmax double, precip double")
    want = at.select(derive.et0_modified(F.col("tmin"), F.col("tmax"), F.col("precip"), derive.radiation_on(F.col("time"), F.col("lat"))).alias("x")).first()["x"]
    assert abs(et0[2, 1] - want) < 1e-12
    assert {r["value"] for r in grid.read_obs(spark, store, "d", "daily", "trange").collect()} == {10.0, None}
    add(rows("precip", range(5, 6), 0.0))
    materialise.materialise(spark, store, "d", "daily", ["et0"])
    assert grid.read_obs(spark, store, "d", "daily", "et0").count() == 10


def test_resolution_of_requests():
    config = {"d": {"daily": {"precip": {}, "tmin": {}}, "dekadal": {"precip": {"input": "daily", "function": "sum"}}, "monthly": {"precip": {"input": "dekadal", "function": "sum"}, "cold": {"input": "daily/tmin", "function": "min"}, "x": {"input": "monthly"}}}}
    assert grid.resolve(config, "d", "daily", "precip") == ("daily", "precip", None)
    assert grid.resolve(config, "d", "monthly", "precip") == ("daily", "precip", "sum")
    assert grid.resolve(config, "d", "monthly", "cold") == ("daily", "tmin", "min")
    with pytest.raises(ValueError):
        grid.resolve(config, "d", "monthly", "x")
    with pytest.raises(KeyError):
        grid.resolve(config, "d", "hourly", "precip")


def test_zones_with_like_names(spark):
    import io
    import zipfile

    df = spark.createDataFrame([("z 1", 1), ("z-1", 2), ("--", 3)], "zone string, v int")
    assert sorted(zipfile.ZipFile(io.BytesIO(sinks.zip_zones(df, "zone"))).namelist()) == ["z1.csv", "z1_2.csv", "zone.csv"]


def test_stream_ingest(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    obs_rows(spark, range(1, 6)).write.parquet(str(folder / "a"))
    for part in ("a", "a"):
        stream = ingest.read_stream(spark, str(folder / part), grid.OBS)
        ingest.ingest(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert grid.read_obs(spark, store, "d", "daily", "precip").count() == 15


def test_places(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Name,x,y,z\nA,1.5,2.5,q\nB,3,4,r\n")
    assert [tuple(r) for r in places.sites_csv(spark, str(tmp_path / "p.csv")).collect()] == [("A", 1.5, 2.5), ("B", 3.0, 4.0)]
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    features = [
        {"type": "Feature", "properties": {"n": "a"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {"n": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}},
        {"type": "Feature", "properties": {"n": "c"}, "geometry": {"type": "Point", "coordinates": [1.0, 1.0]}},
        {"type": "Feature", "properties": {"n": "d"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}},
    ]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    found = places.geojson(spark, str(tmp_path / "g.json"), "n")
    assert {r["zone"]: len(r["rings"]) for r in places.geojson_zones(found).collect()} == {"a": 1, "b": 2}
    assert [tuple(r) for r in places.geojson_sites(found).collect()] == [("c", 1.0, 1.0)]


def test_dated_files(spark, tmp_path):
    for k in (1, 2, 3):
        spark.createDataFrame([(k, 0.5)], "lat_i int, value double").coalesce(1).toPandas().to_parquet(tmp_path / f"rr_20010{k}2.parquet")
    got = grid.read_dated(spark, str(tmp_path), "rr_%Y%m%-d.parquet", "lat_i bigint, value double").orderBy("time").collect()
    assert [r["time"].isoformat() for r in got] == ["2001-01-16", "2001-02-16", "2001-03-16"]
    assert grid.dated_files(spark, str(tmp_path), "rr_%Y%m%-d.parquet").count() == 3


def test_netcdf_round_trip(spark, tmp_path):
    import numpy as np

    from skyweave.sources import netcdf

    y, x = np.array([2.0, 1.0, 0.0]), np.array([10.0, 11.0])
    for k in (1, 2):
        v = np.arange(6, dtype=np.float32).reshape(3, 2) * k
        v[0, 1] = -99
        raw = netcdf.encode({"lat": 3, "lon": 2}, {"lat": (("lat",), y, {}), "lon": (("lon",), x, {}), "rr": (("lat", "lon"), v, {"_FillValue": np.float32(-99), "units": "mm"})}, {"title": "rain"})
        (tmp_path / f"rr_2001010{k}.nc").write_bytes(raw)
    found, whole = netcdf.decode(raw)
    assert whole == {"title": "rain"} and found["rr"][2]["units"] == "mm" and np.array_equal(found["rr"][1], v)
    rows = netcdf.read_fields(spark, str(tmp_path), "rr_%Y%m%d.nc", "rr").orderBy("time", "lat_i", "lon_i").collect()
    assert len(rows) == 12 and [r["value"] for r in rows[:6]] == [4.0, 5.0, 2.0, 3.0, 0.0, None] and rows[0]["lat"] == 0.0
    grid_ = spark.createDataFrame([(r["lat"], r["lon"], r["value"]) for r in rows[6:]], "lat double, lon double, rr double")
    again, _ = netcdf.decode(netcdf.field_bytes(grid_, ["rr"]))
    assert again["rr"][1].tolist() == [[8.0, 10.0], [4.0, 6.0], [0.0, -9999.0]]
    with pytest.raises(ValueError):
        netcdf.decode(b"HDF5 or what")


def test_shapefile(spark, tmp_path):
    import struct

    from skyweave.operators import support
    from skyweave.sources import shapefile

    def record(k, kind, rings):
        points = [p for r in rings for p in r]
        first, n = [], 0
        for r in rings:
            first.append(n)
            n += len(r)
        body = struct.pack("<i4d", kind, 0, 0, 0, 0) + struct.pack("<ii", len(rings), n) + struct.pack(f"<{len(first)}i", *first) + struct.pack(f"<{2 * n}d", *[c for p in points for c in p])
        return struct.pack(">ii", k, len(body) // 2) + body

    square = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
    shift = lambda d: [(a + d, b) for a, b in square]
    (tmp_path / "z.shp").write_bytes(b"\0" * 100 + record(1, 5, [square]) + record(2, 15, [shift(5)]) + record(3, 3, [square]) + record(4, 5, [shift(9)]))
    names = ["A", "B", "line", "A"]
    head = struct.pack("<B3BIHH20x", 3, 0, 0, 0, 4, 65, 9) + b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([8]) + b"\0" * 15 + b"\r"
    (tmp_path / "z.dbf").write_bytes(head + b"".join(b" " + n.encode().ljust(8) for n in names))
    zones = shapefile.read(spark, str(tmp_path / "z.shp"), "NAME")
    assert {r["zone"]: len(r["rings"]) for r in zones.collect()} == {"A": 2, "B": 1} and shapefile.fields(spark, str(tmp_path / "z.shp")) == ["NAME"]
    assert {r["loc"]: round(r["lon"], 6) for r in support.zone_points(zones).collect()} == {"A": 5.5, "B": 6.0}
    assert zones.where("zone = 'B'").first()["rings"] == [[(a + 5, b) for a, b in square]]
    for end in ("shp", "dbf"):
        (tmp_path / f"y.{end}").write_bytes((tmp_path / f"z.{end}").read_bytes())
    both = shapefile.read(spark, str(tmp_path / "*.shp"), "NAME")
    assert {r["zone"]: len(r["rings"]) for r in both.collect()} == {"A": 4, "B": 2}
    with pytest.raises(Exception, match="no field 'AGE'"):
        shapefile.read(spark, str(tmp_path / "z.shp"), "AGE").collect()


def test_names():
    from skyweave.plans import names

    of = names.of_series(specs.Series("precip", "monthly", "1995-01-01", "1996-01-01"))
    assert of.units == "mm" and [m.name for m in names.of_statistic(of, specs.Climatology("mean-stdev"))] == ["precip_mean", "precip_stdev"]
    assert names.of_anomaly(of, "percentage").units == "%" and names.file_name(of, "2001-01/x", "csv") == "precip_2001-01_x.csv"
    assert names.of_index(specs.SeasonIndex("NumWD", Season(101, 131))).units == "count"


def test_engine_over_all_supports(spark, tmp_path):
    e = Engine(grid.weather(spark, SF).cache(), grid.LAT0, grid.LON0, grid.STEP, grid.STEP)
    month = lambda s, **k: specs.Series("precip", "monthly", "1995-01-01", "2000-12-31", s, min_frac=0.0, **k)
    ring = {"z": [[(30.2, -1.8), (31.8, -1.7), (31.4, -0.2), (30.3, -0.4)]]}
    for s in (specs.Original(), specs.BBox(30.4, -1.6, 31.6, -0.4), specs.BBox(30.4, -1.6, 31.6, -0.4, True), specs.Points((("A", 30.5, -1.5),), 1), specs.Polygons(ring), specs.Polygons(ring, True)):
        assert e.raw(month(s)).count() > 0
        for stat in ("mean", "percentile", "mean-stdev", "probExc", "trend", "frequency"):
            assert e.climatology(month(s), specs.Climatology(stat, 1995, 2000, 3)).count() > 0
    box = specs.BBox(30.4, -1.6, 31.6, -0.4, True)
    anomalies = e.anomaly(month(box), "difference", specs.Climatology("mean", 1995, 2000, 3))
    assert abs(anomalies.groupBy("slot").agg(F.avg("precip" if "precip" in anomalies.columns else "value").alias("m")).agg(F.max(F.abs("m"))).first()[0]) < 0.01
    index = specs.SeasonIndex("TotRain", Season(1015, 120, min_frac=0.0), box)
    base = specs.Climatology("mean", 1995, 2000, 3)
    assert e.season(index).count() >= 6 and e.season_climatology(index, base).count() == 1 and e.season_anomaly(index, "standardized", base).count() >= 6
    for _ in range(2):
        materialise_climatologies(e, [month(box)], str(tmp_path / "clim"), 1995, 2000, 3)
    assert spark.read.parquet(str(tmp_path / "clim")).count() == 7 * 12
    assert spark.read.parquet(str(tmp_path / "clim")).select("stat").distinct().count() == 7
    materialise_climatologies(e, [month(specs.Original())], str(tmp_path / "cells"), 1995, 2000, 3)
    assert e.lookup(str(tmp_path / "cells"), "precip", "monthly", "mean", specs.Original()).count() == 300
    assert e.lookup(str(tmp_path / "cells"), "precip", "monthly", "95%", box).count() == 12
    assert e.info().first()["n_times"] > 2000


def test_specs_say_no():
    for wrong in (lambda: specs.Series("snow", "monthly", "1995-01-01", "1996-01-01"), lambda: specs.Series("precip", "monthly", "1996-13-01", "1996-01-01"), lambda: specs.Climatology("mode"), lambda: specs.BBox(1, 1, 0, 0), lambda: specs.Climatology("mean", 2000, 2001, 30), lambda: specs.check_anomaly("spi")):
        with pytest.raises(ValueError):
            wrong()
    assert specs.formats(specs.BBox(0, 0, 1, 1, True)) == ("cdt", "json") and "csv" in specs.formats(specs.Original())


def test_sinks(spark):
    df = spark.createDataFrame([("z 1", 1.0), ("z 2", None)], "zone string, v double")
    import io
    import zipfile

    assert sorted(zipfile.ZipFile(io.BytesIO(sinks.zip_zones(df, "zone"))).namelist()) == ["z1.csv", "z2.csv"]
    with pytest.raises(ValueError):
        sinks.zip_zones(df, "zone", 1)
    g = spark.createDataFrame([("2001", 0.0, 1.0, 2.345), ("2001", 0.0, 0.0, None)], "label string, lat double, lon double, v double")
    assert json.loads(sinks.json_grid(g, "v").first()["json"])["v"] == [-9999.0, 2.35]
    sites = spark.createDataFrame([("A", 1.0, 2.0)], places.SITES)
    clim = spark.createDataFrame([("A", 2, "mean", 4.0), ("A", 1, "mean", None), ("A", 1, "stdev", 0.5)], "site string, slot int, stat string, value double")
    assert json.loads(sinks.json_climatology(clim, sites).first()["json"])["Values"] == {"mean": [-9999.0, 4.0], "stdev": [0.5]}
    c = g.withColumn("stat", F.lit("mean")).withColumnRenamed("v", "value")
    assert sinks.climatology_columns(c, ["mean"]).count() == 2


def test_two_decimals_of_the_exact_value(spark):
    ties = [k / 200 for k in range(-2001, 2001, 2)]
    near = [math.nextafter(x, way) for x in ties for way in (-math.inf, math.inf)]
    other = [0.0, -0.0, -0.001, 5e-324, 0.9999999999999999, -9999.0, 2.0**43 + 0.125, 2.0**46 + 0.046875, 2.0**53, 2.0**62]
    values = ties + near + other
    found = spark.createDataFrame([(x,) for x in values], "x double").select(sinks.two_decimals(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in found] == [f"{x:.2f}" for x in values]
    odd = spark.sql("SELECT explode(array(double('NaN'), double('Infinity'), 1e20D, NULL)) AS x").select(sinks.two_decimals(F.col("x")).alias("t"), F.format_string("%.2f", "x").alias("u")).collect()
    assert len(odd) == 4 and all(r["t"] == r["u"] for r in odd)


def test_responses(spark, tmp_path):
    from skyweave.plans import responses

    e = Engine(grid.weather(spark, SF), grid.LAT0, grid.LON0, grid.STEP, grid.STEP)
    month = lambda s: specs.Series("precip", "monthly", "1996-01-01", "1996-03-31", s, min_frac=0.0)
    box, mean = specs.BBox(30.4, -1.6, 31.6, -0.4), specs.BBox(30.4, -1.6, 31.6, -0.4, True)
    ring = specs.Polygons({"z": [[(30.2, -1.8), (31.8, -1.7), (31.4, -0.2), (30.3, -0.4)]]}, True)
    base = specs.Climatology("trend", 1995, 2000, 3)
    csv = responses.respond(e, "csv", "raw", month(box))
    assert csv.rows.columns == ["label", "Latitude", "Longitude", "value"] and csv.mime == "text/csv" and csv.name.endswith(".csv")
    csv.write(str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == csv.rows.count() > 20
    cdt = responses.respond(e, "cdt", "raw", month(ring)).rows.collect()
    assert [r["Name"] for r in cdt][:3] == ["Longitude", "Latitude", "1996-01"] and abs(float(cdt[0]["z"]) - 31) < 0.2
    found = responses.respond(e, "json", "climatology", month(mean), specs.Climatology("percentile", 1995, 2000, 1, percent=(5, 50)))
    values = json.loads(found.rows.first()["json"])["Values"]
    assert set(values) == {"5%", "50%"} and len(values["5%"]) == 3 and found.name.endswith(".json")
    found.write(str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    index = specs.SeasonIndex("TotRain", Season(301, 531, min_frac=0.0), ring)
    labels = json.loads(responses.respond(e, "json", "season", index).rows.first()["json"])["Dates"]
    assert labels[0] == "1995-03-01_1995-05-31"
    whole = specs.SeasonIndex("TotRain", Season(301, 531, min_frac=0.0), box)
    assert {"slope", "r2"} < set(responses.respond(e, "csv", "season_climatology", whole, base).rows.columns)
    assert json.loads(responses.respond(e, "json", "season_climatology", whole, specs.Climatology("mean", 1995, 2000, 3)).rows.first()["json"])["label"] == "1995-2000_mean"
    for form, kind, s in (("cdt", "raw", month(box)), ("csv", "raw", month(mean)), ("netcdf", "raw", month(box)), ("cdt", "climatology", month(mean))):
        with pytest.raises(ValueError):
            responses.respond(e, form, kind, s, base)
