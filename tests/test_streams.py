"""Streams that are joined and that keep state of their own, against batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skyweave.operators import derive, season
from skyweave.streaming import derived

D0 = dt.date(2001, 10, 1)
ROWS = "time date, lat_i int, lon_i int, lat double, lon double, value double"


def test_et0_from_three_streams(spark, tmp_path):
    draw = random.Random(2)
    cells = [(0, 0, -2.0, 30.0), (0, 1, -2.0, 30.5)]
    every = {v: [(D0 + dt.timedelta(d), *c, lo + draw.random() * 10) for d in range(40) for c in cells] for v, lo in (("tmin", 10.0), ("tmax", 22.0), ("precip", 0.0))}
    every["tmin"] = [r for r in every["tmin"] if r[0].day != 7]  # a day that one stream never brings
    # Each stream in its own order: within ten days all get what they need.
    for v, rows in every.items():
        parts = [[] for _ in range(5)]
        for r in rows:
            k = min(4, max(0, (r[0] - D0).days // 8 + draw.choice([-1, 0, 1])))
            parts[k].append(r)
        for p in parts:
            draw.shuffle(p)
        for k, p in enumerate(parts):
            spark.createDataFrame(p, ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{v}-{k}")
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for k in range(5):
        for v in every:
            spark.read.schema(ROWS).parquet(f"{tmp_path}/{v}-{k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{v}")
        three = [spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in/{v}") for v in ("tmin", "tmax", "precip")]
        derived.et0(*three, late="30 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    got = {(r["time"], r["lat_i"], r["lon_i"]): r["value"] for r in spark.read.parquet(out).collect()}
    whole = derive.et0_inputs(*[spark.createDataFrame(every[v], ROWS).withColumnRenamed("value", v) for v in ("tmin", "tmax", "precip")])
    value = derive.et0_modified(F.col("tmin"), F.col("tmax"), F.col("precip"), derive.radiation_on(F.col("time"), F.col("lat")))
    want = {(r["time"], r["lat_i"], r["lon_i"]): r["x"] for r in whole.withColumn("x", value).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) == 2 * 38
    assert spark.read.parquet(out).count() == len(got)


@pytest.mark.parametrize("name", ["NumDS", "LongWS"])
def test_spells_of_a_stream(spark, tmp_path, name):
    draw = random.Random(7)
    rows = [(dt.date(2001, 9, 1) + dt.timedelta(d), i, 0, 0.0, 0.0, draw.choice([0.0, 0.0, 5.0, 30.0, None])) for d in range(620) for i in range(2) if draw.random() < 0.95]
    # In lots of twenty days, each stirred with the next.
    rows = sorted(rows, key=lambda r: (r[0] - D0).days // 20 + draw.random() * 1.5)
    size = -(-len(rows) // 4)
    s = season.Season(1015, 120, threshold=4.0, spell=2, min_frac=0.5)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    lots = [rows[k * size : (k + 1) * size] for k in range(4)] + [rows[-1:]]  # what a batch moves on is acted on in the next
    for lot in lots:
        spark.createDataFrame(lot, ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in")
        derived.spells(stream, name, s, "60 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r["lat_i"], r["season_year"]): (r["n_valid"], r["value"]) for r in spark.read.parquet(out).collect()}
    batch = season.index(spark.createDataFrame(rows, ROWS).withColumnRenamed("value", "precip"), ["lat_i", "lon_i"], name, s)
    want = {(r["lat_i"], r["season_year"]): (r["n_valid"], r["value"]) for r in batch.collect()}
    assert got == {k: v for k, v in want.items() if k[1] in (2001, 2002)} and len(got) == 4
    with pytest.raises(ValueError):
        derived.spells(stream, "TotRain", s)
