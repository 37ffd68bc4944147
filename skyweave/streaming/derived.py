"""What follows from observations as they arrive: evapotranspiration from
three streams, spells of a season from one."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skyweave.functions import calendar as C
from skyweave.operators import derive as D
from skyweave.operators.season import Season
from skyweave.session import ship

CELL = ["lat_i", "lon_i"]
#: Keeps state on disk, which custom state needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def et0(tmin: DataFrame, tmax: DataFrame, precip: DataFrame, late: str = "30 days", res: str = "daily") -> DataFrame:
    """``(at, time, lat_i, lon_i, lat, lon, value)``: reference
    evapotranspiration for each time and cell as soon as all three streams,
    ``(time, lat_i, lon_i, lat, lon, value)`` each, have brought it, in
    whatever order.

    A row waits for the others until times ``late`` after its own have come in
    every stream; then its state is dropped, and it stays without a value.
    Rows without a time wait for nothing. A stream that brings a time and cell
    twice gives two values."""

    def part(stream: DataFrame, name: str, more: tuple = ()) -> DataFrame:
        rows = stream.select(F.col("time").cast("timestamp").alias("at"), *CELL, *more, F.col("value").alias(name))
        return rows.where(F.col("at").isNotNull()).withWatermark("at", late)

    key = ["at", *CELL]
    met = part(tmax, "tmax", ("lat", "lon")).join(part(tmin, "tmin"), key).join(part(precip, "precip"), key)
    met = met.withColumn("time", F.col("at").cast("date"))
    value = D.et0_modified(F.col("tmin"), F.col("tmax"), F.col("precip"), D.radiation_on(F.col("time"), F.col("lat"), res), res)
    return met.select("at", "time", *CELL, "lat", "lon", value.alias("value"))


class Spells(StatefulProcessor):
    """State: for each day of the season, 0 nothing yet, 1 a null, 2 a value, 3
    a value that is part of a spell. It is told when the season is over."""

    def __init__(self, wet: bool, longest: bool, threshold: float, spell: int, first: int, last: int, min_frac: float):
        self.wet, self.longest, self.threshold, self.spell = wet, longest, threshold, spell
        self.first, self.last, self.min_frac = first, last, min_frac

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getValueState("days", "days binary")

    def _span(self, year: int) -> tuple[dt.date, int]:
        """The season's first day, and its days."""

        def day(y: int, md: int) -> dt.date:
            last = (dt.date(y + md // 1200, md // 100 % 12 + 1, 1) - dt.timedelta(1)).day
            return dt.date(y, md // 100, min(md % 100, last))

        start = day(year, self.first)
        return start, (day(year if self.first <= self.last else year + 1, self.last) - start).days + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, length = self._span(key[2])
        if self.days.exists():
            days = np.frombuffer(self.days.get()[0], np.uint8).copy()
        else:
            days = np.zeros(length, np.uint8)
            over = pd.Timestamp(start + dt.timedelta(length), tz="UTC")
            self.handle.registerTimer(int(over.timestamp() * 1000))
        for part in rows:
            at = (pd.to_datetime(part["time"]) - pd.Timestamp(start)).dt.days.to_numpy()
            v = part["v"].to_numpy(float, na_value=np.nan)
            hit = (v >= self.threshold) if self.wet else (v < self.threshold)
            np.maximum.at(days, at, np.where(np.isnan(v), 1, np.where(hit, 3, 2)).astype(np.uint8))
        self.days.update((days.tobytes(),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        days = np.frombuffer(self.days.get()[0], np.uint8)
        self.days.clear()
        edge = np.flatnonzero(np.diff(np.concatenate(([0], days == 3, [0])).astype(np.int8)))
        runs = edge[1::2] - edge[::2]
        valid = int((days >= 2).sum())
        value = float(runs.max(initial=0)) if self.longest else float((runs // self.spell).sum())
        good = valid / len(days) >= self.min_frac
        yield pd.DataFrame({"lat_i": [key[0]], "lon_i": [key[1]], "season_year": [key[2]], "n_valid": [valid], "value": [value if good else None]}).astype({"lat_i": "int32", "lon_i": "int32", "season_year": "int32", "value": "float64"})

    def close(self) -> None:
        pass


OUT = "lat_i int, lon_i int, season_year int, n_valid long, value double"


def spells(stream: DataFrame, name: str, season: Season, late: str = "30 days") -> DataFrame:
    """``(lat_i, lon_i, season_year, n_valid, value)``: index ``NumDS``,
    ``NumWS``, ``LongDS`` or ``LongWS`` of ``stream(time, lat_i, lon_i,
    value)`` by cell and season, given out once, when times have come that are
    ``late`` after the season's end. As :func:`season.index` of the rows of
    whole seasons.

    Days may come in any order, and in several batches; of a day that comes
    twice, a value counts before a null, and one in a spell before others. What
    comes after its season was given out is left out, as are rows without a
    time. A cell's state is a byte a day of its open seasons. Needs the state
    store :data:`ROCKS`, which is set if no other is chosen."""
    if name not in ("NumDS", "NumWS", "LongDS", "LongWS"):
        raise ValueError(f"no spells {name!r}")
    spark = stream.sparkSession
    ship(spark)
    rocks(spark)
    rows = stream.withColumn("at", F.col("time").cast("timestamp")).withWatermark("at", late)
    # Told by the watermark's own column, or Spark would pick out seasons first, and the time between them would not move it.
    rows = rows.where(F.col("at").isNotNull() & C.in_season(F.col("at").cast("date"), season.first, season.last))
    rows = rows.select("at", *CELL, C.season_year(F.col("time"), season.first, season.last).cast("int").alias("season_year"), "time", F.col("value").cast("double").alias("v"))
    made = Spells(name.endswith("WS"), name.startswith("Long"), season.threshold, season.spell, season.first, season.last, season.min_frac)
    return rows.groupBy(*CELL, "season_year").transformWithStateInPandas(made, OUT, "append", "EventTime")


def rocks(spark: SparkSession) -> None:
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
