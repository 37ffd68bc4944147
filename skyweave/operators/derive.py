"""Derived variables: mean temperature, radiation, evapotranspiration, and
values on another grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions import calendar as C

CELL = ["lat_i", "lon_i"]

# Coefficients of the modified form of evapotranspiration by day and by coarser steps, and of that of FAO.
DAILY = (0.0019, 21.0584, 0.0874, 0.6278)
COARSER = (0.0013, 17.0, 0.0123, 0.76)
FAO = (0.0023, 17.8)


def tmean(tmin: DataFrame, tmax: DataFrame) -> DataFrame:
    """Mean of the two, on all times that either has; missing if one is."""
    both = tmin.select("time", *CELL, "tmin").join(tmax.select("time", *CELL, "tmax"), ["time", *CELL], "full_outer")
    return both.withColumn("tmean", (F.col("tmin") + F.col("tmax")) / 2)


def trange(tmin: DataFrame, tmax: DataFrame) -> DataFrame:
    """The daily range, on all times that either has; missing if one is, and 0
    where the two are the wrong way round."""
    both = tmin.select("time", *CELL, "tmin").join(tmax.select("time", *CELL, "tmax"), ["time", *CELL], "full_outer")
    return both.withColumn("trange", F.when(F.col("tmin").isNotNull() & F.col("tmax").isNotNull(), F.greatest(F.col("tmax") - F.col("tmin"), F.lit(0.0))))


def radiation(doy: Column, lat: Column) -> Column:
    """Extraterrestrial radiation at latitude ``lat`` in degrees, MJ/m2/day.
    Where the sun does not set or rise, the hour angle is clipped."""
    phi, f = F.radians(lat), 2 * math.pi * doy / 365
    dr = 1 + 0.033 * F.cos(f)
    delta = 0.409 * F.sin(f - 1.39)
    ws = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(phi) * F.tan(delta))))
    return F.greatest(37.58603 * dr * (ws * F.sin(phi) * F.sin(delta) + F.cos(phi) * F.cos(delta) * F.sin(ws)), F.lit(0.0))


def radiation_on(time: Column, lat: Column, res: str = "daily") -> Column:
    """Radiation of the day that stands for ``time``: in leap years days after
    February count one less, and 29 February is the 28th. Dekads have days 6,
    16 and 26, pentads 3, 8, … 28, months the 16th."""
    day = {
        "daily": time,
        "pentadal": F.date_add(C.month_start(time), F.least(F.lit(5), F.floor((F.day(time) - 1) / 5)).cast("int") * 5 + 2),
        "dekadal": C.stamp(C.period_start(time, "dekadal"), "dekadal"),
        "monthly": C.stamp(C.month_start(time), "monthly"),
    }[res]
    return radiation(C.slot(day, "daily"), lat)


def et0_modified(tmin: Column, tmax: Column, precip: Column, ra: Column, res: str = "daily") -> Column:
    """Reference evapotranspiration, modified Hargreaves with rain; monthly
    and coarser steps have coefficients of their own."""
    c1, c2, c3, c4 = DAILY if res == "daily" else COARSER
    spread = F.greatest(tmax - tmin, F.lit(0.0))
    whole = tmin.isNotNull() & tmax.isNotNull() & precip.isNotNull()
    return F.when(whole, c1 * 0.408 * ra * ((tmax + tmin) / 2 + c2) * F.pow(F.greatest(spread - c3 * precip, F.lit(0.0)), F.lit(c4)))


def et0_fao(tmin: Column, tmax: Column, ra: Column) -> Column:
    """Reference evapotranspiration, Hargreaves as FAO has it."""
    whole = tmin.isNotNull() & tmax.isNotNull()
    return F.when(whole, FAO[0] * 0.408 * ra * ((tmax + tmin) / 2 + FAO[1]) * F.sqrt(F.greatest(tmax - tmin, F.lit(0.0))))


def et0_inputs(tmin: DataFrame, tmax: DataFrame, precip: DataFrame) -> DataFrame:
    """The three on the times and cells that all have, none where none is."""
    return tmax.select("time", *CELL, "lat", "lon", "tmax").join(tmin.select("time", *CELL, "tmin"), ["time", *CELL]).join(precip.select("time", *CELL, "precip"), ["time", *CELL])


def regrid(obs: DataFrame, target: DataFrame, value: str, lat0: float, lon0: float, dlat: float, dlon: float, by: list[str]) -> DataFrame:
    """Bilinear values at the cells of ``target(lat_i, lon_i, lat, lon)``.

    Each target cell meets its four neighbours on the source's regular axes in
    one equi-join; their weights follow from its coordinates. Outside the
    source's centres, or where a neighbour that has weight is missing, null."""
    row, col = (F.col("lat") - lat0) / dlat, (F.col("lon") - lon0) / dlon
    corner = target.select(F.col("lat_i").alias("to_lat_i"), F.col("lon_i").alias("to_lon_i"), "lat", "lon", row.alias("_r"), col.alias("_c"))
    pick = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    part = lambda x, k: F.when(F.col(k) == 0, 1 - (F.col(x) - F.floor(x))).otherwise(F.col(x) - F.floor(x))
    corners = corner.withColumn("_k", pick).select("*", F.col("_k.i").alias("_i"), F.col("_k.j").alias("_j")).withColumn("_w", part("_r", "_i") * part("_c", "_j")).where("_w > 0")
    corners = corners.select("to_lat_i", "to_lon_i", "lat", "lon", (F.floor("_r") + F.col("_i")).cast("int").alias("lat_i"), (F.floor("_c") + F.col("_j")).cast("int").alias("lon_i"), "_w")
    met = obs.select(*by, *CELL, value).join(corners, CELL)
    whole = F.abs(F.sum(F.when(F.col(value).isNotNull(), F.col("_w"))) - 1) < 1e-9
    out = met.groupBy(*by, "to_lat_i", "to_lon_i").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.when(whole, F.sum(F.col(value) * F.col("_w"))).alias(value))
    return out.withColumnRenamed("to_lat_i", "lat_i").withColumnRenamed("to_lon_i", "lon_i")
