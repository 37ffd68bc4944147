"""Results as tables and texts for exchange."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = -9999.0


def filled(v: Column, missing: float = MISSING, digits: int = 2) -> Column:
    return F.coalesce(F.round(v, digits), F.lit(missing))


def two_decimals(v: Column) -> Column:
    """A double as text with two decimals, the nearest to its exact value and
    of two equally near ones the even one, as C's ``printf`` has it; Java's
    rounds up what its shortest digits end in. From 2^63 on it is Java's."""
    a = F.abs(v)
    whole = F.floor(a)
    part = a - whole
    # Hundredths as two terms, both exact near a half, as the first has 26 bits of the part.
    high = F.floor(part * 2.0**26) / F.lit(2.0**26)
    most, rest = high * 100.0, (part - high) * 100.0
    cents = F.floor(most)
    over = (most - cents - 0.5) + rest
    cents = cents + F.when((over > 0) | (over == 0) & (cents % 2 == 1), 1).otherwise(0)
    sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
    exact = F.format_string("%s%d.%02d", sign, whole + F.when(cents == 100, 1).otherwise(0), cents % 100)
    return F.when(a < 2.0**63, exact).otherwise(F.format_string("%.2f", v))


def csv_columns(grid: DataFrame, value: str, missing: float = MISSING, lead: list[str] = ()) -> DataFrame:
    """A grid as rows ``Latitude, Longitude, value``."""
    return grid.select(*lead, F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"), filled(F.col(value), missing).alias(value))


def climatology_columns(found: DataFrame, stats: list[str], missing: float = MISSING) -> DataFrame:
    """``Dates, Latitude, Longitude`` and a column for each statistic."""
    wide = found.groupBy(F.col("label").alias("Dates"), F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude")).pivot("stat", stats).agg(F.first("value"))
    return wide.select("Dates", "Latitude", "Longitude", *[filled(F.col(f"`{s}`"), missing).alias(s) for s in stats])


def cdt(series: DataFrame, sites: DataFrame, names: list[str], missing: float = MISSING) -> DataFrame:
    """Sites as columns: rows Name, Longitude and Latitude come first, then
    one row a period; everything is text, numbers with two decimals."""
    text = two_decimals(F.coalesce(F.col("value"), F.lit(missing)))
    body = series.groupBy(F.col("label").alias("Name")).pivot("site", names).agg(F.first(text)).select("Name", *[F.coalesce(F.col(f"`{n}`"), F.lit(f"{missing:.2f}")).alias(n) for n in names]).withColumn("_o", F.lit(3))
    at = lambda k, o: sites.groupBy(F.lit(k).alias("Name")).pivot("loc", names).agg(F.first(F.col("lon" if o == 1 else "lat").cast("string"))).withColumn("_o", F.lit(o))
    return at("Longitude", 1).unionByName(at("Latitude", 2)).unionByName(body).orderBy("_o", "Name").drop("_o")


def json_points(series: DataFrame, sites: DataFrame, missing: float = MISSING) -> DataFrame:
    """One JSON object a site: Name, Longitude, Latitude and Values in order
    of periods. A site's series is one array."""
    values = series.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("label", filled(F.col("value"), missing).alias("value")))).alias("v"))
    whole = sites.join(values, F.col("loc") == F.col("site"))
    return whole.select("loc", F.to_json(F.struct(F.col("loc").alias("Name"), F.col("lon").alias("Longitude"), F.col("lat").alias("Latitude"), F.transform("v", lambda s: s["label"]).alias("Dates"), F.transform("v", lambda s: s["value"]).alias("Values"))).alias("json"))


def json_climatology(found: DataFrame, sites: DataFrame, missing: float = MISSING) -> DataFrame:
    """One JSON object a site with, for each statistic, its values in order of
    slots; ``found`` has ``site, slot, stat, value``."""
    each = found.groupBy("site", "stat").agg(F.array_sort(F.collect_list(F.struct("slot", filled(F.col("value"), missing).alias("value")))).alias("v"))
    whole = each.groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stat", F.transform("v", lambda s: s["value"]).alias("v"))))).alias("stats"))
    rows = sites.join(whole, F.col("loc") == F.col("site"))
    return rows.select("loc", F.to_json(F.struct(F.col("loc").alias("Name"), F.col("lon").alias("Longitude"), F.col("lat").alias("Latitude"), F.col("stats").alias("Values"))).alias("json"))


def json_grid(grid: DataFrame, value: str, missing: float = MISSING) -> DataFrame:
    """One JSON object a period and row of the grid, south to north."""
    row = F.array_sort(F.collect_list(F.struct("lon", filled(F.col(value), missing).alias("v"))))
    return grid.groupBy("label", "lat").agg(row.alias("r")).select("label", "lat", F.to_json(F.struct("label", "lat", F.transform("r", lambda s: s["lon"]).alias("lon"), F.transform("r", lambda s: s["v"]).alias(value))).alias("json"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def zip_zones(df: DataFrame, zone: str, limit: int = 1_000_000) -> bytes:
    """A ZIP archive with a CSV file for each zone, made on the driver after
    counting that the result, at most ``limit`` rows, fits there; more is what
    :func:`write_csv` is for. Files are named after the zones, letters and
    digits only; where names meet, with a number."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows; write them as a table instead")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in df.toPandas().groupby(zone):
            plain = "".join(c for c in str(name) if c.isalnum()) or "zone"
            safe, k = plain, 2
            while f"{safe}.csv" in z.namelist():
                safe, k = f"{plain}_{k}", k + 1
            z.writestr(f"{safe}.csv", part.drop(columns=[zone]).to_csv(index=False))
    return out.getvalue()
