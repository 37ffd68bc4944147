"""Points and polygons: tables, inline lists and GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITES = "loc string, lon double, lat double"
ZONES = "zone string, rings array<array<struct<x:double,y:double>>>"


def sites_csv(spark: SparkSession, path: str) -> DataFrame:
    """Points of a CSV file whose first three columns, whatever they are
    called, are name, longitude and latitude."""
    df = spark.read.option("header", True).csv(path)
    first = df.select(*[F.col(f"`{c}`") for c in df.columns[:3]]).toDF("loc", "lon", "lat")
    return first.select("loc", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))


def sites(spark: SparkSession, points: list) -> DataFrame:
    """Points given as ``[name, lon, lat]`` or ``{"loc", "lon", "lat"}``."""
    rows = [(str(p["loc"]), float(p["lon"]), float(p["lat"])) if isinstance(p, dict) else (str(p[0]), float(p[1]), float(p[2])) for p in points]
    return spark.createDataFrame(rows, SITES)


def zones(spark: SparkSession, polygons: dict[str, list]) -> DataFrame:
    """Polygons given as lists of rings of ``(lon, lat)``; open rings close."""
    close = lambda r: [tuple(map(float, p)) for p in (r if tuple(r[0]) == tuple(r[-1]) else [*r, r[0]])]
    return spark.createDataFrame([(k, [close(r) for r in rings]) for k, rings in polygons.items()], ZONES)


def geojson(spark: SparkSession, path: str, field: str) -> DataFrame:
    """``(feature, type, rings, lon, lat)`` of a FeatureCollection's polygons,
    multipolygons and points, named by property ``field``; others are left
    out. Parts of one feature are united."""
    text = spark.read.option("wholetext", True).text(path)
    feature = "array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    f = text.select(F.explode(F.from_json("value", f"struct<features:{feature}>")["features"]).alias("f"))
    rows = f.select(F.col("f.properties")[field].alias("feature"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    rows = rows.where(F.col("type").isin("Polygon", "MultiPolygon", "Point"))
    pairs = F.from_json("c", "array<array<array<double>>>")
    many = F.flatten(F.from_json("c", "array<array<array<array<double>>>>"))
    rings = F.transform(F.when(F.col("type") == "Polygon", pairs).when(F.col("type") == "MultiPolygon", many), lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    point = F.when(F.col("type") == "Point", F.from_json("c", "array<double>"))
    return rows.select("feature", "type", rings.alias("rings"), point[0].alias("lon"), point[1].alias("lat"))


def geojson_zones(features: DataFrame) -> DataFrame:
    return features.where("type <> 'Point'").groupBy(F.col("feature").alias("zone")).agg(F.flatten(F.collect_list("rings")).alias("rings"))


def geojson_sites(features: DataFrame) -> DataFrame:
    return features.where("type = 'Point'").select(F.col("feature").alias("loc"), "lon", "lat")
