"""The requests a user makes, as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.functions import calendar as C
from skyweave.operators import anomaly as A
from skyweave.operators import climatology as K
from skyweave.operators import resample as R
from skyweave.operators import season as S
from skyweave.operators import support as P
from skyweave.sources import grid as G
from skyweave.sources import places as L

from .specs import BBox, Climatology, GeoJSON, Original, Points, Polygons, SeasonIndex, Series, Support, check_anomaly


@dataclass(frozen=True)
class Engine:
    """``obs(time, lat_i, lon_i, lat, lon, variables…)`` on a regular grid that
    begins at ``lat0, lon0``; ``rows`` and ``cols`` say how far it goes, if
    known."""

    obs: DataFrame
    lat0: float
    lon0: float
    dlat: float
    dlon: float
    variables: tuple[str, ...] = ("precip", "tmin", "tmax")
    rows: int | None = None
    cols: int | None = None

    @property
    def axes(self) -> P.Axes:
        return P.Axes(self.lat0, self.lon0, self.dlat, self.dlon, self.rows, self.cols)

    def info(self) -> DataFrame:
        return G.info(self.obs.withColumn("dataset", F.lit("obs")), ["dataset"])

    def on(self, support: Support, variables: list[str]) -> tuple[DataFrame, list[str]]:
        """Observations on a support, each by itself, and the columns that tell
        the support's parts; those of sites and zones are yet to be averaged."""
        obs, cell = self.obs, P.CELL
        axes = self.axes
        spark = obs.sparkSession
        take = lambda df: df.select(*cell, "time", *variables)
        if isinstance(support, Original):
            return take(obs), cell
        if isinstance(support, BBox):
            box = (support.west, support.south, support.east, support.north)
            inside = take(P.bbox(obs, *box))
            return (inside.withColumn("site", F.lit("rectangle")), ["site"]) if support.average else (inside, cell)
        if isinstance(support, Points):
            return take(obs).join(P.point_cells(axes, L.sites(spark, list(support.points)), support.pad), cell), ["site"]
        if isinstance(support, Polygons):
            zones = L.zones(spark, support.polygons)
            if not support.average:
                return take(obs.join(P.polygon_cells(axes, zones).select(*cell).distinct(), cell, "left_semi")), cell
            return P.on_runs(take(obs), P.polygon_runs(axes, zones)), ["site"]
        if isinstance(support, GeoJSON):
            features = L.geojson(spark, support.path, support.field)
            points = take(obs).join(P.point_cells(axes, L.geojson_sites(features), support.pad), cell)
            return P.on_runs(take(obs), P.polygon_runs(axes, L.geojson_zones(features))).unionByName(points), ["site"]
        raise TypeError(f"no support: {support!r}")

    def at(self, support: Support, variables: list[str]) -> tuple[DataFrame, list[str]]:
        """Observations on a support, and the columns that tell its parts: a
        site's or a zone's are means over its cells."""
        rows, keys = self.on(support, variables)
        return self._met(rows, keys, variables), keys

    @staticmethod
    def _met(rows: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
        return rows if keys != ["site"] else rows.groupBy("site", "time").agg(*[F.avg(v).alias(v) for v in variables])

    def raw(self, spec: Series) -> DataFrame:
        """``(keys…, period, n_valid, value)`` of a variable."""
        rows, keys = self.on(spec.support, [spec.variable])
        rows = R.time_range(rows, spec.start, spec.end)
        obs = self._met(rows, keys, [spec.variable]).withColumnRenamed(spec.variable, "value")
        if spec.res == spec.source:
            return obs.select(*keys, F.col("time").alias("period"), F.col("value").isNotNull().cast("long").alias("n_valid"), "value")
        season = {"season_start": spec.season_start, "length": spec.length, "full_year": spec.full_year} if spec.res == "seasonal" else {}
        return R.resample(obs, keys, "value", spec.res, spec.function, spec.source, spec.mode, spec.min_frac, spec.op, spec.threshold, rows.select("time"), **season)

    def _statistic(self, series: DataFrame, keys: list[str], spec: Climatology) -> DataFrame:
        how = {"min_years": spec.min_years}
        if spec.statistic == "mean-stdev":
            return K.mean_stdev(series, keys, "value", **how)
        if spec.statistic == "percentile":
            return K.percentiles(series, keys, "value", list(spec.percent), **how)
        if spec.statistic in ("probExc", "probNoExc"):
            return K.probability(series, keys, "value", spec.threshold, spec.statistic == "probExc", spec.unit == "percentage", **how)
        if spec.statistic == "trend":
            return K.trend(series, keys, "value", spec.first_year, spec.last_year, unit=spec.trend_unit, **how)
        return K.climatology(series, keys, "value", spec.statistic, op=spec.op, threshold=spec.threshold, **how)

    def climatology(self, series: Series, spec: Climatology) -> DataFrame:
        """A statistic for each slot of the year."""
        data = self.raw(series)
        keys = [c for c in data.columns if c in ("lat_i", "lon_i", "site")]
        if series.res == "daily" and spec.window and spec.statistic in (*K.FROM_PARTS, "mean-stdev"):
            found = K.windowed(data, keys, "value", spec.first_year, spec.last_year, spec.window, "period", spec.op, spec.threshold)
            return K.windowed_statistic(found, keys, spec.statistic, spec.min_years)
        return self._statistic(K.slots(data, series.res, spec.first_year, spec.last_year, spec.window), [*keys, "slot"], spec)

    def anomaly(self, series: Series, kind: str, spec: Climatology) -> DataFrame:
        """The series as departures from its own base period."""
        data = self.raw(series).withColumn("slot", C.slot(F.col("period"), series.res))
        keys = [c for c in data.columns if c in ("lat_i", "lon_i", "site")]
        base = data.where(F.year("period").between(spec.first_year, spec.last_year))
        return A.anomaly(data, base, [*keys, "slot"], "value", check_anomaly(kind), spec.min_years)

    def season(self, spec: SeasonIndex) -> DataFrame:
        """A season's index, one row a key and year."""
        parts = list(S.VARIABLES[spec.index])
        rows, keys = self.on(spec.support, parts)
        return S.index(self._met(rows, keys, parts), keys, spec.index, spec.season, S.span_of(rows))

    def season_climatology(self, index: SeasonIndex, spec: Climatology) -> DataFrame:
        data = self.season(index).withColumnRenamed("season_year", "year").where(F.col("year").between(spec.first_year, spec.last_year))
        keys = [c for c in data.columns if c in ("lat_i", "lon_i", "site")]
        return self._statistic(data, keys, spec)

    def season_anomaly(self, index: SeasonIndex, kind: str, spec: Climatology) -> DataFrame:
        data = self.season(index)
        keys = [c for c in data.columns if c in ("lat_i", "lon_i", "site")]
        base = data.where(F.col("season_year").between(spec.first_year, spec.last_year))
        return A.anomaly(data, base, keys, "value", check_anomaly(kind), spec.min_years)


    def lookup(self, path: str, variable: str, res: str, stat: str, support: Support) -> DataFrame:
        """A statistic that :func:`materialise_climatologies` keeps, by cell or
        averaged over the cells of a support; the mean of a stdev is not the
        stdev of the mean, which :meth:`climatology` gives."""
        store = self.obs.sparkSession.read.parquet(path).where((F.col("variable") == variable) & (F.col("res") == res) & (F.col("stat") == stat))
        where = Engine(self.axes.located(store).withColumn("time", F.col("slot")), self.lat0, self.lon0, self.dlat, self.dlon, rows=self.rows, cols=self.cols)
        found, keys = where.at(support, ["value"])
        return found.select(*keys, F.col("time").alias("slot"), "value")


def materialise_climatologies(engine: Engine, series: list[Series], path: str, first_year: int = 1991, last_year: int = 2020, min_years: int = 30) -> None:
    """Mean, stdev and percentiles 5, 25, 50, 75 and 95 of all ``series``, as a
    table by variable, resolution and kind. What is there of these already is
    replaced, so that a second run leaves the same."""
    base = {"first_year": first_year, "last_year": last_year, "min_years": min_years}
    for s in series:
        for statistic in ("mean-stdev", "percentile"):
            found = engine.climatology(s, Climatology(statistic, **base))
            named = found.withColumns({"variable": F.lit(s.variable), "res": F.lit(s.res), "kind": F.lit(statistic)})
            named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("variable", "res", "kind").parquet(path)
