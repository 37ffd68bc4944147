"""Answers to requests in the format that was asked for.

An answer is a table still: of lines of text for JSON, of columns for CSV and
CDT. What a support can be given out as, :func:`specs.formats` says.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweave.functions import calendar as C
from skyweave.operators import support as P
from skyweave.sources import places as L
from skyweave.sources import sinks

from . import names
from .engine import Engine
from .specs import BBox, Climatology, GeoJSON, Points, Polygons, SeasonIndex, Series, Support, formats

#: Types of content by format.
MIME = {"csv": "text/csv", "cdt": "text/csv", "json": "application/json"}


@dataclass(frozen=True)
class Response:
    """``rows`` to be written under ``name``: with a column ``json``, lines of
    JSON, else a table with a header."""

    rows: DataFrame
    name: str
    mime: str

    def write(self, folder: str) -> None:
        """As text files in ``folder``, a task's rows in one each."""
        if "json" in self.rows.columns:
            self.rows.select("json").write.mode("overwrite").text(folder)
        else:
            sinks.write_csv(self.rows, folder)


def sites_of(engine: Engine, support: Support) -> DataFrame:
    """``(loc, lon, lat)``: where a support's parts are; a box by its middle,
    zones by their centroids."""
    spark = engine.obs.sparkSession
    if isinstance(support, Points):
        return L.sites(spark, list(support.points))
    if isinstance(support, BBox):
        return L.sites(spark, [("rectangle", (support.west + support.east) / 2, (support.south + support.north) / 2)])
    if isinstance(support, Polygons):
        return P.zone_points(L.zones(spark, support.polygons))
    if isinstance(support, GeoJSON):
        features = L.geojson(spark, support.path, support.field)
        return P.zone_points(L.geojson_zones(features)).unionByName(L.geojson_sites(features))
    raise TypeError(f"{support!r} has no sites")


def _site_names(support: Support) -> list[str]:
    if isinstance(support, Points):
        return [str(p["loc"] if isinstance(p, dict) else p[0]) for p in support.points]
    return ["rectangle"] if isinstance(support, BBox) else list(support.polygons)


def _labelled(found: DataFrame, spec: Series | SeasonIndex, base: Climatology | None, slots: bool) -> DataFrame:
    """``found`` with ``label``, the name of its period, season or slot."""
    if slots:
        if "slot" not in found.columns:
            return found.withColumn("label", F.lit(f"{base.first_year}-{base.last_year}"))
        return found.withColumn("label", C.slot_label(F.col("slot"), spec.res, base.first_year, base.last_year, spec.length))
    if isinstance(spec, SeasonIndex):
        return found.withColumn("label", C.season_label(F.col("season_year"), spec.season.first, spec.season.last))
    return found.withColumn("label", C.label(F.col("period"), spec.res, spec.length))


def respond(engine: Engine, form: str, kind: str, *specs) -> Response:
    """The answer to ``getattr(engine, kind)(*specs)`` in format ``form``:
    ``csv`` or ``json`` for a grid, ``cdt`` or ``json`` for sites and means.

    Missing values are -9999. Raises ``ValueError`` for a format that the
    support does not have; netCDF files, one a field, are
    :func:`netcdf.write_field`'s. Statistics by slot are columns of CSV and
    lists of JSON; CDT has room for one value a period and takes series."""
    spec = specs[0]
    base = next((s for s in specs if isinstance(s, Climatology)), None)
    slots = kind in ("climatology", "season_climatology")
    if form not in formats(spec.support) or form not in MIME or slots and form == "cdt":
        raise ValueError(f"no {form!r} of {kind} over this support")
    found = getattr(engine, kind)(*specs)
    if slots and "stat" not in found.columns:
        kept = [c for c in found.columns if c not in (*P.CELL, "site", "slot", "n")]
        found = found.unpivot([c for c in found.columns if c not in kept], kept, "stat", "value")
        if len(kept) == 1:
            found = found.withColumn("stat", F.lit(base.statistic))
    found = _labelled(found, spec, base, slots)
    sites = "site" in found.columns
    if slots:
        stats = ["mean", "stdev"] if base.statistic == "mean-stdev" else [f"{p:g}%" for p in base.percent] if base.statistic == "percentile" else None
        stats = stats or (kept if len(kept) > 1 else [base.statistic])
        if sites:
            rows = sinks.json_climatology(found if "slot" in found.columns else found.withColumn("slot", F.lit(1)), sites_of(engine, spec.support))
        elif form == "csv":
            rows = sinks.climatology_columns(engine.axes.located(found), stats)
        else:
            rows = sinks.json_grid(engine.axes.located(found.withColumn("label", F.concat_ws("_", "label", "stat"))), "value")
    elif sites and form == "cdt":
        rows = sinks.cdt(found, sites_of(engine, spec.support), _site_names(spec.support))
    elif sites:
        rows = sinks.json_points(found, sites_of(engine, spec.support))
    elif form == "csv":
        rows = sinks.csv_columns(engine.axes.located(found), "value", lead=["label"])
    else:
        rows = sinks.json_grid(engine.axes.located(found), "value")
    of = names.of_index(spec) if isinstance(spec, SeasonIndex) else names.of_series(spec)
    what = kind if isinstance(spec, SeasonIndex) else f"{kind}_{spec.res}"
    return Response(rows, names.file_name(of, what, "json" if form == "json" else "csv"), MIME[form])
