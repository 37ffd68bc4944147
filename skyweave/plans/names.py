"""What results are called: variables' metadata and file names."""

from __future__ import annotations

from dataclasses import dataclass

from .specs import Climatology, SeasonIndex, Series


@dataclass(frozen=True)
class Meta:
    name: str
    long_name: str
    units: str


# Units of variables and indices.
UNITS = {"precip": "mm", "et0": "mm", "rad": "W/m2", "pmsl": "hPa", "pres": "hPa", "rhmean": "%", "rhmin": "%", "rhmax": "%", "wspd": "m/s", "wdir": "degree", "tmin": "degC", "tmax": "degC", "tmean": "degC"}
INDEX_UNITS = {"TotRain": "mm", "RainInt": "mm/day", "MinTemp": "degC", "MaxTemp": "degC", "MeanTemp": "degC", "CDD": "degC day", "HDD": "degC day", "GDD": "degC day"}
INDEX_NAMES = {
    "TotRain": "seasonal rainfall total", "RainInt": "mean rainfall of wet days", "NumWD": "number of wet days", "NumDD": "number of dry days",
    "NumDS": "number of dry spells", "NumWS": "number of wet spells", "LongDS": "longest dry spell", "LongWS": "longest wet spell",
    "MinTemp": "mean of minimum temperatures", "MaxTemp": "mean of maximum temperatures", "MeanTemp": "mean temperature",
    "NumCD": "number of cold days", "NumHD": "number of hot days", "CDD": "cooling degree days", "HDD": "heating degree days", "GDD": "growing degree days",
}


def of_series(spec: Series) -> Meta:
    return Meta(spec.variable, f"{spec.res} {spec.function} of {spec.variable}", "count" if spec.function == "count" else UNITS[spec.variable])


def of_index(spec: SeasonIndex) -> Meta:
    return Meta(spec.index, INDEX_NAMES[spec.index], INDEX_UNITS.get(spec.index, "count"))


def of_statistic(of: Meta, spec: Climatology) -> list[Meta]:
    """One entry for each field that a climatology has."""
    s = spec.statistic
    if s == "percentile":
        return [Meta(f"{of.name}_p{p:g}", f"{p:g}th percentile of {of.long_name}", of.units) for p in spec.percent]
    if s == "mean-stdev":
        return [Meta(f"{of.name}_{k}", f"{k} of {of.long_name}", of.units) for k in ("mean", "stdev")]
    if s == "trend":
        return [Meta(f"{of.name}_slope", f"trend of {of.long_name}", {"perYear": f"{of.units}/year", "overPeriod": of.units, "percPeriod": "%"}[spec.trend_unit])]
    units = "%" if s in ("cv", "frequency") or s.startswith("prob") and spec.unit == "percentage" else "1" if s.startswith("prob") else of.units
    return [Meta(f"{of.name}_{s}", f"{s} of {of.long_name}", units)]


def of_anomaly(of: Meta, kind: str) -> Meta:
    return Meta(f"{of.name}_anomaly", f"{kind} anomaly of {of.long_name}", {"difference": of.units, "percentage": "%", "standardized": "1"}[kind])


def file_name(meta: Meta, label: str, extension: str) -> str:
    """A name that any file system takes."""
    safe = "".join(c if c.isalnum() or c in "-_" else "_" for c in f"{meta.name}_{label}")
    return f"{safe}.{extension}"
