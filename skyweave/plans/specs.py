"""Requests, validated when they are made."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from skyweave.functions.calendar import RESOLUTIONS
from skyweave.functions.compare import COMPARE
from skyweave.operators.anomaly import KINDS
from skyweave.operators.season import VARIABLES, Season

VARIABLE_NAMES = ("precip", "tmax", "tmin", "tmean", "pmsl", "pres", "rad", "rhmean", "rhmax", "rhmin", "wspd", "wdir", "et0")
STATISTICS = ("mean", "median", "min", "max", "stdev", "cv", "frequency", "percentile", "mean-stdev", "probExc", "probNoExc", "trend")


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _check_date(text: str, res: str) -> None:
    form = {"daily": r"\d{4}-\d{2}-\d{2}", "dekadal": r"\d{4}-\d{2}-[123]", "monthly": r"\d{4}-\d{2}", "annual": r"\d{4}", "seasonal": r"\d{4}-\d{2}_\d{4}-\d{2}"}[res]
    _need(bool(re.fullmatch(form, text)), f"{text!r} is no {res} date")
    parts = [int(p) for p in re.split("[-_]", text)]
    _need(1000 <= parts[0] <= 3000 and (len(parts) < 2 or 1 <= parts[1] <= 12), f"{text!r} is no {res} date")
    if res == "daily":
        dt.date(*parts)


@dataclass(frozen=True)
class Original:
    """The grid as it is."""


@dataclass(frozen=True)
class BBox:
    west: float
    south: float
    east: float
    north: float
    average: bool = False

    def __post_init__(self):
        _need(self.west <= self.east and self.south <= self.north, "the box is empty")


@dataclass(frozen=True)
class Points:
    """``[name, lon, lat]`` or dicts; ``pad`` steps around each."""

    points: tuple
    pad: int = 0

    def __post_init__(self):
        _need(len(self.points) > 0 and self.pad >= 0, "points are needed, and a pad of 0 or more")


@dataclass(frozen=True)
class Polygons:
    polygons: dict
    average: bool = False

    def __post_init__(self):
        _need(all(len(r) >= 3 for rings in self.polygons.values() for r in rings), "a ring has three points at least")


@dataclass(frozen=True)
class GeoJSON:
    path: str
    field: str
    pad: int = 0


Support = Original | BBox | Points | Polygons | GeoJSON


def formats(support: Support) -> tuple[str, ...]:
    """What a support's result can be written as."""
    if isinstance(support, GeoJSON):
        return ("json",)
    if isinstance(support, Points) or getattr(support, "average", False):
        return ("cdt", "json")
    return ("netcdf", "csv", "json")


@dataclass(frozen=True)
class Series:
    """A variable at a resolution, made from steps of ``source`` resolution."""

    variable: str
    res: str
    start: str
    end: str
    support: Support = field(default_factory=Original)
    source: str = "daily"
    function: str = "sum"
    mode: str = "R4"
    min_frac: float = 1.0
    season_start: int = 1
    length: int = 3
    full_year: bool = False
    op: str = ">="
    threshold: float = 1.0

    def __post_init__(self):
        _need(self.variable in VARIABLE_NAMES, f"no variable {self.variable!r}")
        _need(self.res in RESOLUTIONS and self.source in RESOLUTIONS, f"no resolution {self.res!r}")
        _need(self.function in ("sum", "mean", "median", "min", "max", "count"), f"no function {self.function!r}")
        _need(self.mode in ("R1", "R2", "R3", "R4") and 0 <= self.min_frac <= 1, "mode is R1 to R4, min_frac from 0 to 1")
        _need(1 <= self.season_start <= 12 and 1 <= self.length <= 12, "seasons start in month 1 to 12 and last 1 to 12 months")
        _need(self.op in COMPARE, f"no comparison {self.op!r}")
        for d in (self.start, self.end):
            _check_date(d, "daily")
        _need(self.start <= self.end, "the range is empty")


@dataclass(frozen=True)
class Climatology:
    statistic: str = "mean"
    first_year: int = 1991
    last_year: int = 2020
    min_years: int = 30
    window: int = 0
    percent: tuple[float, ...] = (5, 25, 50, 75, 95)
    op: str = ">="
    threshold: float = 1.0
    unit: str = "percentage"
    trend_unit: str = "perYear"

    def __post_init__(self):
        _need(self.statistic in STATISTICS, f"no statistic {self.statistic!r}")
        _need(self.first_year <= self.last_year and 1 <= self.min_years <= self.last_year - self.first_year + 1, "the base period is too short")
        _need(self.op in COMPARE, f"no comparison {self.op!r}")
        _need(all(0 <= p <= 100 for p in self.percent) and 0 <= self.window <= 30, "percent from 0 to 100, a window of 0 to 30 days")
        _need(self.trend_unit in ("perYear", "overPeriod", "percPeriod"), f"no unit {self.trend_unit!r}")


@dataclass(frozen=True)
class SeasonIndex:
    index: str
    season: Season
    support: Support = field(default_factory=Original)

    def __post_init__(self):
        _need(self.index in VARIABLES, f"no index {self.index!r}")


def check_anomaly(kind: str) -> str:
    _need(kind in KINDS, f"no anomaly {kind!r}")
    return kind
