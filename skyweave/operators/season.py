"""Indices of seasons given by days, such as 15 October to 20 January."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyweave.functions import calendar as C

#: Fixed names: which variables an index is made of.
VARIABLES = {
    "TotRain": ("precip",), "RainInt": ("precip",), "NumWD": ("precip",), "NumDD": ("precip",), "NumDS": ("precip",), "NumWS": ("precip",),
    "LongDS": ("precip",), "LongWS": ("precip",), "MinTemp": ("tmin",), "NumCD": ("tmin",), "MaxTemp": ("tmax",), "NumHD": ("tmax",),
    "MeanTemp": ("tmin", "tmax"), "CDD": ("tmin", "tmax"), "HDD": ("tmin", "tmax"), "GDD": ("tmin", "tmax"),
}


@dataclass(frozen=True)
class Season:
    """From day ``first`` to day ``last``, numbers month * 100 + day, and what
    its indices need. Missing parameters take the usual values."""

    first: int
    last: int
    threshold: float = 1.0
    spell: int = 7
    base: float = 18.0
    min_frac: float = 1.0

    def __post_init__(self):
        for md in (self.first, self.last):
            if not (1 <= md // 100 <= 12 and 1 <= md % 100 <= (29 if md // 100 == 2 else 30 if md // 100 in (4, 6, 9, 11) else 31)):
                raise ValueError(f"no day {md // 100:02d}-{md % 100:02d}")
        if self.spell < 1 or not 0 <= self.min_frac <= 1:
            raise ValueError("a spell has at least one day, min_frac lies between 0 and 1")


def season_days(obs: DataFrame, season: Season) -> DataFrame:
    """The rows within the season, with ``season_year``, where it began."""
    return obs.where(C.in_season(F.col("time"), season.first, season.last)).withColumn("season_year", C.season_year(F.col("time"), season.first, season.last))


def _value(name: str):
    parts = VARIABLES[name]
    return (F.col(parts[0]) if len(parts) == 1 else (F.col("tmin") + F.col("tmax")) / 2).cast("double")


def _judged(per: DataFrame, keys: list[str], season: Season, span: DataFrame, empty: float | None) -> DataFrame:
    """``(keys…, season_year, n_valid, value)`` for every key and season of
    which ``span(_a, _b)``, one row, holds a day. ``per`` has a key's seasons
    that hold a row; a key has few, which are laid out in one array."""
    entries = F.collect_list(F.struct("season_year", "n_valid", "_value")).alias("_per")
    rows = per.groupBy(*keys).agg(entries).join(F.broadcast(span)).withColumn("season_year", F.explode(F.sequence(F.year("_a") - 1, F.year("_b"))))
    start, end = C.season_span(F.col("season_year"), season.first, season.last)
    own = F.try_element_at(F.filter("_per", lambda s: s["season_year"] == F.col("season_year")), F.lit(1))
    rows = rows.withColumns({"_days": F.date_diff(F.least("_b", end), F.greatest("_a", start)) + 1, "_own": own}).where("_days > 0")
    n_valid = F.coalesce(F.col("_own.n_valid"), F.lit(0)).cast("long")
    whole = C.season_length(F.col("season_year"), season.first, season.last)
    good = (F.col("_days") / whole >= season.min_frac) & (n_valid / whole >= season.min_frac)
    value = F.when(F.col("_own").isNull(), F.lit(empty).cast("double")).otherwise(F.col("_own._value"))
    return rows.select(*keys, "season_year", n_valid.alias("n_valid"), F.when(good, value).alias("value"))


def span_of(obs: DataFrame) -> DataFrame:
    """The first and last day of all, ``(_a, _b)``."""
    return obs.agg(F.min("time").alias("_a"), F.max("time").alias("_b"))


def index(obs: DataFrame, keys: list[str], name: str, season: Season, span: DataFrame | None = None) -> DataFrame:
    """``(keys…, season_year, n_valid, value)`` of index ``name`` from
    ``obs(keys…, time, variables…)``; days may be absent, and are as days
    without a value from the first to the last day of all. These two are read
    from ``obs``, its column of times alone, or are given as ``span(_a, _b)``
    where they are known. Keys without a row in any season are left out.

    Null unless the season's days up to the last of all, and those with a
    value, make up ``min_frac`` of it. Spells are runs of days that are wet (at
    or above the threshold) or dry (below); a null or absent day ends a run,
    and so does the season. ``NumDS`` and ``NumWS`` count how many times
    ``spell`` days fit into the runs, ``LongDS`` and ``LongWS`` give the
    longest."""
    if name not in VARIABLES:
        raise ValueError(f"no index {name!r}")
    rows = season_days(obs, season).select(*keys, "season_year", "time", _value(name).alias("v"))
    group = [*keys, "season_year"]
    v, thr = F.col("v"), season.threshold
    wet = v >= thr
    count = lambda c: F.count_if(c).cast("double")
    over = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0.0))), F.lit(0.0))
    made = {
        "TotRain": lambda: F.coalesce(F.sum(v), F.lit(0.0)),
        "RainInt": lambda: F.try_divide(F.sum(F.when(wet, v)), F.count_if(wet)),
        "NumWD": lambda: count(wet),
        "NumDD": lambda: count(v < thr),
        "NumCD": lambda: count(v < thr),
        "NumHD": lambda: count(wet),
        "MinTemp": lambda: F.avg(v),
        "MaxTemp": lambda: F.avg(v),
        "MeanTemp": lambda: F.avg(v),
        "CDD": lambda: over(v - season.base),
        "GDD": lambda: over(v - season.base),
        "HDD": lambda: over(season.base - v),
    }
    if name in made:
        per = rows.groupBy(*group).agg(F.count(v).alias("n_valid"), made[name]().alias("_value"))
    else:
        hit = F.coalesce(wet if name.endswith("WS") else v < thr, F.lit(False))
        order = Window.partitionBy(*group).orderBy("time")
        # Of days that follow each other, the day's number less that of hits so far is the same.
        runs = rows.withColumn("_hit", hit).withColumn("_run", F.when(F.col("_hit"), F.unix_date("time") - F.count_if(F.col("_hit")).over(order)))
        runs = runs.groupBy(*group, "_run").agg(F.count_if("_hit").alias("_length"), F.count(v).alias("_valid"))
        length = F.col("_length")
        pick = F.sum(F.floor(length / season.spell)) if name.startswith("Num") else F.max(length)
        per = runs.groupBy(*group).agg(F.sum("_valid").alias("n_valid"), pick.cast("double").alias("_value"))
    empty = None if name in ("RainInt", "MinTemp", "MaxTemp", "MeanTemp") else 0.0
    return _judged(per, keys, season, span_of(obs) if span is None else span, empty)


def month_season(obs: DataFrame, keys: list[str], value: str, function: str, first_month: int, last_month: int, min_frac: float, span: DataFrame | None = None) -> DataFrame:
    """Sum or mean over a season of whole months; February has 28 days."""
    ends = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    season = Season(first_month * 100 + 1, last_month * 100 + ends[last_month - 1], min_frac=min_frac)
    v = F.col(value).cast("double")
    made = F.coalesce(F.sum(v), F.lit(0.0)) if function == "sum" else F.avg(v)
    per = season_days(obs, season).groupBy(*keys, "season_year").agg(F.count(v).alias("n_valid"), made.alias("_value"))
    return _judged(per, keys, season, span_of(obs) if span is None else span, 0.0 if function == "sum" else None)
