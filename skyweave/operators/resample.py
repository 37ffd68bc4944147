"""Temporal aggregation of observations ``(keys…, time, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions import calendar as C
from skyweave.functions.compare import compare
from skyweave.functions.stats import nan_to_null, reducer


def time_range(obs: DataFrame, start: str, end: str) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; pushed to the scan."""
    return obs.where(F.col("time").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def assign_period(obs: DataFrame, res: str, season_start: int = 1, length: int = 3, full_year: bool = False) -> DataFrame:
    """``obs`` with ``period``, the first day of the output period it falls
    into. Seasons of ``length`` months begin in month ``season_start``, or with
    ``full_year`` in every month, and a row then belongs to ``length`` of them.
    """
    if res != "seasonal":
        return obs.withColumn("period", C.period_start(F.col("time"), res))
    if full_year:
        return obs.withColumn("period", F.explode(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.add_months(C.month_start(F.col("time")), -k))))
    into = F.pmod(F.month("time") - season_start, F.lit(12))
    return obs.where(into < length).withColumn("period", F.add_months(C.month_start(F.col("time")), -into))


def _steps(times: DataFrame, res: str, season: dict) -> DataFrame:
    """``(period, _steps)``: the distinct times that a period has in all, as
    bits of the days in it. Only the column of times is read, and a task hands
    on one row a period."""
    longest = 31 * season.get("length", 3) if res == "seasonal" else LONGEST.get(res, 366)
    words = range(-(-longest // 62))
    rows = assign_period(times.select("time"), res, **season).withColumn("_off", F.date_diff("time", "period"))
    bits = [F.expr(f"bit_or(if(_off div 62 = {k}, shiftleft(1L, cast(_off % 62 as int)), 0L))") for k in words]
    return rows.groupBy("period").agg(sum((F.bit_count(b) for b in bits), F.lit(0)).alias("_steps"))


#: Days of an output period at most.
LONGEST = {"pentadal": 6, "dekadal": 11, "monthly": 31, "annual": 366}

#: Functions whose values over several months follow from those of each: what is kept of a month, and how months meet.
MERGED: dict[str, tuple] = {
    "sum": (lambda v, _: (F.sum(v),), lambda p: F.coalesce(F.sum(p[0]), F.lit(0.0))),
    "mean": (lambda v, _: (F.sum(v), F.count(v)), lambda p: F.try_divide(F.sum(p[0]), F.sum(p[1]))),
    "min": (lambda v, _: (F.min(v),), lambda p: F.min(p[0])),
    "max": (lambda v, _: (F.max(v),), lambda p: F.max(p[0])),
    "count": (lambda v, hit: (F.count_if(hit),), lambda p: F.sum(p[0]).cast("double")),
}


def _rolling(rows: DataFrame, keys: list[str], value: str, function: str, length: int, op: str, threshold: float) -> DataFrame:
    """Seasons that begin in every month, from sums of months: a month's row,
    not its days, goes into ``length`` seasons."""
    v, (part, merge) = F.col(value), MERGED[function]
    parts = part(v, compare(v, op, threshold))
    names = [f"_p{k}" for k in range(len(parts))]
    months = rows.withColumn("_month", C.month_start(F.col("time"))).groupBy(*keys, "_month").agg(F.count(v).alias("n_valid"), *[p.alias(n) for p, n in zip(parts, names)])
    seasons = months.withColumn("period", F.explode(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.add_months("_month", -k))))
    return seasons.groupBy(*keys, "period").agg(F.sum("n_valid").alias("n_valid"), merge([F.col(n) for n in names]).alias("_value"))


def resample(
    obs: DataFrame,
    keys: list[str],
    value: str,
    res: str,
    function: str = "sum",
    in_res: str = "daily",
    mode: str = "R4",
    min_frac: float = 0.0,
    op: str = ">=",
    threshold: float = 1.0,
    times: DataFrame | None = None,
    **season,
) -> DataFrame:
    """``(keys…, period, n_valid, value)``, one row a key and period.

    Completeness, with ``steps`` the distinct times that the whole input has in
    a period and ``expected`` those of a full one:

    - R4: the period needs ``steps / expected >= min_frac``, the value
      ``n_valid / expected >= min_frac``;
    - R1: as R4, but times that are missing for all do not count against a
      key: ``(expected - nulls) / expected >= min_frac``;
    - R2: the value needs ``nulls / expected < min_frac`` instead;
    - R3: values are kept as they are, the sum of nothing as 0, but a key with
      no period of ``n_valid / expected >= min_frac`` is blank throughout.

    Periods that fail are dropped, values that fail null. Nulls are steps that
    the input has a time for but the key no value. The input's times are read
    from it, or from ``times(time)`` where they are known, as from a store's
    manifest or from what ``obs`` was made of."""
    rows = obs.withColumn(value, nan_to_null(F.col(value).cast("double")))
    length = season.get("length", 3)
    v = F.col(value)
    if res == "seasonal" and season.get("full_year") and function in MERGED:
        out = _rolling(rows, keys, value, function, length, op, threshold)
    else:
        out = assign_period(rows, res, **season).groupBy(*keys, "period").agg(F.count(v).alias("n_valid"), reducer(function, v, op, threshold).alias("_value"))
    # As many rows as the axis of time has periods.
    steps = F.broadcast(_steps(obs if times is None else times, res, season))
    out = out.join(steps, "period").withColumn("_expected", C.steps(F.col("period"), res, in_res, length))
    out = out.where(F.col("_steps") / F.col("_expected") >= min_frac)
    full, nulls = F.col("n_valid") / F.col("_expected"), F.col("_steps") - F.col("n_valid")
    good: Column = {
        "R4": full >= min_frac,
        "R1": (F.col("_expected") - nulls) / F.col("_expected") >= min_frac,
        "R2": nulls / F.col("_expected") < min_frac,
        "R3": F.lit(True),
    }[mode]
    if mode == "R3":
        best = out.groupBy(*keys).agg(F.max(full).alias("_best"))
        out = out.join(best, keys)
        good = F.col("_best") >= min_frac
    return out.select(*keys, "period", "n_valid", F.when(good, F.col("_value")).alias(value))
