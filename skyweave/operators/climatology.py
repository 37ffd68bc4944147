"""Statistics across years, for each slot of the year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions import calendar as C
from skyweave.functions.compare import compare
from skyweave.functions.stats import exceedance, two_sided_t

SLOTS = {"daily": 365, "dekadal": 36, "monthly": 12, "seasonal": 12, "annual": 1}


def slots(series: DataFrame, res: str, first_year: int, last_year: int, window: int = 0, time: str = "period") -> DataFrame:
    """``series`` with ``slot`` and ``year``, within the base period.

    Seasons may end in the year after the last. A daily climatology takes
    ``window`` days on either side of each day too, across the ends of years
    and of the base period: a row goes to the slots of the days around it."""
    t = F.col(time)
    if res == "daily":
        near = series if not window else series.withColumn("_day", F.explode(F.transform(F.sequence(F.lit(-window), F.lit(window)), lambda k: F.date_add(t, k))))
        day = F.col("_day") if window else t
        # 29 February has no slot of its own: around it, only the row itself counts.
        leap = (F.month(day) == 2) & (F.day(day) == 29)
        out = near.where(~leap | (day == t)) if window else near
        return out.withColumn("slot", C.slot(day, "daily")).withColumn("year", F.year(day)).where(F.col("year").between(first_year, last_year)).drop("_day")
    return series.withColumn("slot", C.slot(t, res)).withColumn("year", F.year(t)).where(F.col("year").between(first_year, last_year))


#: Statistics that follow from moments of parts.
FROM_PARTS = ("mean", "stdev", "cv", "min", "max", "frequency")


def _targets(t: Column, first_year: int, last_year: int, window: int) -> Column:
    """The slots that a day's value goes to: those of the days around it, as
    :func:`slots` has them."""
    near = F.transform(F.sequence(F.lit(-window), F.lit(window)), lambda k: F.date_add(t, k))
    leap = lambda d: (F.month(d) == 2) & (F.day(d) == 29)
    good = F.filter(near, lambda d: (~leap(d) | (d == t)) & F.year(d).between(first_year, last_year))
    return F.transform(good, lambda d: C.slot(d, "daily"))


def windowed(series: DataFrame, keys: list[str], value: str, first_year: int, last_year: int, window: int, time: str = "time", op: str = ">=", threshold: float = 1.0) -> DataFrame:
    """``(keys…, slot, n, mean, stdev, min, max, hits)`` of a daily climatology
    with ``window`` days on either side.

    Days that go to the same slots are summed up first, over all years: some
    four hundred rows a key. Those, not the days, go to the slots around them,
    where their moments are merged without sums of squares. Such days have
    month and day in common and, where the window reaches as far, whether there
    is a 29 February and at which end of the base period they are."""
    v, t = F.col(value), F.col(time)
    year, day = F.year(t), F.dayofyear(t)
    leap = F.when(F.abs(day - 60) <= window + 1, F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366).otherwise(F.lit(False))
    edge = F.when((day <= window) | (day > 365 - window) | ~year.between(first_year, last_year), year).otherwise(F.lit(0))
    alike = [(F.month(t) * 100 + F.day(t)).alias("_md"), leap.alias("_leap"), edge.alias("_edge")]
    sums = series.where(year.between(first_year - 1, last_year + 1)).groupBy(*keys, *alike).agg(
        F.min(t).alias("_one"),
        F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(compare(v, op, threshold)).alias("hits")
    )
    near = sums.withColumn("slot", F.explode(_targets(F.col("_one"), first_year, last_year, window))).groupBy(*keys, "slot").agg(
        F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("n", "mean", "m2")))).alias("_all"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("hits").alias("hits")
    )
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merge(a: Column, b: Column) -> Column:
        n, off = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + off * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + off * off * a["n"] * b["n"] / n).alias("m2"))

    done = near.withColumn("_m", F.aggregate("_all", none, merge))
    some = F.col("_m.n") > 0
    return done.select(*keys, "slot", F.col("_m.n").alias("n"), F.when(some, F.col("_m.mean")).alias("mean"), F.when(some, F.sqrt(F.col("_m.m2") / F.col("_m.n"))).alias("stdev"), "min", "max", "hits")


def windowed_statistic(found: DataFrame, keys: list[str], name: str, min_years: int = 30) -> DataFrame:
    """``(keys…, slot, n, value)`` from :func:`windowed`, for a name in
    ``FROM_PARTS``; for ``mean-stdev`` two rows each, as :func:`mean_stdev`."""
    n = F.col("n")
    if name == "mean-stdev":
        two = F.stack(F.lit(2), F.lit("mean"), F.col("mean"), F.lit("stdev"), F.col("stdev")).alias("stat", "value")
        return found.select(*keys, "slot", "n", two).withColumn("value", F.when(n >= min_years, F.col("value")))
    value = {"cv": F.coalesce(100 * F.try_divide(F.col("stdev"), F.col("mean")), F.lit(0.0)), "frequency": F.try_divide(100.0 * F.col("hits"), n)}.get(name, F.col(name if name in found.columns else "mean"))
    return found.select(*keys, "slot", "n", F.when(n >= min_years, value).alias("value"))


def statistic(v: Column, name: str, op: str = ">=", threshold: float = 1.0, percent: list[float] = (50.0,)) -> Column:
    n = F.count(v)
    return {
        "mean": lambda: F.avg(v),
        "median": lambda: F.median(v),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "stdev": lambda: F.stddev_pop(v),
        "cv": lambda: F.coalesce(100 * F.try_divide(F.stddev_pop(v), F.avg(v)), F.lit(0.0)),
        "frequency": lambda: F.try_divide(100.0 * F.count_if(compare(v, op, threshold)), n),
        "percentile": lambda: F.percentile(v, F.lit(percent[0] / 100)),
    }[name]()


def climatology(series: DataFrame, keys: list[str], value: str, name: str, min_years: int = 30, **how) -> DataFrame:
    """``(keys…, n, value)`` with ``keys`` including the slot, if any. Null
    where fewer than ``min_years`` values are there."""
    v = F.col(value)
    return series.groupBy(*keys).agg(F.count(v).alias("n"), F.when(F.count(v) >= min_years, statistic(v, name, **how)).alias("value"))


def mean_stdev(series: DataFrame, keys: list[str], value: str, min_years: int = 30) -> DataFrame:
    """As :func:`climatology`, two rows each with ``stat`` mean and stdev."""
    v = F.col(value)
    both = series.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stdev"))
    return both.select(*keys, "n", F.stack(F.lit(2), F.lit("mean"), F.col("mean"), F.lit("stdev"), F.col("stdev")).alias("stat", "value")).withColumn("value", F.when(F.col("n") >= min_years, F.col("value")))


def percentiles(series: DataFrame, keys: list[str], value: str, percent: list[float], min_years: int = 30) -> DataFrame:
    """One row for each percentile, named in ``stat``; linear between values."""
    v = F.col(value)
    found = series.groupBy(*keys).agg(F.count(v).alias("n"), F.percentile(v, F.array(*[F.lit(p / 100) for p in percent])).alias("all"))
    # Not the array is exploded, which is null without values, but the names.
    named = found.select(*keys, "n", "all", F.posexplode(F.array(*[F.lit(f"{p:g}%") for p in percent])).alias("_k", "stat"))
    return named.select(*keys, "n", "stat", F.when(F.col("n") >= min_years, F.col("all")[F.col("_k")]).alias("value"))


def probability(series: DataFrame, keys: list[str], value: str, threshold: float, exceeding: bool = True, percent: bool = True, min_years: int = 30) -> DataFrame:
    """Probability of exceeding ``threshold``, or of not. A key's values, one a
    year, are sorted in its group."""
    v = F.col(value)
    found = series.groupBy(*keys).agg(F.count(v).alias("n"), F.array_sort(F.collect_list(v)).alias("all"))
    p = exceedance(F.col("all"), threshold) * (100.0 if percent else 1.0)
    p = p if exceeding else (100.0 if percent else 1.0) - p
    return found.select(*keys, "n", F.when(F.col("n") >= min_years, p).alias("value"))


METRICS = ("slope", "std.slope", "t-value.slope", "p-value.slope", "intercept", "std.intercept", "t-value.intercept", "p-value.intercept", "r2", "sigma")


def trend(series: DataFrame, keys: list[str], value: str, first_year: int, last_year: int, min_years: int = 30, unit: str = "perYear") -> DataFrame:
    """Least squares of ``value`` on the year's number in the base period, one
    column for each of ``METRICS``, dots as underscores.

    Mean and variance of the years are those of the whole base period, whether
    or not a year has a value; with gaps the slope thus differs from that of
    the pairs. Units: ``perYear``, ``overPeriod`` (times the years) or
    ``percPeriod`` (that in percent of the mean)."""
    x, y = (F.col("year") - first_year).cast("double"), F.col(value)
    count = last_year - first_year + 1
    mean_x, var_x = (count - 1) / 2, count * (count + 1) / 12
    # Centred sums: raw ones cancel where the mean is large.
    sums = series.where(F.col("year").between(first_year, last_year) & y.isNotNull()).groupBy(*keys).agg(
        F.count(y).alias("n"), F.avg(y).alias("my"), F.avg(x).alias("mx"), F.covar_samp(x, y).alias("_cov"), F.var_samp(y).alias("var_y"), F.var_samp(x).alias("var_own")
    )
    n = F.col("n")
    ok = (n >= min_years) & (n >= 3)
    step = sums.withColumn("cov", F.when(ok, F.col("_cov")))
    step = step.withColumn("slope", F.col("cov") / var_x).withColumn("intercept", F.col("my") - F.col("slope") * mean_x)
    b = F.col("slope")
    off = F.col("mx") - mean_x
    sse = (n - 1) * (F.col("var_y") - 2 * b * F.col("cov") + b * b * F.col("var_own")) + n * b * b * off * off
    step = step.withColumn("sigma", F.when(sse.isNotNull(), F.sqrt(F.greatest(sse, F.lit(0.0)) / (n - 2))))
    step = step.withColumn("std_slope", F.col("sigma") / ((count - 1) * var_x) ** 0.5)
    step = step.withColumn("std_intercept", F.col("sigma") * F.sqrt(1 / n + mean_x**2 / ((count - 1) * var_x)))
    for k in ("slope", "intercept"):
        step = step.withColumn(f"t_value_{k}", F.try_divide(F.col(k), F.col(f"std_{k}")))
        t = F.col(f"t_value_{k}")
        step = step.withColumn(f"p_value_{k}", F.when(t.isNotNull(), two_sided_t(t, n - 2)))
    step = step.withColumn("r2", F.try_divide(F.col("cov") * F.col("cov"), var_x * F.col("var_y")))
    scale = {"perYear": F.lit(1.0), "overPeriod": n.cast("double"), "percPeriod": F.try_divide(100.0 * n, F.col("my"))}[unit]
    step = step.withColumn("slope", b * scale)
    return step.select(*keys, "n", *[m.replace(".", "_").replace("-", "_") for m in METRICS])


def fill_slots(found: DataFrame, keys: list[str], res: str) -> DataFrame:
    """``found`` with a row for every key and slot; those without values null."""
    spark = found.sparkSession
    every = spark.range(1, SLOTS[res] + 1).select(F.col("id").cast("int").alias("slot"))
    rest = [k for k in keys if k != "slot"]
    grid = found.select(*rest).distinct().join(every)
    return grid.join(found, [*rest, "slot"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
