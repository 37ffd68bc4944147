"""Statistics as columns: moments by name, exceedance, regression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .compare import compare


def nan_to_null(v: Column) -> Column:
    """Missing is null everywhere: NaN would sort above all numbers."""
    return F.when(~F.isnan(v), v)


def reducer(name: str, v: Column, op: str = ">=", threshold: float = 1.0) -> Column:
    """The aggregate of that name; the sum of nothing is 0, as are counts."""
    return {
        "sum": lambda: F.coalesce(F.sum(v), F.lit(0.0)),
        "mean": lambda: F.avg(v),
        "median": lambda: F.median(v),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "stdev": lambda: F.stddev_pop(v),
        "count": lambda: F.count_if(compare(v, op, threshold)).cast("double"),
    }[name]()


def exceedance(values: Column, threshold: float | Column) -> Column:
    """Probability that ``threshold`` is exceeded, from a sorted array of
    observations, by Weibull plotting positions.

    The k-th of n values has (n - k + 1) / (n + 1), of equal values the first;
    between values it is interpolated. Beyond the ends it runs linearly to 1 or
    0 within one median step. Null for fewer than three values."""
    t = F.lit(float(threshold)) if not isinstance(threshold, Column) else threshold
    n = F.size(values)
    place = lambda x: (n - F.array_position(values, x) + 1) / (n + 1)
    low, high = F.array_max(F.filter(values, lambda x: x <= t)), F.array_min(F.filter(values, lambda x: x >= t))
    first, last = F.array_min(values), F.array_max(values)
    gaps = F.array_sort(F.transform(F.sequence(F.lit(2), n), lambda i: F.element_at(values, i) - F.element_at(values, i - 1)))
    m = n - 1
    step = (F.element_at(gaps, F.floor((m + 1) / 2).cast("int")) + F.element_at(gaps, F.floor(m / 2).cast("int") + 1)) / 2
    below = F.when(t < first - step, 1.0).otherwise(place(first) + (first - t) / step * (1 - place(first)))
    above = F.when(t > last + step, 0.0).otherwise(place(last) - (t - last) / step * place(last))
    between = F.when(low == high, place(low)).otherwise(place(low) + (t - low) / (high - low) * (place(high) - place(low)))
    # try_divide is not needed: a step of 0 never reaches the division.
    return F.when(n < 3, None).when(t < first, below).when(t > last, above).otherwise(between)


def two_sided_t(t: Column, df: Column) -> Column:
    """P(|T| > |t|) of Student's distribution with whole ``df``, by its finite
    series in the angle atan(t / sqrt(df))."""
    a = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    c2 = F.cos(a) * F.cos(a)
    odd = df % 2 == 1
    count = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    # Terms: 1, then times c2 * (2k) / (2k + 1) if df is odd, c2 * (2k - 1) / (2k) if even.
    series = F.aggregate(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, k: F.when(k < count, F.struct((s["term"] * c2 * F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))).alias("term"), (s["sum"] + s["term"] * c2 * F.when(odd, 2.0 * k / (2.0 * k + 1)).otherwise((2.0 * k - 1) / (2.0 * k))).alias("sum"))).otherwise(s),
        lambda s: s["sum"],
    )
    inside = F.when(odd, 2 / math.pi * (a + F.when(count > 0, F.sin(a) * F.cos(a) * series).otherwise(0.0))).otherwise(F.sin(a) * series)
    return F.greatest(F.lit(0.0), 1 - inside)
