"""Calendar functions as columns: dekads, period keys and labels, slots,
seasons, and how many steps a period should have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESOLUTIONS = ("daily", "dekadal", "monthly", "seasonal", "annual")


def days_in_month(d: Column) -> Column:
    return F.day(F.last_day(d))


def days_in_year(d: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31)))


def dekad(d: Column) -> Column:
    """1 for days 1-10, 2 for 11-20, 3 for the rest of the month."""
    return F.least(F.lit(3), F.floor((F.day(d) - 1) / 10).cast("int") + 1)


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def period_start(d: Column, res: str) -> Column:
    """First day of the period of resolution ``res`` that holds ``d``."""
    if res == "daily":
        return d
    if res == "dekadal":
        return F.date_add(month_start(d), (dekad(d) - 1) * 10)
    if res == "monthly":
        return month_start(d)
    if res == "annual":
        return F.trunc(d, "year")
    raise ValueError(f"no period of resolution {res!r}")


def period_end(d: Column, res: str) -> Column:
    """The last day of the period that ``d`` falls into."""
    start = period_start(d, res)
    if res == "daily":
        return start
    if res == "annual":
        return F.date_sub(F.add_months(start, 12), 1)
    if res == "monthly":
        return F.last_day(start)
    return F.when(F.day(start) == 21, F.last_day(start)).otherwise(F.date_add(start, 9))


def label(start: Column, res: str, length: int = 3) -> Column:
    """The name of the period that begins at ``start``."""
    if res == "daily":
        return F.date_format(start, "yyyy-MM-dd")
    if res == "dekadal":
        return F.concat(F.date_format(start, "yyyy-MM-"), dekad(start).cast("string"))
    if res == "monthly":
        return F.date_format(start, "yyyy-MM")
    if res == "annual":
        return F.date_format(start, "yyyy")
    return F.concat(F.date_format(start, "yyyy-MM"), F.lit("_"), F.date_format(F.add_months(start, length - 1), "yyyy-MM"))


def stamp(start: Column, res: str) -> Column:
    """The day that stands for a period in storage: 6, 16 or 26 of a dekad's
    month, 16 of a month."""
    if res == "dekadal":
        return F.date_add(start, 5)
    return F.date_add(start, 15) if res == "monthly" else start


def parse_label(text: Column, res: str) -> Column:
    """First day of the period that ``text`` names; null if it names none."""
    if res == "dekadal":
        good = F.when(text.rlike(r"^\d{4}-\d{2}-[123]$"), text)
        return F.date_add(F.to_date(F.substring(good, 1, 7), "yyyy-MM"), (F.substring(good, 9, 1).cast("int") - 1) * 10)
    pattern = {"daily": "yyyy-MM-dd", "monthly": "yyyy-MM", "annual": "yyyy", "seasonal": "yyyy-MM"}[res]
    return F.to_date(F.substring_index(text, "_", 1), pattern)


def steps(start: Column, out_res: str, in_res: str, length: int = 3) -> Column:
    """Input steps that a complete output period has."""
    months = {"monthly": 1, "seasonal": length, "annual": 12}
    if in_res == out_res:
        return F.lit(1)
    if in_res == "daily":
        if out_res == "dekadal":
            return F.when(dekad(start) < 3, 10).otherwise(days_in_month(start) - 20)
        return F.date_diff(F.add_months(start, months[out_res]), start)
    if in_res == "dekadal" and out_res in months:
        return F.lit(3 * months[out_res])
    if in_res == "monthly" and out_res in ("seasonal", "annual"):
        return F.lit(months[out_res])
    raise ValueError(f"{in_res} steps do not add up to {out_res} periods")


def days(start: Column, end: Column) -> Column:
    """All days from ``start`` to ``end``."""
    return F.sequence(start, end, F.expr("interval 1 day"))


def days_of(start: Column, res: str) -> Column:
    """All days of the period that begins at ``start``."""
    if res == "dekadal":
        return days(start, F.date_add(start, steps(start, "dekadal", "daily") - 1))
    return days(start, F.date_add(F.add_months(start, 12 if res == "annual" else 1), -1))


def months(start: Column, end: Column) -> Column:
    return F.sequence(month_start(start), month_start(end), F.expr("interval 1 month"))


def dekads(start: Column, end: Column) -> Column:
    """First days of all dekads from ``start`` to ``end``."""
    every = F.flatten(F.transform(months(start, end), lambda m: F.array(m, F.date_add(m, 10), F.date_add(m, 20))))
    return F.filter(every, lambda d: (d >= period_start(start, "dekadal")) & (d <= end))


def slot(d: Column, res: str) -> Column:
    """The place in the year that a climatology groups by: 1 to 365 (29
    February is 28 February's), 1 to 36, 1 to 12, or 1."""
    if res == "daily":
        leap = F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31))) == 366
        return F.dayofyear(d) - F.when(leap & (F.dayofyear(d) > 59), 1).otherwise(0)
    if res == "dekadal":
        return (F.month(d) - 1) * 3 + dekad(d)
    return F.month(d) if res in ("monthly", "seasonal") else F.lit(1)


def _md(d: Column) -> Column:
    return F.month(d) * 100 + F.day(d)


def in_season(d: Column, first: int, last: int) -> Column:
    """Whether the day lies from ``first`` to ``last``, numbers month * 100 +
    day; the season runs over the year's end if ``first`` comes later."""
    md = _md(d)
    return md.between(first, last) if first <= last else (md >= first) | (md <= last)


def season_year(d: Column, first: int, last: int) -> Column:
    """The year in which the season of day ``d`` begins."""
    return F.year(d) if first <= last else F.year(d) - F.when(_md(d) >= first, 0).otherwise(1)


def season_day(year: Column, md: int) -> Column:
    """Day ``md`` of ``year``; 29 February is the 28th of a common year."""
    first = F.make_date(year, F.lit(md // 100), F.lit(1))
    return F.least(F.date_add(first, md % 100 - 1), F.last_day(first))


def season_span(year: Column, first: int, last: int) -> tuple[Column, Column]:
    return season_day(year, first), season_day(year if first <= last else year + 1, last)


def season_length(year: Column, first: int, last: int) -> Column:
    start, end = season_span(year, first, last)
    return F.date_diff(end, start) + 1


def season_label(year: Column, first: int, last: int) -> Column:
    start, end = season_span(year, first, last)
    return F.concat_ws("_", F.date_format(start, "yyyy-MM-dd"), F.date_format(end, "yyyy-MM-dd"))


def slot_label(number: Column, res: str, first_year: int, last_year: int, length: int = 3) -> Column:
    """``Y1-Y2_`` and the slot's name."""
    start = F.make_date(F.lit(2001), F.lit(1), F.lit(1))
    at = {
        "daily": F.date_format(F.date_add(start, number - 1), "MM-dd"),
        "dekadal": F.concat(F.date_format(F.add_months(start, F.floor((number - 1) / 3).cast("int")), "MM-"), ((number - 1) % 3 + 1).cast("string")),
        "monthly": F.date_format(F.add_months(start, number - 1), "MM"),
        "seasonal": F.concat_ws("_", F.date_format(F.add_months(start, number - 1), "MM"), F.date_format(F.add_months(start, number + length - 2), "MM")),
        "annual": F.lit("annual"),
    }[res]
    return F.concat(F.lit(f"{first_year}-{last_year}_"), at)


def days_since_1970(d: Column) -> Column:
    return F.date_diff(d, F.make_date(F.lit(1970), F.lit(1), F.lit(1)))


def months_since_1970(d: Column) -> Column:
    return (F.year(d) - 1970) * 12 + F.month(d) - 1


def file_date(name: Column, pattern: str) -> Column:
    """The date in a file name, by a pattern with %Y, %m, %d and, for dekads
    1 to 3, %-d; null where the name does not fit."""
    import re

    parts = re.split(r"(%Y|%m|%-d|%d)", pattern)
    digits = {"%Y": r"(\d{4})", "%m": r"(\d{2})", "%d": r"(\d{2})", "%-d": r"([123])"}
    regex = "^" + "".join(digits.get(p) or re.escape(p) for p in parts) + "$"
    order = [p for p in parts if p in digits]
    get = lambda p: F.try_element_at(F.regexp_extract_all(name, F.lit(regex), F.lit(order.index(p) + 1)), F.lit(1))
    year, month = get("%Y"), get("%m") if "%m" in order else F.lit("01")
    if "%-d" in order:
        return F.date_add(F.to_date(F.concat_ws("-", year, month, F.lit("01"))), (get("%-d").cast("int") - 1) * 10 + 5)
    whole = F.concat_ws("-", year, month, get("%d") if "%d" in order else F.lit("16" if "%m" in order else "01"))
    return F.when(F.regexp_like(name, F.lit(regex)), F.to_date(whole))
