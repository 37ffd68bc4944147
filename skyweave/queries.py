"""Every operator as a query over the shipped tables, with the same in SQL.

The grid is the one that ``lineitem`` gives rise to; 1995 to 2000 are the base
period. Dates are labels, statistics are rounded to six decimals, so that
either engine's results compare as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions import calendar as C
from skyweave.operators import anomaly as A
from skyweave.operators import climatology as K
from skyweave.operators import derive as D
from skyweave.operators import resample as R
from skyweave.operators import season as S
from skyweave.operators import summed as T
from skyweave.operators import support as P
from skyweave.plans import incremental, materialise, responses, results
from skyweave.plans.engine import Engine, materialise_climatologies
from skyweave.plans.specs import BBox, Climatology, Original, Points, Polygons, SeasonIndex, Series
from skyweave.session import shared_dir
from skyweave.sources import cube
from skyweave.sources import grid as G
from skyweave.sources import manifest as M
from skyweave.sources import places as L
from skyweave.sources import sinks
from skyweave.streaming import derived

CELL = ["lat_i", "lon_i"]
FIRST, LAST, YEARS = 1995, 2000, 5
THRESHOLD, SPELL, FRACTION = 20.0, 3, 0.5
SPRING, WINTER, HARVEST = (301, 531), (1101, 228), (1015, 120)
BOX = (30.4, -1.6, 31.6, -0.4)
POINTS = [("A", 30.5, -1.5), ("B", 31.25, -0.75), ("C", 50.0, 10.0)]
RING = [(30.2, -1.8), (31.8, -1.7), (31.4, -0.2), (30.3, -0.4), (30.2, -1.8)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WET = """
WITH wet AS (
  SELECT *, CAST(-2.0 + 0.5 * lat_i AS DOUBLE) AS lat, CAST(30.0 + 0.5 * lon_i AS DOUBLE) AS lon FROM (
    SELECT CAST(l_shipdate AS DATE) AS time, CAST(floor((l_partkey % 25) / 5.0) AS INT) AS lat_i, CAST(l_partkey % 5 AS INT) AS lon_i,
           CAST(CAST(sum(l_quantity) AS BIGINT) % 50 AS DOUBLE) AS precip, min(l_quantity) AS tmin, max(l_quantity) AS tmax
    FROM lineitem GROUP BY 1, 2, 3)),
days AS (SELECT CAST(unnest(generate_series(CAST(min(time) AS TIMESTAMP), CAST(max(time) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS time FROM wet),
dense AS (
  SELECT c.lat_i, c.lon_i, d.time, w.precip, w.tmin, w.tmax
  FROM (SELECT DISTINCT lat_i, lon_i FROM wet) c CROSS JOIN days d LEFT JOIN wet w ON w.lat_i = c.lat_i AND w.lon_i = c.lon_i AND w.time = d.time)"""


def query(name: str, sql: str | None):
    """Register a query; ``sql`` goes on from the tables ``wet``, ``days`` and
    ``dense``."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"{WET} {sql}" if sql.lstrip().startswith("SELECT") else f"{WET}, {sql}"
        return f

    return keep


def r6(c: str | object, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def day(name: str = "time"):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


wet = G.weather
AXES = P.Axes(G.LAT0, G.LON0, G.STEP, G.STEP, 5, 5)


# Scans and filters.

query("obs_daily", "SELECT strftime(time, '%Y-%m-%d') AS time, lat_i, lon_i, lat, lon, precip, tmin, tmax FROM wet")(
    lambda s, d: wet(s, d).select(day(), "lat_i", "lon_i", "lat", "lon", "precip", "tmin", "tmax")
)


@query("time_range", "SELECT strftime(time, '%Y-%m-%d') AS time, lat_i, lon_i, precip FROM wet WHERE time BETWEEN DATE '1997-03-01' AND DATE '1997-05-31'")
def time_range(s, d):
    return R.time_range(wet(s, d), "1997-03-01", "1997-05-31").select(day(), *CELL, "precip")


@query("bbox", "SELECT strftime(time, '%Y-%m-%d') AS time, lat_i, lon_i, tmax FROM wet WHERE lon BETWEEN 30.4 AND 31.6 AND lat BETWEEN -1.6 AND -0.4")
def bbox(s, d):
    return P.bbox(wet(s, d), *BOX).select(day(), *CELL, "tmax")


def _points(pad: int):
    return lambda s, d: P.point_cells(AXES, L.sites(s, POINTS), pad)


def observed(chosen, s, d) -> DataFrame:
    """Of a support's cells those that have been observed, and on how many days."""
    return wet(s, d).join(chosen(s, d), CELL).groupBy("site", *CELL).agg(F.count("time").alias("n_days"))


_SITES = "(VALUES ('A', CAST(30.5 AS DOUBLE), CAST(-1.5 AS DOUBLE)), ('B', 31.25, -0.75), ('C', 50.0, 10.0)) AS s(loc, x, y)"


def _near(pad: int) -> str:
    reach = (pad + 0.5) * G.STEP
    return f"SELECT loc AS site, lat_i, lon_i FROM (SELECT DISTINCT lat_i, lon_i, lat, lon FROM wet) c JOIN {_SITES} ON abs(lon - x) <= {reach} AND abs(lat - y) <= {reach}"


def _observed(chosen: str) -> str:
    return f"SELECT site, lat_i, lon_i, count(*) AS n_days FROM wet JOIN {chosen} USING (lat_i, lon_i) GROUP BY 1, 2, 3"


for _pad in (0, 1):
    query(f"points_pad{_pad}", _observed(f"({_near(_pad)})"))(lambda s, d, pad=_pad: observed(_points(pad), s, d))

_RING = ", ".join(f"({i}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for i, (x, y) in enumerate(RING))
_INSIDE = f"""ring AS (SELECT * FROM (VALUES {_RING}) AS r(i, x, y)),
inside AS (
  SELECT c.lat_i, c.lon_i FROM (SELECT DISTINCT lat_i, lon_i, lat, lon FROM wet) c
  JOIN (SELECT a.x AS ax, a.y AS ay, b.x AS zx, b.y AS zy FROM ring a JOIN ring b ON b.i = a.i + 1) e
    ON (ay > lat) <> (zy > lat) AND lon < ax + (lat - ay) / (zy - ay) * (zx - ax)
  GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


def zone_cells(s, d):
    return P.polygon_cells(AXES, L.zones(s, {"zone": [RING]}))


def zone_runs(s, d):
    return P.polygon_runs(AXES, L.zones(s, {"zone": [RING]}))


query("polygon_cells", f"{_INSIDE} {_observed("(SELECT 'zone' AS site, lat_i, lon_i FROM inside)")}")(lambda s, d: observed(zone_cells, s, d))
query("polygon_runs", f"{_INSIDE} SELECT 'zone' AS site, strftime(time, '%Y-%m-%d') AS time, count(*) AS n_cells, sum(precip) AS precip FROM wet JOIN inside USING (lat_i, lon_i) GROUP BY time")(
    lambda s, d: P.on_runs(wet(s, d), zone_runs(s, d)).groupBy("site", "time").agg(F.count("*").alias("n_cells"), F.sum("precip").alias("precip")).select("site", day(), "n_cells", "precip")
)


@query(
    "polygon_mask",
    f"{_INSIDE} SELECT strftime(time, '%Y-%m-%d') AS time, w.lat_i, w.lon_i, CASE WHEN i.lat_i IS NOT NULL THEN precip END AS precip FROM wet w LEFT JOIN inside i ON i.lat_i = w.lat_i AND i.lon_i = w.lon_i",
)
def polygon_mask(s, d):
    return P.mask(wet(s, d), zone_cells(s, d), "precip").select(day(), *CELL, "precip")


def _md(first: int, last: int) -> tuple[str, str, str]:
    """SQL of membership, season year and length of a season."""
    md = "(month(time) * 100 + day(time))"
    if first <= last:
        a, b = (f"make_date(season_year, {x // 100}, {x % 100})" for x in (first, last))
        return f"{md} BETWEEN {first} AND {last}", "CAST(year(time) AS INT)", f"(date_diff('day', {a}, {b}) + 1)"
    a, b = f"make_date(season_year, {first // 100}, {first % 100})", f"make_date(season_year + 1, {last // 100}, {last % 100})"
    return f"({md} >= {first} OR {md} <= {last})", f"CAST(year(time) - CASE WHEN {md} >= {first} THEN 0 ELSE 1 END AS INT)", f"(date_diff('day', {a}, {b}) + 1)"


for _name, _span in (("season_days", SPRING), ("season_days_wrap", WINTER)):
    _in, _sy, _ = _md(*_span)
    query(_name, f"SELECT strftime(time, '%Y-%m-%d') AS time, lat_i, lon_i, {_sy} AS season_year, precip FROM wet WHERE {_in}")(
        lambda s, d, span=_span: S.season_days(wet(s, d), S.Season(*span)).select(day(), *CELL, "season_year", "precip")
    )


def stored(s, d, variable: str = "precip") -> DataFrame:
    """A variable in the form that stores keep."""
    return wet(s, d).select(F.lit("obs").alias("dataset"), F.lit("daily").alias("res"), F.lit(variable).alias("variable"), "time", *CELL, "lat", "lon", F.col(variable).alias("value"))


@query("append_unseen", "SELECT strftime(time, '%Y-%m-%d') AS time, lat_i, lon_i, precip AS value FROM wet WHERE time >= DATE '2001-01-01' OR lat_i >= 3")
def append_unseen(s, d):
    # The store has all rows up to 2000 of three of the grid's rows, by its bitmaps.
    obs = stored(s, d)
    return M.missing(obs, M.days(obs.where("time < date'2001-01-01' and lat_i < 3"))).select(day(), *CELL, "value")


@query("store_round_trip", "SELECT strftime(time, '%Y-%m-%d') AS time, lat_i, lon_i, precip AS value FROM wet")
def store_round_trip(s, d):
    """Two appends that overlap, kept in the store's layout, and all rows back."""
    path = f"{shared_dir(s)}/store-{uuid.uuid4().hex}"
    G.append_unseen(stored(s, d).where("time < date'1999-01-01'"), path)
    G.append_unseen(stored(s, d).where("time >= date'1998-01-01' or lon_i > 2"), path)
    return G.read_obs(s, path, "obs", "daily", "precip").select(day(), *CELL, "value")


@query(
    "store_coverage",
    """SELECT 'obs' AS dataset, 'daily' AS res, variable, round(min(lon), 6) AS west, round(max(lon), 6) AS east, round(min(lat), 6) AS south, round(max(lat), 6) AS north, 0.5::DOUBLE AS step_lon, 0.5::DOUBLE AS step_lat,
    count(DISTINCT time) AS n_times, count(*) AS n_rows, strftime(min(time), '%Y-%m-%d') AS start, strftime(max(time), '%Y-%m-%d') AS "end" FROM (SELECT *, unnest(['precip', 'tmax']) AS variable FROM wet) WHERE variable = 'precip' OR month(time) > 6 GROUP BY variable""",
)
def store_coverage(s, d):
    return M.coverage(M.days(stored(s, d).unionByName(stored(s, d, "tmax").where("month(time) > 6"))))


_CUBE = "time BETWEEN DATE '1998-06-01' AND DATE '1999-02-10' AND lat BETWEEN -1.5 AND 0 AND lon >= 31"


@query("zarr_box", f"SELECT strftime(time, '%Y-%m-%d') AS time, d.lat_i, d.lon_i, precip AS value FROM (SELECT *, CAST(-2.0 + 0.5 * lat_i AS DOUBLE) AS lat, CAST(30.0 + 0.5 * lon_i AS DOUBLE) AS lon FROM dense WHERE time IN (SELECT time FROM wet)) d WHERE {_CUBE}")
def zarr_box(s, d):
    """The whole grid appended to a Zarr store in two blocks of time, then a box of some months of it."""
    path = f"{shared_dir(s)}/cube-{uuid.uuid4().hex}"
    obs = stored(s, d)
    for part in (obs.where("time < date'1999-01-01'"), obs):
        cube.append_cube(part, path, "precip", AXES, (128, 2, 3), "<f8")
    return cube.read_cube(s, path, "precip").where(_CUBE.replace("DATE ", "date")).select(day(), *CELL, "value")


@query(
    "dataset_info",
    """SELECT 'obs' AS dataset, round(min(lon), 6) AS west, round(max(lon), 6) AS east, round(min(lat), 6) AS south, round(max(lat), 6) AS north,
    round((max(lon) - min(lon)) / (count(DISTINCT lon) - 1), 6) AS step_lon, round((max(lat) - min(lat)) / (count(DISTINCT lat) - 1), 6) AS step_lat,
    count(DISTINCT time) AS n_times, strftime(min(time), '%Y-%m-%d') AS start, strftime(max(time), '%Y-%m-%d') AS "end" FROM wet""",
)
def dataset_info(s, d):
    return G.info(wet(s, d).withColumn("dataset", F.lit("obs")), ["dataset"])


query("grid_axis", "SELECT DISTINCT 'lat' AS axis, lat_i AS i, lat AS coord FROM wet UNION ALL SELECT DISTINCT 'lon', lon_i, lon FROM wet")(lambda s, d: G.grid_axis(wet(s, d)))

# The calendar.

_MONTH = "CAST(date_trunc('month', time) AS DATE)"
_DEKAD = "CAST(least(3, (day(time) - 1) // 10 + 1) AS INT)"
_DEKAD_START = f"CAST({_MONTH} + CAST(({_DEKAD} - 1) * 10 AS INT) AS DATE)"
_DOY = "CAST(dayofyear(time) - CASE WHEN month(time) > 2 AND day(last_day(make_date(year(time), 2, 1))) = 29 THEN 1 WHEN month(time) = 2 AND day(time) = 29 THEN 1 ELSE 0 END AS INT)"


@query(
    "calendar",
    f"""SELECT strftime(time, '%Y-%m-%d') AS time, {_DEKAD} AS dekad, strftime(time, '%Y-%m-') || {_DEKAD} AS dekad_label, strftime({_DEKAD_START}, '%Y-%m-%d') AS dekad_start,
    CAST(day(last_day(time)) AS INT) AS month_days, CAST(dayofyear(make_date(year(time), 12, 31)) AS INT) AS year_days, {_DOY} AS slot_daily,
    CAST((month(time) - 1) * 3 AS INT) + {_DEKAD} AS slot_dekadal, CAST(month(time) AS INT) AS slot_monthly, strftime({_MONTH} + INTERVAL 3 MONTH, '%Y-%m') AS plus_3,
    CAST(date_diff('day', DATE '1970-01-01', time) AS INT) AS days_1970, CAST(date_diff('month', DATE '1970-01-01', time) AS INT) AS months_1970 FROM days""",
)
def calendar(s, d):
    t = F.col("time")
    span = wet(s, d).agg(F.min("time").alias("a"), F.max("time").alias("b"))
    return span.select(F.explode(C.days(F.col("a"), F.col("b"))).alias("time")).select(
        day(), C.dekad(t).alias("dekad"), C.label(t, "dekadal").alias("dekad_label"), F.date_format(C.period_start(t, "dekadal"), "yyyy-MM-dd").alias("dekad_start"),
        C.days_in_month(t).alias("month_days"), C.days_in_year(t).alias("year_days"), C.slot(t, "daily").alias("slot_daily"), C.slot(t, "dekadal").alias("slot_dekadal"), C.slot(t, "monthly").alias("slot_monthly"),
        F.date_format(F.add_months(C.month_start(t), 3), "yyyy-MM").alias("plus_3"), C.days_since_1970(t).alias("days_1970"), C.months_since_1970(t).cast("int").alias("months_1970"),
    )


# Temporal aggregation.

_FN = {"sum": "coalesce(sum({v}), 0)", "mean": "avg({v})", "median": "median({v})", "min": "min({v})", "max": "max({v})", "count": "CAST(count(*) FILTER ({v} >= 20) AS DOUBLE)"}
_PERIOD = {"dekadal": _DEKAD_START, "monthly": _MONTH, "annual": "CAST(date_trunc('year', time) AS DATE)"}
_EXPECTED = {
    "dekadal": "(CASE WHEN day(period) < 21 THEN 10 ELSE day(last_day(period)) - 20 END)",
    "monthly": "day(last_day(period))",
    "annual": "dayofyear(make_date(year(period), 12, 31))",
    "seasonal": "date_diff('day', period, CAST(period + INTERVAL 3 MONTH AS DATE))",
}
_GOOD = {"R4": "n_valid / expected >= 0.5", "R1": "(expected - (steps - n_valid)) / expected >= 0.5", "R2": "(steps - n_valid) / expected < 0.5"}


def _label(res: str) -> str:
    return {"dekadal": "strftime(period, '%Y-%m-') || CAST(least(3, (day(period) - 1) // 10 + 1) AS INT)", "monthly": "strftime(period, '%Y-%m')", "annual": "strftime(period, '%Y')", "seasonal": "strftime(period, '%Y-%m') || '_' || strftime(period + INTERVAL 2 MONTH, '%Y-%m')"}[res]


def _resample_sql(rows: str, res: str, function: str, expected: str, good: str = _GOOD["R4"], fraction: str = "0.5", out: str = "period", keys: str = "lat_i, lon_i") -> str:
    """A chain of tables that ends in ``made(keys, period, n_valid, value)``."""
    return f"""dated AS ({rows}),
have AS (SELECT period, count(DISTINCT time) AS steps FROM dated GROUP BY 1),
summed AS (SELECT {keys}, period, count(v) AS n_valid, {_FN[function].format(v="v")} AS value FROM dated GROUP BY {keys}, period),
made AS (
  SELECT {keys}, period, n_valid, CASE WHEN {good} THEN value END AS value
  FROM (SELECT s.*, h.steps, CAST({expected} AS DOUBLE) AS expected FROM summed s JOIN (SELECT period AS p, steps FROM have) h ON h.p = s.period)
  WHERE steps / expected >= {fraction})"""


def _daily(res: str, v: str = "precip") -> str:
    return f"SELECT lat_i, lon_i, time, {_PERIOD[res]} AS period, {v} AS v FROM wet"


def _show(res: str) -> str:
    return f"SELECT lat_i, lon_i, {_label(res)} AS label, n_valid, round(value, 6) AS value FROM made"


def shown(df: DataFrame, value: str, res: str, *keys: str) -> DataFrame:
    return df.select(*(keys or CELL), C.label(F.col("period"), res).alias("label"), "n_valid", r6(value, "value"))


def _resampled(name: str, res: str, function: str, mode: str = "R4") -> None:
    sql = f"{_resample_sql(_daily(res), res, function, _EXPECTED[res], _GOOD.get(mode, 'true'))}"
    if mode == "R3":
        sql += f", best AS (SELECT lat_i AS a, lon_i AS b, max(n_valid / CAST({_EXPECTED[res]} AS DOUBLE)) AS best FROM made GROUP BY 1, 2) SELECT lat_i, lon_i, {_label(res)} AS label, n_valid, round(CASE WHEN best >= 0.5 THEN value END, 6) AS value FROM made JOIN best ON a = lat_i AND b = lon_i"
    else:
        sql += " " + _show(res)
    query(name, sql)(lambda s, d: shown(R.resample(wet(s, d), CELL, "precip", res, function, mode=mode, min_frac=FRACTION, op=">=", threshold=THRESHOLD), "precip", res))


_resampled("to_dekad_sum", "dekadal", "sum")
for _f in ("sum", "mean", "median", "min", "max", "count"):
    _resampled(f"to_month_{_f}", "monthly", _f)
for _m in ("R1", "R2", "R3", "R4"):
    _resampled(f"complete_{_m.lower()}", "monthly", "sum", _m)


def _again(df: DataFrame, value: str = "precip") -> DataFrame:
    """A resampled series as input of the next resolution."""
    return df.select(*CELL, F.col("period").alias("time"), value)


_THEN = "SELECT lat_i, lon_i, period AS time, {p} AS period, value AS v FROM made"


def _chain(res: str, then: str, expected: str, period: str) -> str:
    first = _resample_sql(_daily(res), res, "sum", _EXPECTED[res])
    second = _resample_sql(_THEN.format(p=period.replace("time", "period")), then, "sum", expected).replace("dated", "dated2").replace("have", "have2").replace("summed", "summed2").replace("made AS (\n", "made2 AS (\n")
    return f"{first}, {second} " + _show(then).replace("FROM made", "FROM made2")


@query("dekad_to_month_sum", _chain("dekadal", "monthly", "3", _MONTH))
def dekad_to_month_sum(s, d):
    first = R.resample(wet(s, d), CELL, "precip", "dekadal", "sum", min_frac=FRACTION)
    return shown(R.resample(_again(first), CELL, "precip", "monthly", "sum", "dekadal", min_frac=FRACTION), "precip", "monthly")


def months(s, d, function: str = "sum", value: str = "precip") -> DataFrame:
    return R.resample(wet(s, d), CELL, value, "monthly", function, min_frac=FRACTION)


@query("month_to_annual_sum", _chain("monthly", "annual", "12", _PERIOD["annual"]))
def month_to_annual_sum(s, d):
    return shown(R.resample(_again(months(s, d)), CELL, "precip", "annual", "sum", "monthly", min_frac=FRACTION), "precip", "annual")


_INTO = "(month(time) + 9) % 12"  # months since March
_SEASON = f"SELECT lat_i, lon_i, time, CAST({_MONTH} - to_months(CAST({_INTO} AS INT)) AS DATE) AS period, precip AS v FROM wet WHERE {_INTO} < 3"
_ROLLING = f"SELECT lat_i, lon_i, time, CAST({_MONTH} - to_months(CAST(k AS INT)) AS DATE) AS period, precip AS v FROM wet CROSS JOIN (VALUES (0), (1), (2)) AS x(k)"
query("to_season_sum", _resample_sql(_SEASON, "seasonal", "sum", _EXPECTED["seasonal"]) + " " + _show("seasonal"))(
    lambda s, d: shown(R.resample(wet(s, d), CELL, "precip", "seasonal", "sum", min_frac=FRACTION, season_start=3), "precip", "seasonal")
)
query("rolling_season_sum", _resample_sql(_ROLLING, "seasonal", "sum", _EXPECTED["seasonal"]) + " " + _show("seasonal"))(
    lambda s, d: shown(R.resample(wet(s, d), CELL, "precip", "seasonal", "sum", min_frac=FRACTION, full_year=True), "precip", "seasonal")
)

# Means over supports.

_CHOSEN = {
    "rect": "chosen AS (SELECT DISTINCT 'rectangle' AS site, lat_i, lon_i FROM wet WHERE lon BETWEEN 30.4 AND 31.6 AND lat BETWEEN -1.6 AND -0.4)",
    "points": f"chosen AS ({_near(0)})",
    "poly": f"{_INSIDE}, chosen AS (SELECT 'zone' AS site, lat_i, lon_i FROM inside)",
}
_FETCH = {
    "rect": lambda s, d: P.bbox_cells(s, AXES, *BOX),
    "points": _points(0),
    "poly": zone_cells,
}


def site_months(s, d, kind: str) -> DataFrame:
    series = P.spatial_mean(wet(s, d), _FETCH[kind](s, d), ["precip"], ["time"])
    return R.resample(series, ["site"], "precip", "monthly", "mean", min_frac=FRACTION)


def _site_sql(kind: str) -> str:
    rows = f"SELECT site, time, {_MONTH} AS period, avg(precip) AS v FROM wet JOIN chosen USING (lat_i, lon_i) GROUP BY site, time"
    return f"{_CHOSEN[kind]}, {_resample_sql(rows, 'monthly', 'mean', _EXPECTED['monthly'], keys='site')}"


for _kind in _FETCH:
    query(f"{_kind}_mean_month", f"{_site_sql(_kind)} SELECT site, {_label('monthly')} AS label, n_valid, round(value, 6) AS value FROM made")(
        lambda s, d, kind=_kind: shown(site_months(s, d, kind), "precip", "monthly", "site")
    )

SPAN = "site string, west double, south double, east double, north double"


@query("rect_mean_summed", f"{_site_sql('rect')} SELECT site, {_label('monthly')} AS label, n_valid, round(value, 6) AS value FROM made")
def rect_mean_summed(s, d):
    """The rectangle's mean by four corners of a summed-area table."""
    box = T.boxes(AXES, s.createDataFrame([("rectangle", *BOX)], SPAN))
    series = T.box_mean(T.summed_area(wet(s, d), AXES, ["precip"]), box, ["precip"])
    return shown(R.resample(series, ["site"], "precip", "monthly", "mean", min_frac=FRACTION), "precip", "monthly", "site")


# Climatologies.

_SLOT = {"dekadal": "CAST((month(period) - 1) * 3 + least(3, (day(period) - 1) // 10 + 1) AS INT)", "monthly": "CAST(month(period) AS INT)", "seasonal": "CAST(month(period) AS INT)", "annual": "1"}
_STAT = {
    "mean": "avg(value)", "median": "median(value)", "min": "min(value)", "max": "max(value)", "stdev": "stddev_pop(value)",
    "cv": "coalesce(100 * stddev_pop(value) / nullif(avg(value), 0), 0)", "frequency": "100.0 * count(*) FILTER (value >= 600) / nullif(count(value), 0)",
}


def _based(res: str, rows: str | None = None, expected: str | None = None) -> str:
    return f"{_resample_sql(rows or _daily(res), res, 'sum', expected or _EXPECTED[res])}, based AS (SELECT *, {_SLOT[res]} AS slot, year(period) AS year FROM made WHERE year(period) BETWEEN 1995 AND 2000)"


def _clim(table: str, stat: str, keys: str = "lat_i, lon_i, slot") -> str:
    return f"SELECT {keys}, count(value) AS n, round(CASE WHEN count(value) >= 5 THEN {stat} END, 6) AS value FROM {table} GROUP BY {keys}"


def based(s, d, res: str = "monthly", **season) -> DataFrame:
    made = R.resample(wet(s, d), CELL, "precip", res, "sum", min_frac=FRACTION, **season)
    return K.slots(made, res, FIRST, LAST)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


for _stat, _sql in _STAT.items():
    query(f"clim_month_{_stat}", f"{_based('monthly')} {_clim('based', _sql)}")(
        lambda s, d, stat=_stat: rounded(K.climatology(based(s, d), [*CELL, "slot"], "precip", stat, YEARS, threshold=600.0))
    )

query("clim_month_exceeded", f"{_based('monthly')} {_clim('based', '100.0 * count(*) FILTER (value > 700) / nullif(count(value), 0)')}")(
    lambda s, d: rounded(K.climatology(based(s, d), [*CELL, "slot"], "precip", "frequency", YEARS, op=">", threshold=700.0))
)


@query("clim_month_taken_in", f"{_based('monthly')} {_clim('based', _STAT['median'])}")
def clim_month_taken_in(s, d):
    """Medians of a table that took in the years in two parts, one of them in both."""
    path, keys = f"{shared_dir(s)}/years-{uuid.uuid4().hex}", [*CELL, "slot"]
    yearly = based(s, d).select(*keys, "year", F.col("precip").alias("value"))
    incremental.take_in(yearly.where("year <= 1998"), keys, path)
    return rounded(incremental.statistic(incremental.take_in(yearly.where("year >= 1998"), keys, path), keys, "median", YEARS))


query(
    "clim_month_mean_stdev",
    f"{_based('monthly')} SELECT lat_i, lon_i, slot, n, stat, round(CASE WHEN n >= 5 THEN value END, 6) AS value FROM (SELECT lat_i, lon_i, slot, count(value) AS n, avg(value) AS m, stddev_pop(value) AS sd FROM based GROUP BY 1, 2, 3) t, LATERAL (SELECT 'mean' AS stat, m AS value UNION ALL SELECT 'stdev', sd) u",
)(lambda s, d: rounded(K.mean_stdev(based(s, d), [*CELL, "slot"], "precip", YEARS)))
query(
    "clim_month_percentiles",
    f"{_based('monthly')}, pcts AS (SELECT lat_i, lon_i, slot, count(value) AS n, quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM based GROUP BY 1, 2, 3) SELECT lat_i, lon_i, slot, n, p || '%' AS stat, round(CASE WHEN n >= 5 THEN q[k] END, 6) AS value FROM pcts CROSS JOIN (VALUES (1, '5'), (2, '25'), (3, '50'), (4, '75'), (5, '95')) AS x(k, p)",
)(lambda s, d: rounded(K.percentiles(based(s, d), [*CELL, "slot"], "precip", [5, 25, 50, 75, 95], YEARS)))
query("clim_dekad_mean", f"{_based('dekadal')} {_clim('based', _STAT['mean'])}")(lambda s, d: rounded(K.climatology(based(s, d, "dekadal"), [*CELL, "slot"], "precip", "mean", YEARS)))
query("clim_annual_mean", f"{_based('annual')} {_clim('based', _STAT['mean'])}")(lambda s, d: rounded(K.climatology(based(s, d, "annual"), [*CELL, "slot"], "precip", "mean", YEARS)))
query("clim_season_mean", f"{_based('seasonal', _ROLLING)} {_clim('based', _STAT['mean'])}")(
    lambda s, d: rounded(K.climatology(based(s, d, "seasonal", full_year=True), [*CELL, "slot"], "precip", "mean", YEARS))
)
query(
    "clim_filled",
    f"{_based('monthly')}, one AS ({_clim('based', _STAT['mean'])}) SELECT c.lat_i, c.lon_i, k.slot, coalesce(n, 0) AS n, value FROM (SELECT DISTINCT lat_i, lon_i FROM one) c CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INT) AS slot) k LEFT JOIN one o ON o.lat_i = c.lat_i AND o.lon_i = c.lon_i AND o.slot = k.slot",
)(lambda s, d: rounded(K.fill_slots(K.climatology(based(s, d), [*CELL, "slot"], "precip", "mean", YEARS), [*CELL, "slot"], "monthly")))


def _daily_clim(window: int) -> str:
    near = "SELECT w.*, CAST(w.time + CAST(k AS INT) AS DATE) AS near FROM wet w CROSS JOIN (SELECT unnest(range(-%d, %d)) AS k) x" % (window, window + 1)
    slot = _DOY.replace("time", "near")
    return f"near AS ({near}), based AS (SELECT lat_i, lon_i, precip AS value, {slot} AS slot, year(near) AS year FROM near WHERE year(near) BETWEEN 1995 AND 2000 AND (NOT (month(near) = 2 AND day(near) = 29) OR near = time)) {_clim('based', _STAT['mean'])}"


for _w in (0, 2):
    query(f"clim_daily_w{_w}", _daily_clim(_w))(
        lambda s, d, w=_w: rounded(K.windowed_statistic(K.windowed(wet(s, d), CELL, "precip", FIRST, LAST, w), CELL, "mean", YEARS) if w else K.climatology(K.slots(wet(s, d), "daily", FIRST, LAST, w, "time"), [*CELL, "slot"], "precip", "mean", YEARS))
    )

_PROB = """sorted AS (SELECT {keys}, list_sort(list(value) FILTER (value IS NOT NULL)) AS v, count(value) AS n FROM {table} GROUP BY {keys}),
gaps AS (SELECT *, list_aggregate([v[i + 1] - v[i] FOR i IN range(1, n)], 'median') AS step, list_aggregate([x FOR x IN v IF x <= {t}], 'max') AS lo, list_aggregate([x FOR x IN v IF x >= {t}], 'min') AS hi, v[1] AS a, v[n] AS b FROM sorted),
prob AS (SELECT {keys}, n, CASE WHEN n < 3 THEN NULL
  WHEN {t} < a THEN CASE WHEN {t} < a - step THEN 1.0 ELSE n / (n + 1.0) + (a - {t}) / step * (1 - n / (n + 1.0)) END
  WHEN {t} > b THEN CASE WHEN {t} > b + step THEN 0.0 ELSE (n - list_position(v, b) + 1) / (n + 1.0) * (1 - ({t} - b) / step) END
  WHEN lo = hi THEN (n - list_position(v, lo) + 1) / (n + 1.0)
  ELSE (n - list_position(v, lo) + 1) / (n + 1.0) + ({t} - lo) / (hi - lo) * ((list_position(v, lo) - list_position(v, hi)) / (n + 1.0)) END AS p FROM gaps)"""


def _prob(table: str, keys: str, t: float, expression: str) -> str:
    return f"{_PROB.format(table=table, keys=keys, t=f'CAST({t} AS DOUBLE)')} SELECT {keys}, n, round(CASE WHEN n >= 5 THEN {expression} END, 6) AS value FROM prob"


for _name, _exc, _e in (("clim_prob_exc", True, "CAST(100 * p AS DOUBLE)"), ("clim_prob_noexc", False, "CAST(100 - 100 * p AS DOUBLE)")):
    query(_name, f"{_based('monthly')}, {_prob('based', 'lat_i, lon_i, slot', 700.0, _e)}")(lambda s, d, exc=_exc: rounded(K.probability(based(s, d), [*CELL, "slot"], "precip", 700.0, exc, min_years=YEARS)))

_TREND = """sums AS (SELECT {keys}, count(value) AS n, avg(value) AS my, sum((year - 1995) * value) AS xy, CAST(sum(year - 1995) AS DOUBLE) AS sx, sum(value) AS sy, sum(value * value) AS yy
  FROM {table} WHERE value IS NOT NULL GROUP BY {keys}),
covs AS (SELECT *, CASE WHEN n >= 5 THEN (xy - my * sx - 2.5 * (sy - n * my)) / (n - 1) END AS cov FROM sums)
SELECT {keys}, n, round(cov / 3.5, 6) AS slope, round(my - cov / 3.5 * 2.5, 6) AS intercept, round(cov * cov / nullif(3.5 * ((yy - n * my * my) / (n - 1)), 0), 6) AS r2 FROM covs"""


def trends(s, d) -> DataFrame:
    return K.trend(based(s, d), [*CELL, "slot"], "precip", FIRST, LAST, YEARS)


query("clim_trend_slope", f"{_based('monthly')}, " + _TREND.format(table="based", keys="lat_i, lon_i, slot"))(
    lambda s, d: trends(s, d).select(*CELL, "slot", "n", r6("slope", "slope"), r6("intercept", "intercept"), r6("r2", "r2"))
)


# Two-sided probabilities of Student's t with three and four degrees of freedom, in closed form.
_P = """CASE n WHEN 5 THEN 1 - 2 / pi() * (abs({t}) / sqrt(3) / (1 + {t} * {t} / 3) + atan(abs({t}) / sqrt(3)))
  WHEN 6 THEN 1 - 0.75 * abs({t}) / sqrt(1 + {t} * {t} / 4) * (1 - {t} * {t} / (12 * (1 + {t} * {t} / 4))) END"""
_SUMS = _TREND.format(table="based", keys="lat_i, lon_i, slot").split("\nSELECT")[0]


@query(
    "clim_trend_full",
    f"""{_based('monthly')}, {_SUMS},
fits AS (SELECT lat_i, lon_i, slot, n, cov, cov / 3.5 AS slope, my - cov / 3.5 * 2.5 AS intercept FROM covs),
errors AS (
  SELECT lat_i, lon_i, slot, sqrt(sum((value - intercept - slope * (year - 1995)) * (value - intercept - slope * (year - 1995))) / (any_value(n) - 2)) AS sigma, var_samp(value) AS var_y
  FROM fits JOIN based USING (lat_i, lon_i, slot) WHERE value IS NOT NULL AND cov IS NOT NULL GROUP BY 1, 2, 3),
known AS (SELECT f.*, sigma, var_y, sigma / sqrt(5 * 3.5) AS std_slope, sigma * sqrt(CAST(1 AS DOUBLE) / n + 6.25 / (5 * 3.5)) AS std_intercept FROM fits f LEFT JOIN errors USING (lat_i, lon_i, slot)),
tested AS (SELECT *, slope / nullif(std_slope, 0) AS t_slope, intercept / nullif(std_intercept, 0) AS t_intercept FROM known)
SELECT lat_i, lon_i, slot, n, round(slope, 6) AS slope, round(std_slope, 6) AS std_slope, round(t_slope, 6) AS t_value_slope, round({_P.format(t='t_slope')}, 6) AS p_value_slope, round(intercept, 6) AS intercept,
  round(std_intercept, 6) AS std_intercept, round(t_intercept, 6) AS t_value_intercept, round({_P.format(t='t_intercept')}, 6) AS p_value_intercept, round(cov * cov / nullif(3.5 * var_y, 0), 6) AS r2, round(sigma, 6) AS sigma FROM tested""",
)
def clim_trend_full(s, d):
    found = trends(s, d)
    return found.select(*CELL, "slot", "n", *[r6(c, c) for c in found.columns[4:]])


# Seasons given by days.

_MEANT = "(tmin + tmax) / 2"
_INDEX = {
    "tot_rain": ("TotRain", "precip", "coalesce(sum(v), 0)"),
    "rain_int": ("RainInt", "precip", "sum(v) FILTER (v >= 20) / nullif(count(*) FILTER (v >= 20), 0)"),
    "num_wd": ("NumWD", "precip", "count(*) FILTER (v >= 20)"),
    "num_dd": ("NumDD", "precip", "count(*) FILTER (v < 20)"),
    "mean_temp": ("MeanTemp", _MEANT, "avg(v)"),
    "min_temp": ("MinTemp", "tmin", "avg(v)"),
    "max_temp": ("MaxTemp", "tmax", "avg(v)"),
    "num_cd": ("NumCD", "tmin", "count(*) FILTER (v < 20)"),
    "num_hd": ("NumHD", "tmax", "count(*) FILTER (v >= 20)"),
    "cdd": ("CDD", _MEANT, "coalesce(sum(greatest(v - 18, 0)), 0)"),
    "hdd": ("HDD", _MEANT, "coalesce(sum(CASE WHEN v IS NULL THEN 0 ELSE greatest(18 - v, 0) END), 0)"),
    "gdd": ("GDD", _MEANT, "coalesce(sum(CASE WHEN v IS NULL THEN 0 ELSE greatest(v - 10, 0) END), 0)"),
}
_INDEX["cdd"] = ("CDD", _MEANT, "coalesce(sum(CASE WHEN v IS NULL THEN 0 ELSE greatest(v - 18, 0) END), 0)")
_SPELLS = {"num_ds": ("NumDS", "v < 20"), "num_ws": ("NumWS", "v >= 20"), "long_ds": ("LongDS", "v < 20"), "long_ws": ("LongWS", "v >= 20")}


def season_of(name: str, span=HARVEST) -> S.Season:
    return S.Season(*span, threshold=THRESHOLD, spell=SPELL, base=10.0 if name == "GDD" else 18.0, min_frac=FRACTION)


def indexed(s, d, name: str, span=HARVEST) -> DataFrame:
    return S.index(wet(s, d), CELL, name, season_of(name, span))


def _season_sql(value: str, aggregate: str, span=HARVEST) -> str:
    inside, year, whole = _md(*span)
    return f"""seasoned AS (SELECT lat_i, lon_i, {year} AS season_year, time, {value} AS v FROM dense WHERE {inside}),
counted AS (SELECT lat_i, lon_i, season_year, count(*) AS days, count(v) AS n_valid, {aggregate} AS x FROM seasoned GROUP BY 1, 2, 3),
indices AS (SELECT lat_i, lon_i, season_year, n_valid, CASE WHEN days / CAST({whole} AS DOUBLE) >= 0.5 AND n_valid / CAST({whole} AS DOUBLE) >= 0.5 THEN CAST(x AS DOUBLE) END AS value FROM counted)"""


for _q, (_n, _v, _a) in _INDEX.items():
    query(_q, f"{_season_sql(_v, _a)} SELECT lat_i, lon_i, season_year, n_valid, round(value, 6) AS value FROM indices")(lambda s, d, n=_n: rounded(indexed(s, d, n)))

for _q, (_n, _hit) in _SPELLS.items():
    _in, _sy, _whole = _md(*HARVEST)
    _pick = f"sum(floor(length / CAST({SPELL} AS DOUBLE)))" if _n.startswith("Num") else "max(length)"
    query(
        _q,
        f"""seasoned AS (SELECT lat_i, lon_i, {_sy} AS season_year, time, precip AS v, coalesce({_hit.replace('v', 'precip')}, false) AS hit FROM dense WHERE {_in}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lat_i, lon_i, season_year ORDER BY time) - row_number() OVER (PARTITION BY lat_i, lon_i, season_year, hit ORDER BY time) AS island FROM seasoned),
runs AS (SELECT lat_i, lon_i, season_year, count(*) FILTER (hit) AS length, count(*) AS days, count(v) AS valid FROM numbered GROUP BY lat_i, lon_i, season_year, hit, island),
counted AS (SELECT lat_i, lon_i, season_year, sum(days) AS days, CAST(sum(valid) AS BIGINT) AS n_valid, {_pick} AS x FROM runs GROUP BY 1, 2, 3)
SELECT lat_i, lon_i, season_year, n_valid, CASE WHEN days / CAST({_whole} AS DOUBLE) >= 0.5 AND n_valid / CAST({_whole} AS DOUBLE) >= 0.5 THEN CAST(x AS DOUBLE) END AS value FROM counted""",
    )(lambda s, d, n=_n: indexed(s, d, n))

query("month_season_precip", f"{_season_sql('precip', 'coalesce(sum(v), 0)', WINTER)} SELECT lat_i, lon_i, season_year, n_valid, round(value, 6) AS value FROM indices")(
    lambda s, d: rounded(S.month_season(wet(s, d), CELL, "precip", "sum", 11, 2, FRACTION))
)

_RAIN = _season_sql("precip", "coalesce(sum(v), 0)", SPRING)
_RAIN_BASE = f"{_RAIN}, based AS (SELECT *, season_year AS year FROM indices WHERE season_year BETWEEN 1995 AND 2000)"


def spring(s, d) -> DataFrame:
    return indexed(s, d, "TotRain", SPRING)


def spring_base(s, d) -> DataFrame:
    return spring(s, d).where(F.col("season_year").between(FIRST, LAST)).withColumnRenamed("season_year", "year")


query(
    "clim_tot_rain_mean_stdev",
    f"{_RAIN_BASE} SELECT lat_i, lon_i, n, stat, round(CASE WHEN n >= 5 THEN value END, 6) AS value FROM (SELECT lat_i, lon_i, count(value) AS n, avg(value) AS m, stddev_pop(value) AS sd FROM based GROUP BY 1, 2) t, LATERAL (SELECT 'mean' AS stat, m AS value UNION ALL SELECT 'stdev', sd) u",
)(lambda s, d: rounded(K.mean_stdev(spring_base(s, d), CELL, "value", YEARS)))
query("clim_tot_rain_prob_exc", f"{_RAIN_BASE}, {_prob('based', 'lat_i, lon_i', 1400.0, 'CAST(100 * p AS DOUBLE)')}")(lambda s, d: rounded(K.probability(spring_base(s, d), CELL, "value", 1400.0, min_years=YEARS)))

_DEPART = {
    "difference": "round(value - m, 2)",
    "percentage": "round(CASE WHEN value IS NULL OR m IS NULL THEN NULL WHEN m < 1e-4 THEN 0 ELSE 100 * (value - m) / m END, 2)",
    "standardized": "round(CASE WHEN value IS NULL OR sd IS NULL THEN NULL WHEN sd < 1e-4 THEN 0 ELSE (value - m) / sd END, 4)",
}


def _depart(table: str, base: str, keys: str, shown_: str, kind: str) -> str:
    on = " AND ".join(f"c.{k} = t.{k}" for k in keys.split(", "))
    return f"climate AS (SELECT {keys}, CASE WHEN count(value) >= 5 THEN avg(value) END AS m, CASE WHEN count(value) >= 5 THEN stddev_pop(value) END AS sd FROM {base} GROUP BY {keys}) SELECT {shown_}, {_DEPART[kind]} AS value FROM {table} t LEFT JOIN climate c ON {on}"


for _k in A.KINDS:

    @query(f"anom_month_{_k}", f"{_based('monthly')}, slotted AS (SELECT *, CAST(month(period) AS INT) AS slot FROM made), " + _depart("slotted", "based", "lat_i, lon_i, slot", "t.lat_i, t.lon_i, strftime(period, '%Y-%m') AS label", _k))
    def anom_month(s, d, kind=_k):
        series = months(s, d).withColumn("slot", C.slot(F.col("period"), "monthly"))
        out = A.anomaly(series, series.where(F.year("period").between(FIRST, LAST)), [*CELL, "slot"], "precip", kind, YEARS)
        return out.select(*CELL, C.label(F.col("period"), "monthly").alias("label"), F.col("precip").alias("value"))

    @query(f"anom_daily_index_{_k}", f"{_RAIN_BASE}, " + _depart("indices", "based", "lat_i, lon_i", "t.lat_i, t.lon_i, season_year", _k))
    def anom_index(s, d, kind=_k):
        series = spring(s, d)
        return A.anomaly(series, series.where(F.col("season_year").between(FIRST, LAST)), CELL, "value", kind, YEARS).select(*CELL, "season_year", "value")


# Derived variables.

_RA = "greatest(37.58603 * (1 + 0.033 * cos(f)) * (ws * sin(phi) * sin(delta) + cos(phi) * cos(delta) * sin(ws)), 0)"


def _radiated(slot: str, columns: str) -> str:
    return f"""turned AS (SELECT *, 2 * pi() * {slot} / 365 AS f, radians(lat) AS phi FROM wet),
tilted AS (SELECT *, 0.409 * sin(f - 1.39) AS delta FROM turned),
risen AS (SELECT *, acos(greatest(-1, least(1, -tan(phi) * tan(delta)))) AS ws FROM tilted),
lit AS (SELECT *, {_RA} AS ra FROM risen) SELECT {columns}"""


_KEYS = "strftime(time, '%Y-%m-%d') AS time, lat_i, lon_i"
_DEKAD_DOY = _DOY.replace("time", f"CAST({_DEKAD_START} + 5 AS DATE)")


@query("tmean", f"SELECT {_KEYS}, CASE WHEN lat_i > 0 AND month(time) > 1 THEN (tmin + tmax) / 2 END AS tmean FROM wet WHERE lat_i > 0 OR month(time) > 1")
def tmean(s, d):
    # Either input lacks a part of the grid or of the year.
    obs = wet(s, d)
    return D.tmean(obs.where("lat_i > 0"), obs.where("month(time) > 1")).select(day(), *CELL, "tmean")


query("ra_daily", _radiated(_DOY, f"{_KEYS}, round(ra, 6) AS ra FROM lit"))(lambda s, d: wet(s, d).select(day(), *CELL, r6(D.radiation_on(F.col("time"), F.col("lat")), "ra")))
query("ra_dekadal", _radiated(_DEKAD_DOY, f"{_KEYS}, round(ra, 6) AS ra FROM lit"))(lambda s, d: wet(s, d).select(day(), *CELL, r6(D.radiation_on(F.col("time"), F.col("lat"), "dekadal"), "ra")))


def _inputs(s, d) -> DataFrame:
    obs = wet(s, d)
    return D.et0_inputs(obs, obs, obs).withColumn("ra", D.radiation_on(F.col("time"), F.col("lat")))


query(
    "et0_modified",
    _radiated(_DOY, f"{_KEYS}, round(0.0019 * 0.408 * ra * ((tmax + tmin) / 2 + 21.0584) * pow(greatest(greatest(tmax - tmin, 0) - 0.0874 * precip, 0), 0.6278), 6) AS et0 FROM lit"),
)(lambda s, d: _inputs(s, d).select(day(), *CELL, r6(D.et0_modified(F.col("tmin"), F.col("tmax"), F.col("precip"), F.col("ra")), "et0")))
query("et0_fao", _radiated(_DOY, f"{_KEYS}, round(0.0023 * 0.408 * ra * ((tmax + tmin) / 2 + 17.8) * sqrt(greatest(tmax - tmin, 0)), 6) AS et0 FROM lit"))(
    lambda s, d: _inputs(s, d).select(day(), *CELL, r6(D.et0_fao(F.col("tmin"), F.col("tmax"), F.col("ra")), "et0"))
)


@query(
    "computed_et0",
    _radiated(_DOY, f"{_KEYS}, round(0.0019 * 0.408 * ra * ((tmax + tmin) / 2 + 21.0584) * pow(greatest(greatest(tmax - tmin, 0) - 0.0874 * precip, 0), 0.6278), 6) AS et0 FROM lit WHERE time < DATE '2000-01-01' OR lat_i <> 2"),
)
def computed_et0(s, d):
    """The variable kept in a store, computed in two goes from what is kept there."""
    path = f"{shared_dir(s)}/store-{uuid.uuid4().hex}"
    for v in ("tmin", "tmax", "precip"):
        rows = stored(s, d, v)
        G.append_unseen(rows.where("time < date'2000-01-01' or lat_i <> 2") if v == "tmax" else rows, path)
    for start in ("1999-07-01", None):
        materialise.materialise(s, path, "obs", "daily", ["et0"], start)
    return G.read_obs(s, path, "obs", "daily", "et0").select(day(), *CELL, r6("value", "et0"))


@query(
    "stream_et0",
    _radiated(_DOY, f"{_KEYS}, round(0.0019 * 0.408 * ra * ((tmax + tmin) / 2 + 21.0584) * pow(greatest(greatest(tmax - tmin, 0) - 0.0874 * precip, 0), 0.6278), 6) AS et0 FROM lit"),
)
def stream_et0(s, d):
    """Three streams of the whole grid, joined as they come."""
    path = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    three = []
    for v in ("tmin", "tmax", "precip"):
        rows = stored(s, d, v).select("time", *CELL, "lat", "lon", "value")
        rows.write.parquet(f"{path}/{v}")
        three.append(s.readStream.schema(rows.schema).parquet(f"{path}/{v}"))
    derived.et0(*three, late="90 days").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{path}/out").select(day(), *CELL, r6("value", "et0"))


@query(
    "regrid_bilinear",
    """fine AS (SELECT CAST(i AS INT) AS lat_i, CAST(j AS INT) AS lon_i, CAST(i AS DOUBLE) / 2 + 0.25 AS r, CAST(j AS DOUBLE) / 2 + 0.25 AS c FROM (SELECT unnest(range(0, 8)) AS i) CROSS JOIN (SELECT unnest(range(0, 8)) AS j)),
    corners AS (SELECT f.*, CAST(floor(r) AS INT) + a AS si, CAST(floor(c) AS INT) + b AS sj, (CASE WHEN a = 0 THEN 1 - (r - floor(r)) ELSE r - floor(r) END) * (CASE WHEN b = 0 THEN 1 - (c - floor(c)) ELSE c - floor(c) END) AS w
      FROM fine f CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS x(a, b)),
    found AS (SELECT time, k.lat_i, k.lon_i, CASE WHEN abs(sum(w) - 1) < 1e-9 THEN sum(w * precip) END AS precip FROM wet JOIN corners k ON k.si = wet.lat_i AND k.sj = wet.lon_i WHERE k.w > 0 GROUP BY 1, 2, 3)
    SELECT strftime(time, '%Y-%m-%d') AS time, lat_i, lon_i, round(precip, 6) AS precip FROM found""",
)
def regrid_bilinear(s, d):
    i, j = F.floor(F.col("id") / 8).cast("int"), (F.col("id") % 8).cast("int")
    target = s.range(64).select(i.alias("lat_i"), j.alias("lon_i"), (G.LAT0 + G.STEP * (i / 2 + 0.25)).alias("lat"), (G.LON0 + G.STEP * (j / 2 + 0.25)).alias("lon"))
    found = D.regrid(wet(s, d), target, "precip", G.LAT0, G.LON0, G.STEP, G.STEP, ["time"])
    return found.select(day(), *CELL, r6("precip", "precip"))


# Formats.


@query("csv_columns", f"{_resample_sql(_daily('monthly'), 'monthly', 'sum', _EXPECTED['monthly'])} SELECT strftime(period, '%Y-%m') AS label, CAST(-2.0 + 0.5 * lat_i AS DOUBLE) AS \"Latitude\", CAST(30.0 + 0.5 * lon_i AS DOUBLE) AS \"Longitude\", coalesce(round(value, 2), -9999) AS precip FROM made")
def csv_columns(s, d):
    grid = months(s, d).select(C.label(F.col("period"), "monthly").alias("label"), (G.LAT0 + G.STEP * F.col("lat_i")).alias("lat"), (G.LON0 + G.STEP * F.col("lon_i")).alias("lon"), "precip")
    return sinks.csv_columns(grid, "precip", lead=["label"])


def _series(s, d) -> DataFrame:
    return site_months(s, d, "points").select("site", C.label(F.col("period"), "monthly").alias("label"), F.col("precip").alias("value"))


_CDT = "coalesce(max(printf('%.2f', coalesce(value, -9999))) FILTER (site = '{0}'), '-9999.00') AS \"{0}\""


@query(
    "cdt_pivot",
    f"{_site_sql('points')} SELECT 'Longitude' AS \"Name\", '30.5' AS \"A\", '31.25' AS \"B\" UNION ALL SELECT 'Latitude', '-1.5', '-0.75' UNION ALL SELECT strftime(period, '%Y-%m'), {_CDT.format('A')}, {_CDT.format('B')} FROM made GROUP BY 1",
)
def cdt_pivot(s, d):
    return sinks.cdt(_series(s, d), L.sites(s, POINTS[:2]), ["A", "B"])


_NUM = "CASE WHEN {0} = floor({0}) THEN printf('%.1f', {0}) ELSE CAST({0} AS VARCHAR) END"
_POINTS_JSON = f"""{_site_sql('points')}, told AS (SELECT site, strftime(period, '%Y-%m') AS label, coalesce(round(value, 2), -9999) AS v FROM made)
SELECT site AS loc, '{{"Name":"' || site || '","Longitude":' || {_NUM.format('x')} || ',"Latitude":' || {_NUM.format('y')} || ',"Dates":["' || string_agg(label, '","' ORDER BY label) || '"],"Values":[' || string_agg({_NUM.format('v')}, ',' ORDER BY label) || ']}}' AS json
FROM told JOIN {_SITES} ON loc = site GROUP BY site, x, y"""
query("json_points", _POINTS_JSON)(lambda s, d: sinks.json_points(_series(s, d), L.sites(s, POINTS)))

_WIDE = "coalesce(round(max(value) FILTER (stat = '{0}'), 2), -9999) AS \"{0}\""
_TWO = "SELECT {k}, n, stat, CASE WHEN n >= 5 THEN value END AS value FROM (SELECT {k}, count(value) AS n, avg(value) AS m, stddev_pop(value) AS sd FROM {t} GROUP BY {k}) t, LATERAL (SELECT 'mean' AS stat, m AS value UNION ALL SELECT 'stdev', sd) u"


@query(
    "csv_climatology",
    f"""{_based('monthly')}, two AS ({_TWO.format(k='lat_i, lon_i, slot', t='based')})
    SELECT '1995-2000_' || lpad(CAST(slot AS VARCHAR), 2, '0') AS "Dates", CAST(-2.0 + 0.5 * lat_i AS DOUBLE) AS "Latitude", CAST(30.0 + 0.5 * lon_i AS DOUBLE) AS "Longitude", {_WIDE.format('mean')}, {_WIDE.format('stdev')} FROM two GROUP BY slot, lat_i, lon_i""",
)
def csv_climatology(s, d):
    found = K.mean_stdev(based(s, d), [*CELL, "slot"], "precip", YEARS).withColumn("label", C.slot_label(F.col("slot"), "monthly", FIRST, LAST))
    return sinks.climatology_columns(AXES.located(found), ["mean", "stdev"])


@query(
    "json_grid",
    f"""{_resample_sql(_daily('monthly'), 'monthly', 'sum', _EXPECTED['monthly'])}, told AS (SELECT strftime(period, '%Y-%m') AS label, CAST(-2.0 + 0.5 * lat_i AS DOUBLE) AS lat, CAST(30.0 + 0.5 * lon_i AS DOUBLE) AS lon, coalesce(round(value, 2), -9999) AS v FROM made)
    SELECT label, lat, '{{"label":"' || label || '","lat":' || {_NUM.format('lat')} || ',"lon":[' || string_agg({_NUM.format('lon')}, ',' ORDER BY lon) || '],"precip":[' || string_agg({_NUM.format('v')}, ',' ORDER BY lon) || ']}}' AS json FROM told GROUP BY label, lat""",
)
def json_grid(s, d):
    grid = AXES.located(months(s, d).withColumn("label", C.label(F.col("period"), "monthly")))
    return sinks.json_grid(grid, "precip")


# The requests over supports, as the engine makes them.

SUPPORTS = {
    "grid": (Original(), "lat_i, lon_i", None),
    "box": (BBox(*BOX), "lat_i, lon_i", "rect"),
    "rectangle": (BBox(*BOX, True), "site", "rect"),
    "points": (Points(tuple(POINTS[:2])), "site", "points"),
    "zone_cells": (Polygons({"zone": [RING]}), "lat_i, lon_i", "poly"),
    "zone_mean": (Polygons({"zone": [RING]}, True), "site", "poly"),
}


def engine(s, d) -> Engine:
    return Engine(wet(s, d), G.LAT0, G.LON0, G.STEP, G.STEP, rows=5, cols=5)


def _on(kind: str | None, keys: str) -> str:
    """Tables up to ``chosen``, and ``here``, the rows on a support."""
    if kind is None:
        return "here AS (SELECT lat_i, lon_i, time, precip FROM wet)"
    if keys == "site":
        return f"{_CHOSEN[kind]}, here AS (SELECT site, time, avg(precip) AS precip FROM wet JOIN chosen USING (lat_i, lon_i) GROUP BY 1, 2)"
    return f"{_CHOSEN[kind]}, here AS (SELECT lat_i, lon_i, time, precip FROM wet JOIN (SELECT DISTINCT lat_i, lon_i FROM chosen) c USING (lat_i, lon_i))"


def _raw_sql(kind: str | None, keys: str, function: str = "sum") -> str:
    rows = f"SELECT {keys}, time, {_MONTH} AS period, precip AS v FROM here WHERE time BETWEEN DATE '1995-01-01' AND DATE '2000-12-31'"
    return f"{_on(kind, keys)}, {_resample_sql(rows, 'monthly', function, _EXPECTED['monthly'], keys=keys)}"


def _index_sql(kind: str | None, keys: str) -> str:
    """Rain of the season 15 October to 20 January on a support."""
    inside, year, whole = _md(*HARVEST)
    return f"""{_on(kind, keys)}, ends AS (SELECT min(time) AS a, max(time) AS b FROM here),
every AS (SELECT k.*, d.time, h.precip AS v FROM (SELECT DISTINCT {keys} FROM here) k CROSS JOIN (SELECT time FROM days, ends WHERE time BETWEEN a AND b) d LEFT JOIN here h ON h.time = d.time AND {' AND '.join(f'h.{x} = k.{x}' for x in keys.split(', '))}),
counted AS (SELECT {keys}, {year} AS season_year, count(*) AS days, count(v) AS n_valid, coalesce(sum(v), 0) AS x FROM every WHERE {inside} GROUP BY ALL),
indices AS (SELECT {keys}, season_year, n_valid, CASE WHEN days / CAST({whole} AS DOUBLE) >= 0.5 AND n_valid / CAST({whole} AS DOUBLE) >= 0.5 THEN CAST(x AS DOUBLE) END AS value FROM counted)"""


@query("climatology_kept", f"{_raw_sql('rect', 'lat_i, lon_i')}, based AS (SELECT *, CAST(month(period) AS INT) AS slot FROM made) SELECT lat_i, lon_i, slot, n, stat, round(value, 6) AS value FROM ({_TWO.format(k='lat_i, lon_i, slot', t='based')})")
def climatology_kept(s, d):
    """A box's climatology from a store, asked for twice: the second time it is read."""
    path = f"{shared_dir(s)}/kept-{uuid.uuid4().hex}"
    G.append_unseen(stored(s, d), f"{path}/store")
    known = results.of_store(s, f"{path}/store", "obs", "daily", ("precip",), G.LAT0, G.LON0, G.STEP, G.STEP, rows=5, cols=5)
    asked = Series("precip", "monthly", f"{FIRST}-01-01", f"{LAST}-12-31", BBox(*BOX), min_frac=FRACTION), Climatology("mean-stdev", FIRST, LAST, YEARS)
    kept = results.Results(known, f"{path}/store", f"{path}/results")
    kept.request("climatology", *asked)
    return rounded(kept.find("climatology", *asked))


@query("clim_lookup", f"{_raw_sql(None, 'lat_i, lon_i')}, based AS (SELECT *, CAST(month(period) AS INT) AS slot FROM made), own AS ({_TWO.format(k='lat_i, lon_i, slot', t='based')}), {_CHOSEN['rect']} SELECT site, slot, round(avg(value), 6) AS value FROM own JOIN chosen USING (lat_i, lon_i) WHERE stat = 'stdev' GROUP BY 1, 2")
def clim_lookup(s, d):
    """A box's mean of a statistic that is kept by cell."""
    path = f"{shared_dir(s)}/clim-{uuid.uuid4().hex}"
    e = engine(s, d)
    materialise_climatologies(e, [Series("precip", "monthly", f"{FIRST}-01-01", f"{LAST}-12-31", min_frac=FRACTION)], path, FIRST, LAST, YEARS)
    return rounded(e.lookup(path, "precip", "monthly", "stdev", BBox(*BOX, True)))


@query(
    "response_json",
    f"""{_raw_sql('rect', 'site', 'max')}, told AS (SELECT site, strftime(period, '%Y-%m') AS label, coalesce(round(value, 2), -9999) AS v FROM made)
SELECT site AS loc, '{{"Name":"rectangle","Longitude":31.0,"Latitude":-1.0,"Dates":["' || string_agg(label, '","' ORDER BY label) || '"],"Values":[' || string_agg({_NUM.format('v')}, ',' ORDER BY label) || ']}}' AS json FROM told GROUP BY site""",
)
def response_json(s, d):
    return responses.respond(engine(s, d), "json", "raw", Series("precip", "monthly", f"{FIRST}-01-01", f"{LAST}-12-31", BBox(*BOX, True), function="max", min_frac=FRACTION)).rows


_LISTS = "{0}[' || string_agg({1}, ',' ORDER BY slot) FILTER (stat = '{2}') || ']"


@query(
    "response_climatology_json",
    f"""{_raw_sql('points', 'site')}, based AS (SELECT *, CAST(month(period) AS INT) AS slot FROM made), two AS (SELECT site, slot, stat, coalesce(round(value, 2), -9999) AS v FROM ({_TWO.format(k='site, slot', t='based')}))
SELECT site AS loc, '{{"Name":"' || site || '","Longitude":' || {_NUM.format('x')} || ',"Latitude":' || {_NUM.format('y')} || ',"Values":{{{_LISTS.format('"mean":', _NUM.format('v'), 'mean')},{_LISTS.format('"stdev":', _NUM.format('v'), 'stdev')}}}}}' AS json
FROM two JOIN {_SITES} ON loc = site GROUP BY site, x, y""",
)
def response_climatology_json(s, d):
    asked = Series("precip", "monthly", f"{FIRST}-01-01", f"{LAST}-12-31", Points(tuple(POINTS[:2])), min_frac=FRACTION)
    return responses.respond(engine(s, d), "json", "climatology", asked, Climatology("mean-stdev", FIRST, LAST, YEARS)).rows


@query(
    "response_csv",
    f"""{_raw_sql('poly', 'lat_i, lon_i')}, based AS (SELECT *, CAST(month(period) AS INT) AS slot FROM made), two AS ({_TWO.format(k='lat_i, lon_i, slot', t='based')})
    SELECT '1995-2000_' || lpad(CAST(slot AS VARCHAR), 2, '0') AS "Dates", CAST(-2.0 + 0.5 * lat_i AS DOUBLE) AS "Latitude", CAST(30.0 + 0.5 * lon_i AS DOUBLE) AS "Longitude", {_WIDE.format('mean')}, {_WIDE.format('stdev')} FROM two GROUP BY slot, lat_i, lon_i""",
)
def response_csv(s, d):
    asked = Series("precip", "monthly", f"{FIRST}-01-01", f"{LAST}-12-31", Polygons({"zone": [RING]}), min_frac=FRACTION)
    return responses.respond(engine(s, d), "csv", "climatology", asked, Climatology("mean-stdev", FIRST, LAST, YEARS)).rows


def _register_supports() -> None:
    base = Climatology("mean-stdev", FIRST, LAST, YEARS)
    for name, (support, keys, kind) in SUPPORTS.items():
        key = keys.split(", ")
        months_ = Series("precip", "monthly", f"{FIRST}-01-01", f"{LAST}-12-31", support, min_frac=FRACTION)
        rain = SeasonIndex("TotRain", season_of("TotRain"), support)
        two = _TWO.format(k=f"{keys}, slot", t="based")
        raw, index = _raw_sql(kind, keys), _index_sql(kind, keys)
        slotted = f"{raw}, based AS (SELECT *, CAST(month(period) AS INT) AS slot FROM made)"
        yearly = f"{index}, based AS (SELECT * FROM indices WHERE season_year BETWEEN {FIRST} AND {LAST})"
        columns = ", ".join(f"t.{k}" for k in key)
        query(f"raw_{name}", f"{raw} SELECT {keys}, {_label('monthly')} AS label, n_valid, round(value, 6) AS value FROM made")(
            lambda s, d, q=months_, k=key: engine(s, d).raw(q).select(*k, C.label(F.col("period"), "monthly").alias("label"), "n_valid", r6("value", "value"))
        )
        query(f"climatology_{name}", f"{slotted} SELECT {keys}, slot, n, stat, round(value, 6) AS value FROM ({two})")(
            lambda s, d, q=months_: rounded(engine(s, d).climatology(q, base))
        )
        query(f"anomaly_{name}", f"{slotted}, " + _depart("based", "based", f"{keys}, slot", f"{columns}, strftime(period, '%Y-%m') AS label", "standardized"))(
            lambda s, d, q=months_, k=key: engine(s, d).anomaly(q, "standardized", base).select(*k, C.label(F.col("period"), "monthly").alias("label"), "value")
        )
        query(f"season_{name}", f"{index} SELECT {keys}, season_year, n_valid, round(value, 6) AS value FROM indices")(lambda s, d, q=rain: rounded(engine(s, d).season(q)))
        query(f"season_climatology_{name}", f"{yearly} SELECT {keys}, n, stat, round(value, 6) AS value FROM ({_TWO.format(k=keys, t='based')})")(
            lambda s, d, q=rain: rounded(engine(s, d).season_climatology(q, base))
        )
        query(f"season_anomaly_{name}", f"{yearly}, " + _depart("indices", "based", keys, f"{columns}, season_year", "difference"))(
            lambda s, d, q=rain, k=key: engine(s, d).season_anomaly(q, "difference", base).select(*k, "season_year", "value")
        )


_register_supports()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
