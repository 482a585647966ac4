"""Queries on block panels, and cases with odd keys, missing ends and refused requests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from seriesloom.catalog.registry import EVENTS_RAW, Tables, events_by, in_blocks, ntz, orders_by, query, r
from seriesloom.functions.order import order_statistics
from seriesloom.operators import anomaly as A
from seriesloom.operators.additive import additive
from seriesloom.operators.conformal import conformal
from seriesloom.operators.grid import future_grid, resolve_period
from seriesloom.operators.registry import per_series
from seriesloom.plans.diagnosis import full_report
from seriesloom.plans.jobs import run_jobs
from seriesloom.sources.panel import to_panel

in_blocks(
    "positions", "deltas", "frequency_events_raw", "frequency_orders_daily", "profile_series", "zscores", "zscore_anomalies",
    "rollup_anomalies", "differences", "adf_fixed_lag", "kpss_orders_daily", "despike", "detrend", "acf", "power_spectrum",
    "seasonality_orders_daily", "smoothing_fit", "conformal_apply",
    "adf_up_to_one_lag", "stationarity_verdict", "forest_lookup", "additive_line_fit",
)


@query(
    "panel_composite_keys",
    """
WITH k AS (SELECT CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS a, CASE l_linestatus WHEN 'O' THEN 'x|' || chr(92) ELSE l_linestatus END AS b,
  l_quantity AS y FROM lineitem)
SELECT coalesce(a, chr(92) || 'N') || '|' || replace(replace(b, chr(92), chr(92) || chr(92)), '|', chr(92) || '|') AS series_id,
  count(*) AS n, round(sum(y), 2) AS total FROM k GROUP BY 1""",
)
def _(t: Tables):
    """Composite keys with NULLs and separators stay apart."""
    rows = t.table("lineitem").select(
        F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("a"),
        F.when(F.col("l_linestatus") == "O", F.lit("x|\\")).otherwise(F.col("l_linestatus")).alias("b"),
        "l_shipdate", "l_quantity",
    )
    panel = to_panel(rows, ["a", "b"], "l_shipdate", "l_quantity")
    return panel.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("y"), 2).alias("total"))


_ENDS = f"""SELECT series_id, ts, CASE WHEN ts <= last - INTERVAL 20 DAY THEN y END AS y FROM (
 SELECT *, max(ts) OVER (PARTITION BY series_id) AS last FROM ({orders_by('day')}))"""


def _missing_end(t: Tables):
    panel = t.orders()
    last = panel.groupBy("series_id").agg(F.max("ts").alias("last"))
    cut = F.when(F.col("ts") <= F.col("last") - F.expr("INTERVAL 20 DAY"), F.col("y"))
    return panel.join(last, "series_id").select("series_id", "ts", cut.alias("y"))


@query(
    "additive_after_missing_end",
    f"""SELECT series_id, h::INT AS step_no, max(ts) + h * INTERVAL 1 DAY AS ts FROM ({_ENDS}), range(1, 4) AS g(h)
WHERE y IS NOT NULL GROUP BY series_id, h""",
)
def _(t: Tables):
    """The additive model goes on after the last usable row."""
    made = additive(_missing_end(t), 3, n_changepoints=0)
    return made.where("error IS NULL").select("series_id", "step_no", ntz("ts").alias("ts"))


@query(
    "forecast_errors_of_short_series",
    """SELECT c_mktsegment AS series_id, 'ValueError: the additive model needs at least two usable rows at different times.' AS error
FROM customer GROUP BY 1""",
)
def _(t: Tables):
    """A regular series with a single usable row has an error row."""
    days = t.table("customer").groupBy("c_mktsegment").agg(F.max("c_acctbal").alias("y")).select(
        "c_mktsegment", "y", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("d")
    )
    rows = days.select("c_mktsegment", F.when(F.col("d") == 29, F.col("y")).alias("y"), F.timestamp_seconds(F.col("d") * 86_400).alias("ts"))
    return additive(to_panel(rows, ["c_mktsegment"], "ts", "y"), 2).select("series_id", "error")


@query(
    "conformal_without_calibration",
    f"SELECT DISTINCT series_id, 'Infinity' AS hi80, '-Infinity' AS lo95, '0' AS n_calibration FROM ({orders_by('day')})",
)
def _(t: Tables):
    """No calibration row at all: infinite bounds."""
    panel = t.orders()
    span = panel.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    half = F.timestamp_seconds((F.unix_seconds("first") + F.unix_seconds("last")) / 2)
    cut = panel.join(span.select("series_id", half.alias("half")), "series_id").select(
        "series_id", "ts", F.when(F.col("ts") <= F.col("half"), F.col("y")).alias("y")
    )
    made = conformal(lambda p, h: additive(p, h, n_changepoints=0), cut, 1)
    return made.select(
        "series_id", F.col("hi80").cast("string").alias("hi80"), F.col("lo95").cast("string").alias("lo95"),
        F.col("metadata")["n_calibration"].alias("n_calibration"),
    )


@query(
    "jobs_with_bad_values",
    """SELECT c_custkey::VARCHAR AS job_id, CASE c_custkey % 4 WHEN 0 THEN 'ValueError: horizon must be between 1 and 1000.'
  WHEN 1 THEN 'ValueError: conformal must be true or false.' WHEN 2 THEN 'ValueError: horizon must be between 1 and 1000.'
  ELSE 'LookupError: No series ''' || c_name || '''.' END AS error, 'failed' AS status FROM customer""",
)
def _(t: Tables):
    """Values that do not parse are refused one by one; nothing accepted keeps the forecast columns."""
    kind = F.col("c_custkey") % 4
    requests = t.table("customer").select(
        F.col("c_custkey").cast("string").alias("job_id"), F.col("c_name").alias("series_id"), F.lit("ets").alias("model_name"),
        F.when(kind == 0, "many").when(kind == 2, "99999999999").otherwise("5").alias("horizon"),
        F.when(kind == 1, "perhaps").alias("conformal"),
    )
    batch = run_jobs(requests, t.lineitem())
    made = batch.forecasts.select("job_id", F.col("yhat").cast("string").alias("error"), F.col("model_name").alias("status"))
    return batch.jobs.select("job_id", "error", "status").union(made)


@query(
    "anomaly_details",
    f"""SELECT series_id, pos, round(value, 4) AS value FROM (SELECT *, avg(y) OVER s AS m, stddev_samp(y) OVER s AS d, y AS value,
  row_number() OVER (PARTITION BY series_id ORDER BY ts, y) - 1 AS pos FROM ({EVENTS_RAW}) WINDOW s AS (PARTITION BY series_id))
WHERE abs((y - m) / d) > 3""",
)
def _(t: Tables):
    """The long table of anomalies, one row each, whatever a series' length."""
    found = A.detect_anomalies(t.events(), "zscore")
    return found.select("series_id", "pos", r("value", 4).alias("value"))


@query(
    "report_columns",
    """SELECT l_returnflag AS series_id, 'l_quantity' AS "column", count(*) FILTER (l_quantity IS NULL) AS missing_count,
  round(avg(l_quantity), 4) AS mean, round(max(l_quantity), 4) AS max FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_extendedprice', count(*) FILTER (l_extendedprice IS NULL), round(avg(l_extendedprice), 4),
  round(max(l_extendedprice), 4) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_linestatus', count(*) FILTER (l_linestatus IS NULL), NULL, NULL FROM lineitem GROUP BY 1""",
)
def _(t: Tables):
    """Columns of the full report, per series."""
    rows = t.table("lineitem").select("l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice", "l_linestatus")
    found = full_report(rows, ["l_returnflag"], "l_shipdate", "l_quantity", "month").columns
    return found.select("series_id", "column", "missing_count", r("mean", 4).alias("mean"), r("max", 4).alias("max"))


@query(
    "report_series",
    """SELECT l_returnflag AS series_id, 'l_quantity' AS target_column, 'l_shipdate' AS datetime_column, count(DISTINCT date_trunc('month', l_shipdate)) AS row_count,
  'l_quantity,l_extendedprice' AS numeric_columns, 'l_linestatus' AS categorical_columns FROM lineitem GROUP BY 1""",
)
def _(t: Tables):
    """What the full report says about each series' table; the target and the time column are found."""
    rows = t.table("lineitem").select("l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice", "l_linestatus")
    found = full_report(rows, ["l_returnflag"], grain="month").series
    return found.select(
        "series_id", "target_column", "datetime_column", F.col("profile.row_count").alias("row_count"),
        F.array_join("numeric_columns", ",").alias("numeric_columns"), F.array_join("categorical_columns", ",").alias("categorical_columns"),
    )


@query(
    "jobs_by_target",
    """SELECT l_returnflag || t AS job_id, t AS target_column, CASE WHEN t = 'nothing' THEN 'failed' ELSE 'done' END AS status,
  CASE WHEN t = 'nothing' THEN 'ValueError: target_column ''nothing'' not found in DataFrame.' END AS error
FROM (SELECT DISTINCT l_returnflag FROM lineitem), (VALUES ('l_quantity'), ('l_extendedprice'), ('nothing')) AS v(t)""",
)
def _(t: Tables):
    """Requests that name their target column."""
    rows = t.table("lineitem")
    panels = {y: to_panel(rows, ["l_returnflag"], "l_shipdate", y, "month") for y in ("l_quantity", "l_extendedprice")}
    names = F.explode(F.array(*[F.lit(x) for x in (*panels, "nothing")]))
    requests = rows.select("l_returnflag").distinct().select(F.col("l_returnflag").alias("series_id"), names.alias("target_column")).select(
        F.concat("series_id", "target_column").alias("job_id"), "series_id", F.lit("ets").alias("model_name"), F.lit(3).alias("horizon"), "target_column"
    )
    return run_jobs(requests, panels).jobs.select("job_id", "target_column", "status", "error")


def _workdays(t: Tables):
    """One row for each weekday; days on which a priority has no order are filled in."""
    panel = t.orders()
    ends = panel.groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    day = F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY")))
    return ends.select("series_id", day.alias("ts")).where(F.weekday("ts") < 5).withColumn("y", F.lit(1.0))


@query(
    "future_grid_business",
    f"""WITH last AS (SELECT series_id, max(ts) AS ts FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts
  FROM ({orders_by('day')}) GROUP BY 1) WHERE isodow(ts) <= 5 GROUP BY 1),
ahead AS (SELECT series_id, ts + d * INTERVAL 1 DAY AS ts FROM last, range(1, 30) AS r(d))
SELECT series_id, step_no, ts FROM (SELECT series_id, ts, (row_number() OVER (PARTITION BY series_id ORDER BY ts))::INT AS step_no
  FROM ahead WHERE isodow(ts) <= 5) WHERE step_no <= 12""",
)
def _(t: Tables):
    """A series on weekdays goes on on weekdays."""
    return future_grid(_workdays(t), 12).select("series_id", "step_no", ntz("ts").alias("ts"))


@query("resolve_period_business", f"SELECT DISTINCT series_id, NULL::INT AS period, false AS fell_back FROM ({orders_by('day')})")
def _(t: Tables):
    """Business days have no seasonal period."""
    return resolve_period(_workdays(t)).select("series_id", "period", "fell_back")


# Neighbours of powers of two and of each other: what rounding logarithms or histograms would put in the wrong order.
_NEAR = "power(2.0, (l_orderkey % 41) - 20) * (1 + ((l_partkey % 5) - 2) * power(2.0, -52)) * CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END"


@query(
    "order_statistics_near_powers_of_two",
    f"""SELECT series_id, max(v) FILTER (k = 1) AS least, max(v) FILTER (k = n // 4) AS quarter, max(v) FILTER (k = n // 2) AS half,
max(v) FILTER (k = n) AS most FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY v) AS k, count(*) OVER (PARTITION BY series_id) AS n
FROM (SELECT l_returnflag AS series_id, {_NEAR} AS v FROM lineitem)) GROUP BY series_id""",
)
def _(t: Tables):
    """Exact ranks where values differ in the last bit only."""
    values = t.table("lineitem").select(F.col("l_returnflag").alias("series_id"), F.expr(_NEAR).alias("v"))
    n = F.col("_n")
    ranks = {"least": F.lit(1), "quarter": F.floor(n / 4), "half": F.floor(n / 2), "most": n}
    return order_statistics(values, ["series_id"], "v", ranks).drop("_n")


def _even_mean(values, horizon):
    """The mean for every step; refuses series with an odd whole sum."""
    if int(values.sum() // 1) % 2:
        raise ArithmeticError("odd sum")
    return pd.DataFrame({"yhat": [values.mean()] * horizon})


@query(
    "plugged_in_forecast",
    f"""SELECT series_id, CASE WHEN odd THEN 'ArithmeticError: odd sum' END AS error, CASE WHEN NOT odd THEN m END AS yhat,
CASE WHEN odd THEN 0 ELSE 3 END AS steps FROM (SELECT series_id, floor(sum(y))::BIGINT % 2 = 1 AS odd, round(avg(y), 6) AS m
FROM ({events_by('day')}) GROUP BY series_id)""",
)
def _(t: Tables):
    """A plugged-in function of one series; where it fails, only that series has an error."""
    made = per_series("even mean", _even_mean)(t.events("day"), 3)
    return made.groupBy("series_id").agg(F.max("error").alias("error"), r(F.max("yhat")).alias("yhat"), F.count("step_no").alias("steps"))
