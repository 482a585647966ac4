"""Sources, filters and profiling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seriesloom.catalog.registry import (
    EVENTS_RAW, GAPPY, Tables, events_by, lineitem_by, ntz, numbered, orders_by, query, r,
)
from seriesloom.functions.lineage import shared_folder
from seriesloom.operators import profile as P
from seriesloom.operators.registry import usable_counts
from seriesloom.sources.panel import column_types, drop_missing, load, pick_target, with_pos, write_results


@query("load_events", "SELECT event_id, ts, event_type, value FROM events")
def _(t: Tables):
    return t.table("events").select("event_id", ntz("ts").alias("ts"), "event_type", "value")


@query("panel_raw", f"SELECT series_id, ts, y FROM ({EVENTS_RAW})")
def _(t: Tables):
    return t.events().select("series_id", ntz("ts").alias("ts"), "y")


@query("panel_daily", f"SELECT series_id, ts, round(y, 4) AS y FROM ({orders_by('day')})")
def _(t: Tables):
    return t.orders().select("series_id", ntz("ts").alias("ts"), r("y", 4).alias("y"))


@query("panel_monthly", f"SELECT series_id, ts, round(y, 4) AS y FROM ({lineitem_by('month')})")
def _(t: Tables):
    return t.lineitem().select("series_id", ntz("ts").alias("ts"), r("y", 4).alias("y"))


@query("positions", f"SELECT series_id, ts, pos FROM ({numbered(EVENTS_RAW)})")
def _(t: Tables):
    return with_pos(t.events()).select("series_id", ntz("ts").alias("ts"), "pos")


@query(
    "pick_target",
    "SELECT 'o_orderkey' AS target, count(*) AS row_count, round(avg(o_orderkey), 4) AS mean FROM orders",
)
def _(t: Tables):
    orders = t.table("orders")
    target = pick_target(orders)
    return orders.agg(F.count(F.lit(1)).alias("row_count"), r(F.avg(target), 4).alias("mean")).select(
        F.lit(target).alias("target"), "row_count", "mean"
    )


_RESULTS = f"""
WITH p AS ({events_by('day')} UNION ALL {orders_by('day')})
SELECT series_id, usable, CASE WHEN usable >= 100 THEN 'done' ELSE 'failed' END AS status
FROM (SELECT series_id, count(y) AS usable FROM p GROUP BY 1)"""


@query("write_and_read_results", _RESULTS)
def _(t: Tables):
    counts = usable_counts(t.events("day").unionByName(t.orders())).withColumn(
        "status", F.when(F.col("usable") >= 100, "done").otherwise("failed")
    )
    path = f"{shared_folder(t.spark)}/results-{uuid.uuid4()}"
    write_results(counts, path)
    return load(t.spark, path).select("series_id", "usable", "status")


@query("drop_missing", f"SELECT series_id, ts, round(y, 4) AS y FROM ({GAPPY}) WHERE y IS NOT NULL")
def _(t: Tables):
    return drop_missing(t.gappy()).select("series_id", ntz("ts").alias("ts"), r("y", 4).alias("y"))


@query(
    "column_typing",
    """SELECT 'o_orderkey' AS "column", true AS is_numeric, count(*) - count(o_orderkey) AS missing_count FROM orders
UNION ALL SELECT 'o_custkey', true, count(*) - count(o_custkey) FROM orders
UNION ALL SELECT 'o_totalprice', true, count(*) - count(o_totalprice) FROM orders
UNION ALL SELECT 'o_orderstatus', false, count(*) - count(o_orderstatus) FROM orders
UNION ALL SELECT 'o_orderpriority', false, count(*) - count(o_orderpriority) FROM orders""",
)
def _(t: Tables):
    orders = t.table("orders")
    numeric, categorical = column_types(orders, "o_orderdate")
    return P.column_stats(orders, [], numeric + categorical).select("column", "is_numeric", "missing_count")


def _rates(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS "column", round(avg((try_cast({c} AS TIMESTAMP) IS NOT NULL)::INT), 6) AS parse_rate FROM {table}"""
        for i, c in enumerate(columns)
    )


for _table, _columns in {
    "events": ["ts", "event_type", "props"],
    "orders": ["o_orderstatus", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus", "l_shipdate"],
}.items():

    @query(f"time_column_rates_{_table}", _rates(_table, _columns))
    def _(t: Tables, table=_table):
        return P.time_column_rates(t.table(table)).withColumn("parse_rate", r("parse_rate"))


@query("time_column_found", "SELECT 'l_shipdate' AS time_column, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts FROM lineitem")
def _(t: Tables):
    table = t.table("lineitem")
    found = P.find_time_column(table)
    return table.agg(F.min(found).alias("a"), F.max(found).alias("b")).select(
        F.lit(found).alias("time_column"), ntz("a").alias("first_ts"), ntz("b").alias("last_ts")
    )


def _stats_sql(panel: str) -> str:
    return f"""
SELECT series_id, count(*) AS row_count, min(ts) AS start_ts, max(ts) AS end_ts,
  count(*) - count(DISTINCT ts) AS duplicate_timestamps, count(*) - count(y) AS missing_count,
  round((count(*) - count(y)) / count(*) * 100, 2) AS missing_pct,
  round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS std, round(min(y), 4) AS min, round(max(y), 4) AS max,
  round(skewness(y), 6) AS skew, round(kurtosis(y), 6) AS kurtosis
FROM ({panel}) GROUP BY 1"""


def _stats(df, *extra):
    return df.select(
        *extra,
        "series_id", "row_count", ntz("start_ts").alias("start_ts"), ntz("end_ts").alias("end_ts"),
        "duplicate_timestamps", "missing_count", r("missing_pct", 2).alias("missing_pct"),
        *[r(c, 4).alias(c) for c in ("mean", "std", "min", "max")], r("skew").alias("skew"), r("kurtosis").alias("kurtosis"),
    )


_LINEITEM_RAW = "SELECT l_returnflag AS series_id, l_shipdate AS ts, l_extendedprice AS y FROM lineitem"


@query("series_stats_duplicates", _stats_sql(_LINEITEM_RAW))
def _(t: Tables):
    return _stats(P.series_stats(t.lineitem(None)))


@query("series_stats_missing", _stats_sql(GAPPY))
def _(t: Tables):
    return _stats(P.series_stats(t.gappy()))


def _report_sql(table: str, numeric: list[str], text: list[str], by: str | None = None) -> str:
    parts = []
    group = f"{by}, " if by else ""
    for c in numeric:
        parts.append(
            f"""SELECT {group}'{c}' AS "column", true AS is_numeric, count(*) - count({c}) AS missing_count,
 round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct, round(avg({c}), 4) AS mean,
 round(stddev_samp({c}), 4) AS std, round(min({c}::DOUBLE), 4) AS min, round(max({c}::DOUBLE), 4) AS max,
 round(skewness({c}), 5) AS skew, round(kurtosis({c}), 5) AS kurtosis FROM {table}{f' GROUP BY {by}' if by else ''}"""
        )
    for c in text:
        parts.append(
            f"""SELECT {group}'{c}', false, count(*) - count({c}), round((count(*) - count({c})) / count(*) * 100, 2),
 NULL, NULL, NULL, NULL, NULL, NULL FROM {table}{f' GROUP BY {by}' if by else ''}"""
        )
    return " UNION ALL ".join(parts)


def _report(df, by=()):
    return df.select(
        *by, "column", "is_numeric", "missing_count", r("missing_pct", 2).alias("missing_pct"),
        *[r(c, 4).alias(c) for c in ("mean", "std", "min", "max")], r("skew", 5).alias("skew"), r("kurtosis", 5).alias("kurtosis"),
    )


@query("column_report_customer", _report_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name"], "c_mktsegment"))
def _(t: Tables):
    return _report(P.column_stats(t.table("customer"), ["c_mktsegment"]), ["c_mktsegment"])


@query("column_report_part", _report_sql("part", ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]))
def _(t: Tables):
    return _report(P.column_stats(t.table("part"), []))


@query("column_report_supplier", _report_sql("supplier", ["s_suppkey", "s_nationkey", "s_acctbal"], ["s_name"]))
def _(t: Tables):
    return _report(P.column_stats(t.table("supplier"), []))


@query(
    "column_report_lineitem",
    _report_sql("lineitem", ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_linestatus"], "l_returnflag"),
)
def _(t: Tables):
    columns = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"]
    return _report(P.column_stats(t.table("lineitem"), ["l_returnflag"], columns), ["l_returnflag"])


def deltas_sql(panel: str) -> str:
    return f"""SELECT series_id, ts, d AS delta_s FROM (SELECT series_id, ts,
 (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY ts, y))) / 1e6 AS d FROM ({panel})) WHERE d IS NOT NULL"""


@query("deltas", f"SELECT series_id, ts, round(delta_s, 6) AS delta_s FROM ({deltas_sql(EVENTS_RAW)})")
def _(t: Tables):
    return P.deltas(t.events()).select("series_id", ntz("ts").alias("ts"), r("delta_s").alias("delta_s"))


def frequency_sql(panel: str) -> str:
    return f"""
WITH d AS ({deltas_sql(panel)}),
m AS (SELECT series_id, quantile_cont(delta_s, 0.5) AS median_s FROM d GROUP BY 1),
a AS (SELECT series_id, median_s, quantile_cont(abs(delta_s - median_s), 0.5) AS mad_s FROM d JOIN m USING (series_id) GROUP BY 1, 2)
SELECT series_id, median_s, mad_s, CASE WHEN median_s IS NULL OR median_s <= 0 OR mad_s / median_s > 0.25 THEN 'irregular'
  WHEN median_s BETWEEN 1800 AND 5400 THEN 'hourly' WHEN median_s BETWEEN 72000 AND 108000 THEN 'daily'
  WHEN median_s BETWEEN 518400 AND 691200 THEN 'weekly' WHEN median_s BETWEEN 2246400 AND 2851200 THEN 'monthly'
  ELSE 'irregular' END AS frequency
FROM (SELECT DISTINCT series_id FROM ({panel})) LEFT JOIN a USING (series_id)"""


_GRAINS = {
    "events_raw": (EVENTS_RAW, lambda t: t.events()),
    "events_hourly": (events_by("hour"), lambda t: t.events("hour")),
    "orders_daily": (orders_by("day"), lambda t: t.orders()),
    "orders_weekly": (orders_by("week"), lambda t: t.orders("week")),
    "lineitem_monthly": (lineitem_by("month"), lambda t: t.lineitem()),
}

for _name, (_sql, _panel) in _GRAINS.items():

    @query(f"frequency_{_name}", f"SELECT series_id, round(median_s, 5) AS median_s, round(mad_s, 5) AS mad_s, frequency FROM ({frequency_sql(_sql)})")
    def _(t: Tables, panel=_panel):
        return P.detect_frequency(panel(t)).select(
            "series_id", r("median_s", 5).alias("median_s"), r("mad_s", 5).alias("mad_s"), "frequency"
        )


@query(
    "profile_series",
    f"SELECT s.*, frequency FROM ({_stats_sql(GAPPY)}) s JOIN ({frequency_sql(GAPPY)}) f USING (series_id)",
)
def _(t: Tables):
    return _stats(P.profile(t.gappy()), "frequency")


@query(
    "profile_table",
    f"""SELECT c.*, f.frequency, t.row_count, t.duplicate_timestamps
FROM ({_report_sql("events", ["event_id", "user_id", "value"], ["props"], "event_type")}) c
JOIN ({frequency_sql(EVENTS_RAW)}) f ON f.series_id = c.event_type
JOIN (SELECT event_type AS k, count(*) AS row_count, count(*) - count(DISTINCT ts) AS duplicate_timestamps FROM events GROUP BY 1) t
  ON t.k = c.event_type""",
)
def _(t: Tables):
    table = P.profile_table(t.table("events"), ["event_type"])
    return _report(table, ["event_type", "frequency", "row_count", "duplicate_timestamps"])
