"""Registration of queries, and the panels they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.session import configure
from seriesloom.sources.panel import load, to_panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_MADE: dict[str, Callable[[Tables], DataFrame]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL if there is one."""

    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(configure(spark), folder))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name], _MADE[name] = run, fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


class Tables:
    """The given tables and the panels built from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return load(self.spark, f"{self.folder}/{name}.parquet")

    def panel(self, name: str, key: str, ts: str, y: str, grain: str | None) -> DataFrame:
        return to_panel(self.table(name), [key], ts, y, grain)

    def events(self, grain: str | None = None) -> DataFrame:
        return self.panel("events", "event_type", "ts", "value", grain)

    def orders(self, grain: str | None = "day") -> DataFrame:
        return self.panel("orders", "o_orderpriority", "o_orderdate", "o_totalprice", grain)

    def lineitem(self, grain: str | None = "month") -> DataFrame:
        return self.panel("lineitem", "l_returnflag", "l_shipdate", "l_extendedprice", grain)

    def gappy(self) -> DataFrame:
        """Daily orders with the highest averages taken as missing."""
        high = F.col("y") > 400_000
        return self.orders().withColumn("y", F.when(~high, F.col("y")))


class BlockTables(Tables):
    """The same panels in the form that long series have: blocks of some 200 rows."""

    def panel(self, name: str, key: str, ts: str, y: str, grain: str | None) -> DataFrame:
        return to_panel(self.table(name), [key], ts, y, grain, series_rows=20, block_rows=200)


def in_blocks(*names: str) -> None:
    """Register ``<name>_blocks``: the query on block panels, with the SQL it has anyway."""
    for name in names:
        fn = _MADE[name]

        def run(spark: SparkSession, folder: str, fn=fn) -> DataFrame:
            return fn(BlockTables(configure(spark), folder))

        twin = f"{name}_blocks"
        run.__name__, run.__doc__ = twin, fn.__doc__
        QUERIES[twin] = run
        if name in ORACLES:
            ORACLES[twin] = ORACLES[name]


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def ntz(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


# Panels as SQL, for the oracles.
EVENTS_RAW = "SELECT event_type AS series_id, ts, value AS y FROM events"


def rolled(table: str, key: str, ts: str, y: str, grain: str) -> str:
    return f"SELECT {key} AS series_id, date_trunc('{grain}', {ts})::TIMESTAMP AS ts, avg({y}) AS y FROM {table} GROUP BY 1, 2"


def events_by(grain: str) -> str:
    return rolled("events", "event_type", "ts", "value", grain)


def orders_by(grain: str) -> str:
    return rolled("orders", "o_orderpriority", "o_orderdate", "o_totalprice", grain)


def lineitem_by(grain: str) -> str:
    return rolled("lineitem", "l_returnflag", "l_shipdate", "l_extendedprice", grain)


GAPPY = f"SELECT series_id, ts, CASE WHEN y <= 400000 THEN y END AS y FROM ({orders_by('day')})"


def numbered(panel: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, y) - 1 AS pos FROM ({panel})"
