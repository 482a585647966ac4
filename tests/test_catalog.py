"""Every registered query runs; a few are compared with their SQL here, all of them by tools/check_oracles.py."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SMALL
from tools.check_oracles import TABLES, canonical

FAST = ["positions", "frequency_orders_daily", "zscore_anomalies", "acf", "kpss_lineitem_monthly", "conformal_quantile",
        "check_requests", "cosine_top_k_batch", "embed_documents", "future_grid_monthly"]


def test_names():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 5 and all(len(r["summary"].split("\n")) == 6 for r in rows)


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(oracle_sql()[name]).df()
    got = queries()[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
