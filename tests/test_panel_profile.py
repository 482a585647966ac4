import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import blocked, make_panel, wave
from seriesloom.functions.numeric import exact_round
from seriesloom.functions.order import exact_quantile, order_statistics
from seriesloom.operators import profile as P
from seriesloom.sources.panel import is_bounded, load, pick_target, split_long, to_panel, with_pos, write_results


@pytest.fixture(scope="module")
def daily(spark):
    """30 days; revenue missing on rows 2, 7 and 15, units on row 5."""
    rng = np.random.default_rng(1)
    revenue, units = rng.normal(100, 10, 30), rng.normal(20, 3, 30)
    rows = [
        (d.strftime("%Y-%m-%d"), None if i in (2, 7, 15) else float(revenue[i]), None if i == 5 else float(units[i]), "North")
        for i, d in enumerate(pd.date_range("2024-01-01", periods=30))
    ]
    return spark.createDataFrame(rows, "date string, revenue double, units double, region string")


def test_profile_of_a_table(daily):
    assert P.find_time_column(daily) == "date"
    got = {r["column"]: r for r in P.profile_table(daily, []).collect()}
    assert set(got) == {"revenue", "units", "region"}
    assert got["revenue"]["missing_count"] == 3 and got["revenue"]["missing_pct"] == 10.0
    assert got["units"]["missing_count"] == 1 and got["region"]["mean"] is None
    assert not got["region"]["is_numeric"] and got["revenue"]["frequency"] == "daily"
    pdf = daily.toPandas()
    assert got["revenue"]["skew"] == pytest.approx(pdf["revenue"].skew(), abs=1e-12)
    assert got["units"]["kurtosis"] == pytest.approx(pdf["units"].kurtosis(), abs=1e-12)


def test_target_choice(spark, daily):
    assert pick_target(daily) == "revenue" and pick_target(daily, "units") == "units"
    with pytest.raises(ValueError, match="not found"):
        pick_target(daily, "nope")
    with pytest.raises(ValueError, match="no numeric columns"):
        pick_target(spark.createDataFrame([("a",)], "label string"))


def test_no_time_column(spark):
    df = spark.createDataFrame([("North", 1.0), ("South", 2.0)], "region string, v double")
    assert P.find_time_column(df) is None
    assert {r["frequency"] for r in P.profile_table(df, []).collect()} == {"irregular"}


def test_frequencies_and_duplicates(spark):
    day = pd.Timestamp("2024-01-01")
    stamps = {
        "hourly": pd.date_range(day, periods=24, freq="h"),
        "daily": pd.date_range(day, periods=20),
        "weekends": pd.bdate_range(day, periods=40),
        "weekly": pd.date_range(day, periods=10, freq="7D"),
        "monthly": pd.date_range(day, periods=12, freq="MS"),
        "irregular": pd.to_datetime(["2024-01-01", "2024-01-03", "2024-01-10", "2024-02-15"]),
        "twice": pd.to_datetime(["2024-01-01", "2024-01-01", "2024-01-02"]),
        "same": pd.to_datetime(["2024-01-01"] * 3),
        "one": pd.to_datetime(["2024-01-01"]),
    }
    rows = [(k, t.to_pydatetime(), 1.0) for k, v in stamps.items() for t in v]
    panel = spark.createDataFrame(rows, "series_id string, ts timestamp, y double")
    for p in (panel, blocked(panel, 7)):
        got = {r["series_id"]: r for r in P.profile(p).collect()}
        assert {k: got[k]["frequency"] for k in ("hourly", "daily", "weekly", "monthly")} == {
            k: k for k in ("hourly", "daily", "weekly", "monthly")
        }
        assert got["weekends"]["frequency"] == "daily"
        assert {got[k]["frequency"] for k in ("irregular", "same", "one")} == {"irregular"}
        assert got["irregular"]["median_s"] == 7 * 86_400
        assert got["twice"]["duplicate_timestamps"] == 1 and got["same"]["duplicate_timestamps"] == 2
        assert got["one"]["std"] is None and got["one"]["skew"] is None and got["same"]["skew"] == 0.0


def test_blocks_do_not_change_positions(spark):
    panel = make_panel(spark, {"a": wave(400), "b": wave(130, seed=2)})
    key = ["series_id", "ts", "pos", "prev_ts"]
    want = with_pos(panel).select(*key).toPandas().sort_values(key[:2]).reset_index(drop=True)
    for p in (blocked(panel), split_long(panel, 100, 40)):
        assert not is_bounded(p)
        got = with_pos(p).select(*key).toPandas().sort_values(key[:2]).reset_index(drop=True)
        pd.testing.assert_frame_equal(got, want)
    assert is_bounded(split_long(panel))


def test_uneven_times_give_even_blocks(spark):
    """Most rows in one second of a long range still spread over blocks."""
    rows = [("a", 1_600_000_000.0 + i / 5000, 1.0) for i in range(5000)] + [("a", 1.0 + i * 1e6, 1.0) for i in range(100)]
    panel = spark.createDataFrame(rows, "series_id string, s double, y double").select(
        "series_id", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).alias("ts"), "y"
    )
    cut = split_long(panel, 1000, 20)
    assert cut.groupBy("block").count().agg(F.max("count")).first()[0] < 300
    pos = with_pos(cut).orderBy("ts").select("pos").toPandas()["pos"]
    assert (pos.to_numpy() == np.arange(5100)).all()


def test_order_statistics_match_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1, 500), rng.lognormal(0, 3, 300), np.zeros(50), np.full(400, -2.5)])
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": values}))
    for q in (0.0, 0.05, 0.5, 0.77, 1.0):
        got = exact_quantile(df, ["k"], "v", q, "x").first()["x"]
        assert got == pytest.approx(np.quantile(values, q), abs=1e-12)
    got = order_statistics(df, ["k"], "v", {"first": F.lit(1), "n": F.col("_n"), "none": F.col("_n") + 1}).first()
    assert (got["first"], got["n"], got["none"]) == (values.min(), values.max(), None)


def test_exact_round_is_printf(spark):
    xs = [0.25, 0.35, 12.35, 12.45, 2.675, 1.005, -0.125, 0.125, 99.995, 1e15 + 0.5, -3.75]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for d in (1, 2):
        got = [r[0] for r in df.select(exact_round(F.col("x"), d)).collect()]
        assert got == [float(f"{x:.{d}f}") for x in xs]


def test_files_in_and_out(spark, daily, tmp_path):
    daily.write.option("header", True).csv(f"{tmp_path}/c")
    daily.write.json(f"{tmp_path}/j")
    want = sorted(daily.collect(), key=str)
    assert sorted(load(spark, f"{tmp_path}/c", "csv", daily.schema, header="true").collect(), key=str) == want
    assert sorted(load(spark, f"{tmp_path}/j", "json", daily.schema).collect(), key=str) == want
    spark.createDataFrame([(1.0,), (float("nan"),)], "v double").write.parquet(f"{tmp_path}/n")
    assert load(spark, f"{tmp_path}/n").where("v is null").count() == 1
    write_results(daily.withColumn("status", F.lit("done")), f"{tmp_path}/r")
    assert (tmp_path / "r" / "status=done").is_dir()


def test_text_is_coerced(spark):
    rows = [("a", "2024-01-02", "2.5"), ("a", "bad", "1"), ("a", "2024-01-01", "x"), ("a", "03/01/2024", "7")]
    df = spark.createDataFrame(rows, "k string, d string, v string")
    got = with_pos(to_panel(df, ["k"], "d", "v", formats=["dd/MM/yyyy"])).orderBy("pos").collect()
    assert [r["y"] for r in got] == [None, 2.5, 7.0]
