"""Cases that gave lost or wrong output before."""

import numpy as np
import pytest
from conftest import blocked, make_panel, wave
from pyspark.sql import functions as F

from seriesloom.operators import anomaly as A
from seriesloom.operators.additive import additive
from seriesloom.operators.conformal import conformal
from seriesloom.operators.ets import ets
from seriesloom.plans.jobs import FORECAST, run_jobs
from seriesloom.sources.panel import to_panel
from seriesloom.streaming.intake import stream_jobs


def test_keys_never_merge(spark):
    keys = [(None, "x"), ("x", None), ("a|b", "c"), ("a", "b|c"), ("a\\", "|b"), ("a\\|", "b"), ("\\N", "x"), ("", "x"), (None, None)]
    rows = [(a, b, f"2024-01-0{d}", 1.0) for a, b in keys for d in (1, 2)]
    df = spark.createDataFrame(rows, "a string, b string, t string, y double")
    assert to_panel(df, ["a", "b"], "t", "y").select("series_id").distinct().count() == len(keys)
    ones = spark.createDataFrame([(k, "2024-01-01", 1.0) for k in (None, "", "\\N", "\\\\N", "a|b")], "a string, t string, y double")
    got = {r.series_id for r in to_panel(ones, ["a"], "t", "y").collect()}
    assert len(got) == 5 and {"", "a|b"} <= got


def test_forest_is_the_same_in_both_panel_forms(spark):
    """More rows than the trees can draw, so the pool is thinned."""
    p = make_panel(spark, {"long": wave(40_000, seed=3), "short": wave(300, seed=4)}, freq="min")
    whole = {(r.series_id, r.pos): r.score for r in A.forest_scores(p, trees=100).collect()}
    split = {(r.series_id, r.pos): r.score for r in A.forest_scores(blocked(p, 5), trees=100).collect()}
    assert len(whole) == 40_300 and whole == split


def test_rollup_has_one_row_per_series(spark):
    found = spark.range(200_000).select(F.lit("s").alias("series_id"), F.col("id").alias("pos"), F.lit(1.0).alias("value"), F.lit(4.0).alias("score"))
    (row,) = A.rollup_anomalies(found).select("series_id", "anomaly_count", F.size("details").alias("n")).collect()
    assert row.anomaly_count == row.n == 200_000


def test_normality_sample_is_a_parameter(spark):
    p = make_panel(spark, {"a": wave(900, seed=1)})
    assert A.anomaly_methods(p, normality_rows=700).first().rows_tested == 700
    assert A.anomaly_methods(p).first().rows_tested == 500


def test_additive_keeps_every_series(spark):
    one = [np.nan] * 27 + [3.0]
    tail = list(wave(120, base=10.0)) + [np.nan] * 10
    got = additive(make_panel(spark, {"one": one, "tail": tail, "none": [np.nan] * 28}), 3).toPandas()
    assert set(got[got.error.notna()].series_id) == {"one", "none"}
    first = got[(got.series_id == "tail") & (got.step_no == 1)].ts.iloc[0]
    assert str(first.date()) == "2022-05-01"  # 120 days from 2022-01-01 end on 2022-04-30


def test_no_calibration_rows_means_infinite_bounds(spark):
    values = list(wave(70, base=5.0)) + [np.nan] * 30  # the last 30 % are missing
    got = conformal(additive, make_panel(spark, {"a": values}), 2).toPandas()
    assert got.error.isna().all() and (got.hi80 == np.inf).all() and (got.lo95 == -np.inf).all()


def test_requests_that_do_not_parse(spark):
    p = make_panel(spark, {"a": wave(200, base=5.0)})
    requests = spark.createDataFrame(
        [("1", "a", "ets", "99999999999", None), ("2", "a", "ets", "many", None), ("3", "a", "ets", "2", "perhaps"), ("4", "a", "ets", "2", None)],
        "job_id string, series_id string, model_name string, horizon string, conformal string",
    )
    batch = run_jobs(requests, p)
    assert {r.job_id: r.status for r in batch.jobs.collect()} == {"1": "failed", "2": "failed", "3": "failed", "4": "done"}
    assert batch.forecasts.count() == 2


def test_forecasts_have_one_schema(spark, tmp_path):
    """A batch of refusals first, then one that forecasts: all columns can be read back."""
    p = make_panel(spark, {"a": wave(200, base=5.0)})
    assert run_jobs(spark.createDataFrame([("0", "zz")], "job_id string, series_id string"), p).forecasts.schema.names == [
        c.split(" ")[0] for c in FORECAST.split(", ")
    ]
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    (inbox / "one.json").write_text('{"job_id": "1", "series_id": "nobody"}\n{"job_id": "2", "series_id": "a", "model_name": "ets", "horizon": "x"}\n')
    stream_jobs(spark, str(inbox), p, mark, out).awaitTermination(120)
    (inbox / "two.json").write_text('{"job_id": "3", "series_id": "a", "model_name": "ets", "horizon": 3}\nnot json\nnot json either\n')
    stream_jobs(spark, str(inbox), p, mark, out).awaitTermination(120)
    made = spark.read.parquet(f"{out}/forecasts")
    assert {"ts", "yhat", "lo80", "hi95", "step_no", "model_name"} <= set(made.columns)
    assert made.where("yhat IS NOT NULL AND ts IS NOT NULL").count() == 3
    jobs = spark.read.parquet(f"{out}/jobs")
    assert jobs.where("status = 'failed'").count() == 4 and jobs.where("job_id IS NULL").count() == 0


def test_a_failing_model_does_not_stop_the_others(spark, monkeypatch):
    from seriesloom.operators import registry

    monkeypatch.setitem(registry.MODELS, "broken", lambda panel, horizon: 1 / 0)
    monkeypatch.setitem(registry.FLOORS, "broken", 1)
    p = make_panel(spark, {"a": wave(200, base=5.0)})
    requests = spark.createDataFrame([("1", "a", "broken"), ("2", "a", "ets")], "job_id string, series_id string, model_name string")
    batch = run_jobs(requests, p)
    got = {r.job_id: (r.status, r.error) for r in batch.jobs.collect()}
    assert got["2"] == ("done", None) and got["1"][0] == "failed" and "ZeroDivisionError" in got["1"][1]


def test_states_and_memories_of_streamed_jobs(spark, tmp_path):
    from seriesloom.streaming.intake import job_states, pending_requests

    p = make_panel(spark, {"a": wave(200, base=5.0)})
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    (inbox / "one.json").write_text('{"job_id": "1", "series_id": "a", "model_name": "ets", "horizon": 2}\n{"job_id": "2", "series_id": "b"}\n')
    assert job_states(spark, out) is None and pending_requests(spark, str(inbox), out).count() == 2
    stream_jobs(spark, str(inbox), p, mark, out).awaitTermination(120)
    (inbox / "two.json").write_text('{"job_id": "3", "series_id": "a"}\n')
    assert {r.job_id: r.status for r in job_states(spark, out).collect()} == {"1": "done", "2": "failed"}
    assert [r.job_id for r in pending_requests(spark, str(inbox), out).collect()] == ["3"]
    spark.createDataFrame([("9",)], "job_id string").write.parquet(f"{out}/started/batch=9")  # taken in, no result
    assert {r.job_id: r.status for r in job_states(spark, out).collect()}["9"] == "running"
    (memory,) = spark.read.parquet(f"{out}/memories").collect()
    assert memory.job_id == "1" and "Dataset: 200 rows" in memory.text and len(memory.embedding) == memory.dim
    (job,) = spark.read.parquet(f"{out}/jobs").where("job_id = '1'").collect()
    assert job.started_at <= job.finished_at and job.summary == memory.text


def test_ranks_among_values_close_together(spark):
    """All values agree in the leading mantissa bits; only a handful is left to order at the last level."""
    from seriesloom.functions.order import coarse, _digit, order_statistics

    rng = np.random.default_rng(5)
    values = np.concatenate([1.7e9 + rng.random(20_000) * 10, -1.7e9 - rng.random(2_000)])
    df = spark.createDataFrame([("s", float(v)) for v in values], "series_id string, y double")
    ranks = {"low": F.lit(1), "mid": F.floor(F.col("_n") / 2), "high": F.col("_n"), "out": F.col("_n") + 1}
    got = order_statistics(df, ["series_id"], "y", ranks).first()
    ordered = np.sort(values)
    assert (got.low, got.mid, got.high, got.out, got._n) == (ordered[0], ordered[len(values) // 2 - 1], ordered[-1], None, len(values))
    keys = df.select(coarse(F.col("y")).alias("a"), _digit(F.col("y"), 1).alias("b"), _digit(F.col("y"), 2).alias("c"))
    assert keys.groupBy("a").count().agg(F.max("count")).first()[0] >= 2_000
    assert keys.groupBy("a", "b", "c").count().agg(F.max("count")).first()[0] < 100


def test_business_days(spark):
    import pandas as pd

    from seriesloom.operators.grid import future_grid, steps_of

    days = pd.bdate_range("2024-01-01", periods=30)  # ends on Friday, 9 February
    holes = days.delete(12)
    rows = [(k, t.to_pydatetime(), 1.0) for k, d in (("all", days), ("hole", holes), ("week", days[:5])) for t in d]
    panel = spark.createDataFrame(rows, "series_id string, ts timestamp, y double")
    assert {r.series_id: r.step for r in steps_of(panel).collect()} == {"all": "business", "hole": "daily", "week": "daily"}
    ahead = future_grid(panel.where("series_id = 'all'"), 6).orderBy("step_no").collect()
    assert [str(r.ts.date()) for r in ahead] == [str(d.date()) for d in pd.bdate_range("2024-02-12", periods=6)]


def test_a_hot_timestamp_is_split(spark):
    """More than 90 % of a series' rows share one time; positions stay those of the whole."""
    from seriesloom.sources.panel import with_pos

    rng = np.random.default_rng(8)
    rows = [("s", "1970-01-01 00:00:00", float(v)) for v in rng.normal(0, 10, 15_000)]
    rows += [("s", "1970-01-01 00:00:00", None)] * 3
    rows += [("s", f"2024-01-{d:02d} {h:02d}:00:00", float(rng.normal())) for d in range(1, 29) for h in range(24)]
    df = spark.createDataFrame(rows, "k string, t string, y double")
    whole = with_pos(to_panel(df, ["k"], "t", "y"))
    split = with_pos(to_panel(df, ["k"], "t", "y", series_rows=500, block_rows=100))
    assert "block" in split.columns
    assert split.groupBy("block").count().agg(F.max("count")).first()[0] < 600
    key = lambda d: sorted((r.pos, r.ts, r.y, r.prev_ts) for r in d.where("y IS NOT NULL").collect())
    assert key(whole) == key(split)
