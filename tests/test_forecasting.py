import math
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import blocked, make_panel, wave
from seriesloom.operators import additive as D
from seriesloom.operators import conformal as C
from seriesloom.operators import ets as E
from seriesloom.operators import registry as R
from seriesloom.operators.grid import future_grid, resolve_period
from seriesloom.plans.jobs import check_requests, run_forecast, run_jobs
from seriesloom.sources.panel import compact
from seriesloom.streaming.intake import finished_jobs, stream_jobs


def bounds_nest(pdf):
    assert (pdf["lo95"] <= pdf["lo80"] + 1e-9).all() and (pdf["lo80"] <= pdf["yhat"] + 1e-9).all()
    assert (pdf["yhat"] <= pdf["hi80"] + 1e-9).all() and (pdf["hi80"] <= pdf["hi95"] + 1e-9).all()


@pytest.fixture(scope="module")
def daily(spark):
    return make_panel(spark, {"d": wave(730, 80, 0.04, 5, 7, 1.5, seed=1), "short": wave(10, 5, 0, 0, 7, 0.1, seed=2)})


def test_ets(daily):
    out = E.ets(daily, 14).toPandas()
    long = out[out["series_id"] == "d"].sort_values("step_no")
    assert list(long["ts"]) == list(pd.date_range("2024-01-01", periods=14))
    bounds_nest(long)
    assert long["metadata"].iloc[0]["seasonal_periods"] == "7"
    truth = 80 + 0.04 * np.arange(730, 744) + 5 * np.sin(2 * np.pi * np.arange(730, 744) / 7)
    assert np.abs(long["yhat"].to_numpy() - truth).mean() < 1.5
    short = out[out["series_id"] == "short"]
    assert len(short) == 14 and short["metadata"].iloc[0]["seasonal_fallback"] == "true"


def fold(y, params, state, m):
    """Textbook recursion, one step at a time."""
    a, b, g, phi = params
    level, slope, season = state[0], state[1], list(state[2:])
    sse = 0.0
    for t, v in enumerate(y):
        s = season[t % m] if m else 0.0
        e = v - (level + phi * slope + s)
        sse += e * e
        level, slope = level + phi * slope + a * e, phi * slope + b * e
        if m:
            season[t % m] = s + g * e
    return sse, level, slope, season


def test_symbolic_sweep_is_the_recursion():
    y = wave(90, 5, 0.1, 3, 7, 1, seed=3)
    params = np.array([[0.3, 0.05, 0.2, 0.9], [0.7, 0.01, 0.1, 0.95]])
    gram, state = E.sweep(y, 0, params, 7, True)
    best, sse = E.best_initial(gram, 7, True)
    for i in range(2):
        for x in (best[i], np.append(np.arange(9.0), 1.0)):
            want, level, slope, season = fold(y, params[i], x[:-1], 7)
            assert x @ gram[i] @ x == pytest.approx(want, rel=1e-9)
            np.testing.assert_allclose(state[i] @ x, [level, slope, *season], atol=1e-8)
        worse = best[i].copy()
        worse[0] += 0.1
        assert fold(y, params[i], worse[:-1], 7)[0] > sse[i]
    # Composing two halves gives the same form.
    g1, s1 = E.sweep(y[:40], 0, params, 7, True)
    g2, _ = E.sweep(y[40:], 40, params, 7, True)
    reach = np.concatenate([s1, np.tile(np.eye(10)[-1], (2, 1, 1))], axis=1)
    np.testing.assert_allclose(g1 + reach.transpose(0, 2, 1) @ g2 @ reach, gram, rtol=1e-8, atol=1e-6)


def test_ets_by_pieces_agrees(spark, daily, small_pieces):
    p = daily.where("series_id = 'd'")
    want = E.fit_ets(p).first()
    got = E.fit_ets(blocked(p)).first()
    assert want["error"] is None and got["error"] is None
    for k in ("alpha", "beta", "gamma", "phi", "level", "slope", "sse", "aic"):
        assert got[k] == pytest.approx(want[k], rel=1e-5, abs=1e-6), k
    np.testing.assert_allclose(got["season"], want["season"], rtol=1e-5, atol=1e-5)


def test_interval_growth(spark):
    """Closed form against the explicit sum and against simulation."""
    rows = [(0.3, 0.05, 0.2, 0.9, 7), (0.3, 0.05, 0.0, 1.0, 0), (0.5, 0.0, 0.2, 1.0, 4), (0.2, 0.1, 0.1, 0.8, 12)]
    df = spark.createDataFrame(rows, "alpha double, beta double, gamma double, phi double, m int").withColumn(
        "h", F.explode(F.array(*[F.lit(h) for h in (1, 2, 8, 25, 60)]))
    )
    for r in df.withColumn("v", E._variance_growth(F.col("h"), F.col("m"))).collect():
        total = 0.0
        for j in range(1, r["h"]):
            c = r["alpha"] + r["beta"] * sum(r["phi"] ** i for i in range(1, j + 1))
            total += (c + (r["gamma"] if r["m"] and j % r["m"] == 0 else 0.0)) ** 2
        assert r["v"] == pytest.approx(total, rel=1e-9, abs=1e-12)
    rng, (a, b, g, phi, m) = np.random.default_rng(0), rows[0]
    ends = []
    for _ in range(4000):
        level, slope, s = 0.0, 0.0, [0.0] * m
        for t in range(10):
            e = rng.normal()
            y = level + phi * slope + s[t % m] + e
            level, slope = level + phi * slope + a * e, phi * slope + b * e
            s[t % m] += g * e
        ends.append(y)
    got = df.where("alpha = 0.3 and m = 7 and h = 8").withColumn("v", E._variance_growth(F.lit(10), F.col("m"))).first()["v"]
    assert np.var(ends) == pytest.approx(1 + got, rel=0.1)


def test_multiplicative_and_missing(spark):
    t = np.arange(120)
    y = (50 + 0.5 * t) * (1 + 0.3 * np.sin(2 * np.pi * t / 12)) * np.exp(np.random.default_rng(0).normal(0, 0.02, 120))
    gap = y.copy()
    gap[5] = np.nan
    p = make_panel(spark, {"y": y, "gap": gap, "neg": y - 60}, "2015-01-01", "MS")
    out = E.ets(p, 12, error="mul", seasonal="mul").toPandas()
    good = out[out["series_id"] == "y"].sort_values("step_no")
    future = np.arange(120, 132)
    truth = (50 + 0.5 * future) * (1 + 0.3 * np.sin(2 * np.pi * future / 12))
    assert np.abs(good["yhat"].to_numpy() / truth - 1).max() < 0.1
    bounds_nest(good)
    errors = out.set_index("series_id")["error"].to_dict()
    assert "missing values" in errors["gap"] and "positive" in errors["neg"]


STATE = dict(series_id="s", n=40, season=None, level=100.0, slope=1.02, alpha=0.5, beta=0.2, gamma=0.0, phi=1.0, sigma2=0.02**2)


def test_simulated_bounds_of_a_growing_trend():
    """Known quantiles of 200,000 independent paths with error and trend multiplicative."""
    got = E.simulated_bounds(STATE, 30, ("mul", "mul", None))
    assert got[29, 0] == pytest.approx(79.5, rel=0.05) and got[29, 3] == pytest.approx(408.1, rel=0.05)
    assert (np.diff(got, axis=1) > 0).all()
    assert (got == E.simulated_bounds(STATE, 30, ("mul", "mul", None))).all()
    assert (got != E.simulated_bounds(STATE | {"series_id": "t"}, 30, ("mul", "mul", None))).any()


@pytest.mark.parametrize("season", [None, [3.0, -1.0, 0.5, -2.5]])
def test_simulated_bounds_equal_the_formula_of_the_additive_model(spark, season):
    row = STATE | dict(slope=0.4, beta=0.1, gamma=0.2, phi=0.9, sigma2=2.0, season=season)
    got = E.simulated_bounds(row, 12, ("add", "add", "add"), paths=200_000)
    fit = spark.createDataFrame([("s", 40, len(season) if season else None, False, 0.5, 0.1, 0.2, 0.9, 100.0, 0.4, season, 1.0, 2.0, 3.0, None)], f"series_id string, {E.FIT}")
    grid = spark.range(1, 13).select(F.lit("s").alias("series_id"), F.col("id").cast("int").alias("step_no"), F.lit(None).cast("timestamp").alias("ts"))
    want = E.predict_ets(fit, grid).orderBy("step_no").toPandas()[["lo95", "lo80", "hi80", "hi95"]].to_numpy()
    width = (want[:, 3] - want[:, 0])[:, None]
    assert (np.abs(got - want) < 0.01 * width).all()


@pytest.mark.parametrize("kinds", [("mul", "mul", "mul"), ("add", "add", "mul"), ("mul", "add", "add")])
def test_coverage_of_multiplicative_intervals(spark, kinds):
    """Values that follow the model fall into the 80 and 95 % intervals about as often as they should."""
    rng = np.random.default_rng(5)
    m, ahead, count = 4, 6, 400
    sigma = 0.03 if kinds[0] == "mul" else 2.0
    inside = np.zeros(2)
    rows = []
    for k in range(count):
        season = np.array([1.1, 0.9, 1.05, 0.95]) if kinds[2] == "mul" else np.array([5.0, -5.0, 2.0, -2.0])
        rows.append(STATE | dict(series_id=f"s{k}", season=season.tolist(), slope=1.01 if kinds[1] == "mul" else 0.5, gamma=0.1, sigma2=sigma**2))
    row = rows[0]
    level, slope = (np.full(count, row[c]) for c in ("level", "slope"))
    season = np.tile(np.array(row["season"]), (count, 1))
    made = []
    for h in range(ahead):
        s = season[:, (row["n"] + h) % m]
        damped = slope  # phi = 1
        base = level * damped if kinds[1] == "mul" else level + damped
        mean = base * s if kinds[2] == "mul" else base + s
        raw = sigma * rng.normal(size=count) * (mean if kinds[0] == "mul" else 1)
        made.append(mean + raw)
        gain = raw / s if kinds[2] == "mul" else raw
        level = base + 0.5 * gain
        slope = damped + 0.2 * gain / (base if kinds[1] == "mul" else 1)
        season[:, (row["n"] + h) % m] = s + 0.1 * (raw / base if kinds[2] == "mul" else raw)
    fit = spark.createDataFrame(
        [(r["series_id"], 40, m, False, 0.5, 0.2, 0.1, 1.0, r["level"], r["slope"], r["season"], 1.0, r["sigma2"], 3.0, None) for r in rows],
        f"series_id string, {E.FIT}",
    )
    steps = spark.range(1, ahead + 1).select(F.col("id").cast("int").alias("step_no"), F.lit(None).cast("timestamp").alias("ts"))
    grid = fit.select("series_id").join(F.broadcast(steps))
    out = E.predict_ets(fit, grid, kinds[1], kinds[2], kinds[0], paths=2000).toPandas()
    out["k"] = out["series_id"].str[1:].astype(int)
    true = np.array(made)[out["step_no"] - 1, out["k"]]
    for n, level_ in enumerate(("80", "95")):
        inside[n] = ((true >= out[f"lo{level_}"]) & (true <= out[f"hi{level_}"])).mean()
    assert inside[0] == pytest.approx(0.80, abs=0.03) and inside[1] == pytest.approx(0.95, abs=0.02)


def test_multiplicative_series_above_the_bound_of_a_task(spark, monkeypatch):
    """Values carried from batch to batch give the fit of the whole series; faults stay error rows."""
    t = np.arange(260)
    y = (50 + 0.5 * t) * (1 + 0.3 * np.sin(2 * np.pi * t / 12)) * np.exp(np.random.default_rng(0).normal(0, 0.02, 260))
    gap = y.copy()
    gap[5] = np.nan
    series = {"y": y, "z": y[::-1].copy(), "gap": gap, "neg": y - 60, "short": y[:80]}
    p = make_panel(spark, series, "2001-01-01", "MS")
    monkeypatch.setattr(E, "SERIES_ROWS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for kinds in ({"error": "mul", "seasonal": "mul"}, {"error": "add", "trend": "mul", "seasonal": None}):
            want = E.ets(p, 12, **kinds).toPandas().sort_values(["series_id", "step_no"])
            got = E.ets(blocked(p, 365), 12, **kinds).toPandas().sort_values(["series_id", "step_no"])
            assert got["error"].tolist() == want["error"].tolist() and want["error"].notna().sum() == 2
            for c in ("yhat", "lo80", "hi95"):
                np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_additive(spark, small_pieces):
    y = wave(730, 100, 0.05, 6, 7, 2, seed=5)
    gap = y.copy()
    gap[[97, 143, 201, 322, 410]] = np.nan
    p = make_panel(spark, {"y": y, "gap": gap})
    for x in (p, blocked(p)):
        out = D.additive(x, 30, yearly=False, weekly=True, daily=False).toPandas()
        t = np.arange(730, 760)
        truth = 100 + 0.05 * t + 6 * np.sin(2 * np.pi * t / 7)
        for k in ("y", "gap"):
            one = out[out["series_id"] == k].sort_values("step_no")
            assert len(one) == 30 and one["error"].isna().all()
            bounds_nest(one)
            assert np.abs(one["yhat"].to_numpy() - truth).mean() < 2.0
            assert 1.5 < (one["hi80"] - one["yhat"]).iloc[0] / 1.2816 < 2.6


def test_posterior_mode_is_a_minimum():
    rng = np.random.default_rng(1)
    t = np.linspace(0, 1, 200)
    cps = np.arange(1, 6) / 6 * 0.8
    x = np.column_stack([t, np.ones(200), *[np.maximum(t - c, 0) for c in cps]])
    y = 0.2 + 0.5 * t + 1.0 * np.maximum(t - cps[2], 0) + rng.normal(0, 0.02, 200)
    xy = np.column_stack([x, y])
    theta, sigma = D.posterior_mode(xy.T @ xy, 200, 5, 0.05)

    def loss(th, s):
        r = y - x @ th
        return 200 * np.log(s) + r @ r / (2 * s * s) + (th[:2] ** 2).sum() / 50 + np.abs(th[2:]).sum() / 0.05 + s * s / 0.5

    at = loss(theta, sigma)
    for _ in range(300):
        assert loss(theta + rng.normal(0, 1e-3, 7), sigma * np.exp(rng.normal(0, 1e-3))) > at - 1e-3


def test_changepoints_sit_on_rows(spark):
    p = make_panel(spark, {"a": wave(100), "b": wave(12)})
    spec = {r["series_id"]: r for r in D.additive_spec(compact(p), "auto", "auto", "auto", 25).collect()}
    day = 86_400_000_000
    index = [(c - spec["a"]["start"]) // day for c in spec["a"]["changes"]]
    assert index == list(np.linspace(0, 79, 26).round().astype(int)[1:])
    assert len(spec["b"]["changes"]) == 8
    assert (spec["a"]["yearly"], spec["a"]["weekly"], spec["a"]["daily"]) == (False, True, False)


def test_future_times(spark):
    ends = make_panel(spark, {"ends": wave(60)}, "2021-01-31", "ME")
    got = future_grid(ends, 3).orderBy("step_no").toPandas()["ts"]
    assert list(got) == list(pd.to_datetime(["2026-01-31", "2026-02-28", "2026-03-31"]))
    quarter = make_panel(spark, {"q": wave(20)}, "2020-01-01", "QS")
    assert future_grid(quarter, 1).first()["ts"] == pd.Timestamp("2025-01-01")
    half = make_panel(spark, {"h": wave(40)}, "2024-01-01", "30min")
    assert future_grid(half, 1).first()["ts"] == pd.Timestamp("2024-01-01 20:00")
    minute = make_panel(spark, {"m": wave(200)}, "2024-01-01", "min")
    r = resolve_period(minute).first()
    assert (r["period"], r["fell_back"]) == (60, False)
    stamps = pd.to_datetime(["2024-01-01", "2024-01-03", "2024-01-10", "2024-02-15"])
    odd = spark.createDataFrame([("o", t.to_pydatetime(), 1.0) for t in stamps], "series_id string, ts timestamp, y double")
    assert "no regular step" in E.ets(odd, 2).first()["error"]


def test_conformal_quantile(spark):
    rows = [("five", float(v)) for v in (3, 1, 5, 2, 4)] + [("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "series_id string, score double")
    alphas = {"a20": 0.20, "a50": 0.50, "a0": 0.0, "a5": 0.05}
    for bounded in (True, False):
        got = {r["series_id"]: r for r in C.conformal_quantile(df, ["series_id"], alphas, bounded=bounded).collect()}
        assert (got["five"]["a20"], got["five"]["a50"], got["five"]["a0"]) == (5.0, 3.0, math.inf)
        assert got["two"]["a5"] == math.inf and got["two"]["n_calibration"] == 2


def test_conformal_coverage(spark):
    series, held = {}, {}
    for i in range(12):
        y = wave(400, 80, 0.10, 10, 7, 1.5, seed=100 + i)
        series[f"s{i}"], held[f"s{i}"] = y[:350], y[350:]
    p = make_panel(spark, series, "2021-01-01")
    base = partial(D.additive, yearly=False, weekly=True, daily=False)
    out = C.conformal(base, p, 50).toPandas()
    inside = {80: [], 95: []}
    for k, g in out.groupby("series_id"):
        g = g.sort_values("step_no")
        assert g["metadata"].iloc[0]["n_calibration"] == "105"
        np.testing.assert_allclose(g["hi80"] - g["yhat"], g["yhat"] - g["lo80"])
        assert (g["hi95"] - g["yhat"]).std() < 1e-9
        for level in inside:
            inside[level] += list((held[k] >= g[f"lo{level}"]) & (held[k] <= g[f"hi{level}"]))
    assert 0.70 <= np.mean(inside[80]) <= 0.90 and 0.85 <= np.mean(inside[95]) <= 1.0


def test_short_conformal_is_unbounded(spark):
    p = make_panel(spark, {"m": wave(60, 500, 2.5, sigma=8)}, "2021-01-31", "ME")
    out = C.conformal(E.ets, p, 6)
    assert C.unbounded_intervals(out).first()["unbounded"]
    assert not C.unbounded_intervals(E.ets(p, 6)).first()["unbounded"]


def test_registry(spark):
    assert R.floor_of("prophet", True) == 200 and R.floor_of("ets", True) == 50
    with pytest.raises(KeyError):
        R.build("arima")
    R.register("twice", partial(E.ets, damped=False), 30, False)
    try:
        usable = spark.createDataFrame([("a", 120), ("b", 25), ("c", 5)], "series_id string, usable int")
        got = {r["series_id"]: r["fits"] for r in R.models_that_fit(usable).collect()}
        assert got == {"a": ["ets", "prophet", "twice"], "b": ["ets"], "c": []}
    finally:
        for d in (R.MODELS, R.FLOORS, R.HANDLES_MISSING, R._TEXT):
            d.pop("twice")


def test_a_bad_series_of_a_plugged_in_kernel_fails_alone(spark):
    def mean(values, horizon):
        if np.isnan(values).any():
            raise ArithmeticError("no mean")
        return pd.DataFrame({"yhat": np.full(horizon - (values[0] > 500), values.mean())})

    R.register("mean", R.per_series("mean", mean), 5, True)
    try:
        gap = np.where(np.arange(40) == 7, np.nan, wave(40, 10, seed=3))
        series = {"a": wave(40, 10, seed=1), "b": wave(40, 20, seed=2), "gap": gap, "short": wave(40, 900, seed=4)}
        panel = make_panel(spark, series)
        asked = [(k, k, "mean", n, False) for k, n in (("a", 3), ("b", 5), ("gap", 3), ("short", 4))]
        requests = spark.createDataFrame(asked, "job_id string, series_id string, model_name string, horizon int, conformal boolean")
        done = run_jobs(requests, panel)
        jobs = {r["job_id"]: (r["status"], r["error"]) for r in done.jobs.collect()}
        assert jobs["a"] == jobs["b"] == ("done", None)
        assert jobs["gap"] == ("failed", "ArithmeticError: no mean") and jobs["short"][1].startswith("ValueError: the model gave 3 steps of 4")
        made = {(r["job_id"], r["step_no"]): r["yhat"] for r in done.forecasts.collect()}
        assert sorted(made) == [("a", 1), ("a", 2), ("a", 3)] + [("b", k) for k in range(1, 6)]
        assert made["a", 3] == pytest.approx(series["a"].mean()) and made["b", 5] == pytest.approx(series["b"].mean())
    finally:
        for d in (R.MODELS, R.FLOORS, R.HANDLES_MISSING, R._TEXT):
            d.pop("mean")


@pytest.fixture(scope="module")
def batch(spark):
    panel = make_panel(
        spark,
        {"long": wave(200, 100, 0.1, 6, 7, 1.5, seed=1), "short": wave(60, 100, 0.1, 6, 7, 1.5, seed=2),
         "gap": np.where(np.arange(80) == 9, np.nan, wave(80, 10))},
    )
    rows = [
        ("ok", "long", "ets", 7, False), ("default", "long", None, None, None), ("refused", "short", "prophet", 7, False),
        ("gap", "gap", "ets", 7, False), ("unknown", "long", "arima", 7, False), ("none", "zzz", "ets", 7, False),
        ("far", "long", "ets", 1001, False), ("nearer", "long", "ets", 3, False),
    ]
    return panel, spark.createDataFrame(rows, "job_id string, series_id string, model_name string, horizon int, conformal boolean")


def test_jobs(batch):
    panel, requests = batch
    result = run_jobs(requests, panel)
    jobs = {r["job_id"]: r for r in result.jobs.collect()}
    assert {k: r["status"] for k, r in jobs.items()} == {
        "ok": "done", "default": "done", "nearer": "done", "refused": "failed", "gap": "failed",
        "unknown": "failed", "none": "failed", "far": "failed",
    }
    assert jobs["refused"]["error"] == (
        "ValueError: prophet needs at least 100 usable observations and this series has 60. Models that fit: ets."
    )
    assert jobs["unknown"]["error"] == "ValueError: Unknown model 'arima'. Available: prophet, ets."
    assert "missing values" in jobs["gap"]["error"] and jobs["default"]["model_name"] == "prophet"
    assert all(r["finished_at"] is not None for r in jobs.values())
    steps = {r["job_id"]: r["count"] for r in result.forecasts.groupBy("job_id").count().collect()}
    assert steps == {"ok": 7, "default": 30, "nearer": 3}


def test_nothing_accepted(spark, batch):
    panel, _ = batch
    bad = spark.createDataFrame([("x", "long", "arima")], "job_id string, series_id string, model_name string")
    result = run_jobs(bad, panel)
    assert [r["status"] for r in result.jobs.collect()] == ["failed"] and result.forecasts.count() == 0
    assert check_requests(bad, panel).first()["horizon"] == 30


def test_run_forecast(batch):
    panel, requests = batch
    row = run_forecast(panel, requests.where("job_id = 'ok'")).jobs.first()
    assert row["status"] == "done" and row["summary"].startswith("Dataset: 200 rows, daily frequency")


def test_stream(spark, batch, tmp_path):
    panel, requests = batch
    where = [f"{tmp_path}/{n}" for n in ("in", "checkpoint", "out")]
    first = requests.where("job_id in ('ok', 'refused')")
    first.unionByName(first).coalesce(1).write.json(where[0])
    stream_jobs(spark, where[0], panel, where[1], where[2]).awaitTermination()
    assert {r["job_id"]: r["status"] for r in finished_jobs(spark, where[2]).collect()} == {"ok": "done", "refused": "failed"}
    requests.where("job_id in ('ok', 'nearer')").coalesce(1).write.mode("append").json(where[0])
    stream_jobs(spark, where[0], panel, where[1], where[2]).awaitTermination()
    done = finished_jobs(spark, where[2])
    assert sorted(r["job_id"] for r in done.collect()) == ["nearer", "ok", "refused"]
    assert spark.read.parquet(f"{where[2]}/forecasts").count() == 10
