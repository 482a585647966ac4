import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import blocked, make_panel, wave
from seriesloom.operators import anomaly as A
from seriesloom.operators import seasonality as S
from seriesloom.operators import stationarity as X
from seriesloom.operators.profile import detect_frequency
from seriesloom.plans.diagnosis import digest, full_diagnosis
from seriesloom.sources.panel import compact

SPIKES = [20, 80, 150]


def spiked(seed=0):
    y = wave(200, seed=seed)
    y[SPIKES] = 50.0
    return y


@pytest.fixture(scope="module")
def panel(spark):
    gaps = spiked()
    gaps[::7] = np.nan
    gaps[SPIKES] = 50.0
    return make_panel(
        spark,
        {
            "clean": wave(200, seed=42), "spiked": spiked(), "gaps": gaps, "flat": np.full(100, 7.0),
            "skewed": np.random.default_rng(5).lognormal(0, 1, 300), "short": [1.0, 2.0, 3.0],
            "walk": np.cumsum(wave(300, seed=7)), "noise": wave(300, seed=8), "line": np.arange(60.0),
            "weekly": wave(730, amp=6, sigma=0.8, seed=9),
        },
    )


def flags(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["series_id"], {})[r["pos"]] = r["score"]
    return out


def test_zscore(panel):
    for p in (panel, blocked(panel)):
        got = flags(A.zscore_anomalies(p))
        for name in ("spiked", "gaps"):
            assert set(got[name]) == set(SPIKES) and min(got[name].values()) > 3
        assert len(got.get("clean", {})) <= 2 and "flat" not in got
    assert A.zscore_anomalies(panel, 1000.0).count() == 0


def test_isolation_forest(panel, small_pieces):
    for p in (panel, blocked(panel)):
        got = flags(A.isolation_forest_anomalies(p))
        for name in ("spiked", "gaps"):
            assert set(SPIKES) <= set(got[name]) and max(got[name].values()) < 0
        assert len(got["weekly"]) <= math.ceil(0.05 * 730)
        assert "flat" not in got
    first, again = (flags(A.isolation_forest_anomalies(panel)) for _ in range(2))
    assert first == again


def test_thinned_forest_still_scores_every_row(spark):
    y = wave(3000, seed=1)
    y[1500] = 40.0
    p = make_panel(spark, {"a": y}, freq="h")
    scores = A.forest_scores(blocked(p, 10), trees=5).toPandas().set_index("pos")["score"]
    assert len(scores) == 3000 and scores.idxmin() == 1500


def test_method_choice(panel):
    got = {r["series_id"]: r["method"] for r in A.normality(panel).collect()}
    assert got["clean"] == "zscore" and got["skewed"] == "isolation_forest" and got["flat"] == "zscore"
    assert A.detect_anomalies(panel, "whatever").select("method").distinct().first()[0] == "isolation_forest"
    auto = A.detect_anomalies(panel)
    assert {r["method"] for r in auto.where("series_id = 'skewed'").collect()} == {"isolation_forest"}


def test_normality_rejects_at_its_level():
    rng = np.random.default_rng(0)
    for n in (4, 10, 50, 300):
        p = np.array([A.shapiro_wilk(rng.normal(size=n))[1] for _ in range(600)])
        assert 0.02 < (p < 0.05).mean() < 0.09
    assert A.shapiro_wilk(rng.lognormal(size=200))[1] < 1e-4
    # Published example (Shapiro & Wilk 1965): weights of 11 men.
    w, p = A.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.79, abs=0.005) and p < 0.01


def test_rollup(panel):
    got = A.rollup_anomalies(A.zscore_anomalies(panel)).where("series_id = 'spiked'").first()
    assert got["anomaly_count"] == 3 and got["anomaly_indices"] == SPIKES
    assert [d["value"] for d in got["details"]] == [50.0] * 3


def test_stationarity(panel, small_pieces):
    got = {r["series_id"]: r for r in X.check_stationarity(panel).collect()}
    assert got["noise"]["is_stationary"] and got["noise"]["recommended_differencing"] == 0
    assert got["noise"]["adf_pvalue"] < 0.05 < got["noise"]["kpss_pvalue"]
    assert not got["walk"]["is_stationary"] and got["walk"]["recommended_differencing"] >= 1
    assert got["short"]["note"] == "series too short (3 obs, need ≥ 20)" and got["short"]["adf_pvalue"] is None
    flat = got["flat"]
    assert (flat["is_stationary"], flat["adf_pvalue"], flat["kpss_pvalue"], flat["note"]) == (True, 0.0, 1.0, "constant series")
    assert not got["line"]["is_stationary"] and got["line"]["recommended_differencing"] == 1
    split = {r["series_id"]: r for r in X.check_stationarity(blocked(panel)).collect()}
    for k, r in got.items():
        assert split[k]["recommended_differencing"] == r["recommended_differencing"], k
        if r["adf_pvalue"] is not None and k != "line":
            assert split[k]["adf_pvalue"] == pytest.approx(r["adf_pvalue"], abs=2e-6), k
            assert split[k]["kpss_pvalue"] == pytest.approx(r["kpss_pvalue"], abs=2e-6), k


def brute_adf(y):
    """Least squares for every lag on the common sample, then a refit: no shared sums."""
    n, dy = len(y), np.diff(y)
    top = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def ols(first, lag):
        t = np.arange(first, n)
        x = np.column_stack([np.ones(len(t)), y[t - 1], *[dy[t - 1 - j] for j in range(1, lag + 1)]])
        beta, *_ = np.linalg.lstsq(x, dy[t - 1], rcond=None)
        res = dy[t - 1] - x @ beta
        return len(t), x, beta, res @ res

    def aic(lag):
        m, _, _, ssr = ols(top + 1, lag)
        return m * np.log(ssr / m) + 2 * (lag + 2)

    lag = min(range(top + 1), key=aic)
    m, x, beta, ssr = ols(lag + 1, lag)
    return beta[1] / np.sqrt(ssr / (m - lag - 2) * np.linalg.inv(x.T @ x)[1, 1]), lag


def test_adf_matches_brute_force(panel, small_pieces):
    rows = compact(panel.where(F.col("series_id").isin("noise", "walk", "weekly", "skewed")))
    values = {k: g.sort_values("pos")["y"].to_numpy() for k, g in rows.toPandas().groupby("series_id")}
    got = X.adf(rows).collect()
    assert len(got) == 4
    for r in got:
        stat, lag = brute_adf(values[r["series_id"]])
        assert r["lag"] == lag and r["stat"] == pytest.approx(stat, rel=1e-7)


def test_adf_and_kpss_sizes():
    """Rejection rates under the null of each test (300 points)."""
    rng = np.random.default_rng(2)
    lags = 16
    walks, noise = [], []
    for _ in range(150):
        w = np.cumsum(rng.normal(size=300))
        z = (w - w.mean()) / w.std()
        walks.append(X.adf_pvalue(X.adf_from_sums(X._design_gram(z, lags + 1, lags), z[: lags + 2], 300)[0]) < 0.05)
        e = rng.normal(size=300)
        noise.append(X.kpss_whole(e - e.mean())[0] > 0.463)
    assert np.mean(walks) < 0.13 and np.mean(noise) < 0.11


def test_differences(panel):
    y = panel.where("series_id = 'weekly'").orderBy("ts").toPandas()["y"].to_numpy()
    for p in (panel, blocked(panel)):
        got = X.differences(p).where("series_id = 'weekly'").toPandas()
        for d in (0, 1, 2):
            have = got[got["d"] == d].sort_values("pos")["y"].to_numpy()
            np.testing.assert_allclose(have, np.diff(y, d), atol=1e-12)


def test_interpolation_is_pandas(spark, small_pieces):
    rng = np.random.default_rng(4)
    series = {}
    for k, n in (("a", 350), ("b", 20), ("ends", 30)):
        y = rng.normal(size=n)
        y[rng.random(n) < 0.4] = np.nan
        series[k] = y
    series["ends"][:4] = np.nan
    series["ends"][-3:] = np.nan
    series["a"][90:260] = np.nan  # a gap longer than a piece
    series["none"] = np.full(5, np.nan)
    p = make_panel(spark, series)
    empty = spark.createDataFrame([], "series_id string, pos bigint")
    for x in (p, blocked(p)):
        got = S.despike(x, empty).toPandas().sort_values("pos").groupby("series_id")["y"]
        for k, y in series.items():
            want = pd.Series(y).interpolate(limit_direction="both")
            np.testing.assert_allclose(got.get_group(k).to_numpy(float), want.to_numpy(), atol=1e-12)


def test_spectrum_and_acf_are_numpy(spark, small_pieces):
    series = {f"s{n}": wave(n, amp=3, period=12, seed=n) for n in (64, 301, 500)}
    p = make_panel(spark, series)
    for x in (p, blocked(p)):
        rows = S.detrend(x)
        lag = S.acf(rows, 40).toPandas().sort_values("lag").groupby("series_id")["acf"]
        spec = S.power(rows, fft_rows=10).toPandas().sort_values("k").groupby("series_id")
        total = {r["series_id"]: r["total_power"] for r in S.total_power(rows).collect()}
        for k, y in series.items():
            t = np.arange(len(y))
            e = y - np.polyval(np.polyfit(t, y, 1), t)
            want = np.array([e[i:] @ e[: len(e) - i] for i in range(min(40, len(e) // 2 - 1) + 1)]) / (e @ e)
            np.testing.assert_allclose(lag.get_group(k), want, atol=1e-9)
            power = np.abs(np.fft.rfft(e))[1:] ** 2
            np.testing.assert_allclose(spec.get_group(k)["power"], power, rtol=1e-6, atol=1e-6)
            assert total[k] == pytest.approx(power.sum(), rel=1e-9)
            f = np.fft.rfftfreq(len(y))[1:]
            assert (spec.get_group(k)["period"].to_numpy() == np.round(1 / f).astype(int)).all()


def test_seasonality(spark, small_pieces):
    gaps = wave(730, amp=6, sigma=0.8, seed=9)
    gaps[::20] = np.nan
    p = make_panel(spark, {"weekly": wave(730, amp=6, sigma=0.8, seed=9), "noise": wave(200, seed=11), "gaps": gaps,
                           "short": [1.0, 2.0, 3.0], "flat": np.full(50, 3.0)})
    freq = detect_frequency(p)
    for x in (p, blocked(p)):
        got = {r["series_id"]: r for r in S.detect_seasonality(x, freq).collect()}
        assert 7 in got["weekly"]["detected_periods"] and got["weekly"]["dominant_period"] == 7
        assert got["weekly"]["seasonality_strength"] > 0.5 and got["noise"]["seasonality_strength"] < 0.3
        for k in ("short", "flat"):
            assert (got[k]["has_seasonality"], got[k]["detected_periods"], got[k]["seasonality_strength"]) == (False, [], 0.0)
        assert "gaps" in got


@pytest.fixture(scope="module")
def sales(spark):
    y = wave(730, 100, 0.15, 8, 7, 2, seed=3)
    y[[50, 200, 500]] = 500.0
    y[[10, 100, 300, 450, 600]] = np.nan
    return make_panel(spark, {"sales": y, "other": np.full(60, 5.0)}, "2022-01-01")


def test_pipeline(sales):
    full = full_diagnosis(sales, "sales")
    got = {r["series_id"]: r for r in full.collect()}
    r = got["sales"]
    assert r["profile"]["detected_frequency"] == "daily" and r["profile"]["missing_count"] == 5
    assert not r["stationarity"]["is_stationary"] and r["stationarity"]["recommended_differencing"] >= 1
    assert r["seasonality"]["dominant_period"] == 7 and r["seasonality"]["seasonality_strength"] > 0.1
    assert r["anomalies"]["anomaly_count"] >= 3
    assert got["other"]["anomalies"]["anomaly_count"] == 0
    text = {x["series_id"]: x["summary"] for x in digest(full).collect()}
    lines = text["sales"].split("\n")
    assert len(lines) == 6 and lines[0] == "Dataset: 730 rows, daily frequency, Jan 2022 to Dec 2023."
    assert lines[1].startswith("Target column: 'sales' (mean: ") and lines[2] == "5 missing values detected (0.7%)."
    assert lines[3].startswith("Series is non-stationary (ADF p=") and "differencing recommended." in lines[3]
    assert "(period=7, strength=" in lines[4] and lines[5].endswith("method).")
    other = text["other"].split("\n")
    assert other[3] == "Series is stationary (ADF p=0.00, KPSS p=1.00)." and other[5] == "No anomalies detected."


def test_pipeline_by_blocks_agrees(sales, small_pieces):
    want = {r["series_id"]: r for r in full_diagnosis(sales, "sales", "zscore").collect()}
    got = {r["series_id"]: r for r in full_diagnosis(blocked(sales), "sales", "zscore").collect()}
    for k, w in want.items():
        for part in ("seasonality", "anomalies"):
            assert got[k][part] == w[part]
        assert got[k]["stationarity"]["recommended_differencing"] == w["stationarity"]["recommended_differencing"]
        assert got[k]["profile"]["row_count"] == w["profile"]["row_count"]
