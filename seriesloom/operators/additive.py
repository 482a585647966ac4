"""Additive model: piecewise-linear trend plus Fourier seasons (Taylor & Letham 2018).

Given the changepoints the likelihood depends on the data only through the Gram matrix of
the design, so a series of any length reduces to one small matrix: pieces add up their
own, the sums meet once per series, and the posterior mode is solved there.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.lineage import checkpoint
from seriesloom.functions.order import PIECE_ROWS, pieces, spread
from seriesloom.operators.ets import Z80, Z95, failures, irregular_series
from seriesloom.operators.grid import future_grid, steps_of
from seriesloom.sources.panel import compact, drop_missing, is_bounded

# The published defaults of the model.
CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
CHANGEPOINT_SCALE = 0.05
SEASON_SCALE = 10.0
TREND_SCALE = 5.0
NOISE_SCALE = 0.5
SEASONS = {"yearly": (365.25, 10), "weekly": (7.0, 3), "daily": (1.0, 4)}

_DAY = 86_400.0 * 1e6


def _season_flag(choice: str | bool, automatic: Column) -> Column:
    return automatic if choice == "auto" else F.lit(bool(choice))


def additive_spec(
    rows: DataFrame, yearly: str | bool, weekly: str | bool, daily: str | bool, n_changepoints: int
) -> DataFrame:
    """Per series: time range, value scale, which seasons are on, and the changepoint times."""
    micros = F.unix_micros("ts")
    gap = micros - F.unix_micros("prev_ts")
    stats = rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(micros).alias("start"),
        F.max(micros).alias("end"),
        F.max(F.abs("y")).alias("_top"),
        F.min(F.when(gap > 0, gap)).alias("_gap"),
    )
    span, day = (F.col("end") - F.col("start")) / F.lit(_DAY), F.col("_gap") / F.lit(_DAY)
    history = F.floor(F.col("n") * F.lit(CHANGEPOINT_RANGE))
    stats = stats.where((F.col("n") >= 2) & (F.col("end") > F.col("start"))).select(
        "series_id",
        "n",
        "start",
        "end",
        F.when(F.col("_top") > 0, F.col("_top")).otherwise(F.lit(1.0)).alias("scale"),
        _season_flag(yearly, span >= 730).alias("yearly"),
        _season_flag(weekly, (span >= 14) & (day < 7)).alias("weekly"),
        _season_flag(daily, (span >= 2) & (day < 1)).alias("daily"),
        history.alias("_history"),
        F.greatest(F.least(F.lit(n_changepoints), history - 1), F.lit(0)).cast("int").alias("_cps"),
    )
    if n_changepoints <= 0:
        return stats.drop("_history", "_cps").withColumn("changes", F.array().cast("array<bigint>"))
    # Changepoints sit on rows, evenly spaced over the first part of the history.
    wanted = F.transform(
        F.sequence(F.lit(1), F.greatest(F.col("_cps"), F.lit(1))),
        lambda i: F.rint(i * (F.col("_history") - 1) / F.greatest(F.col("_cps"), F.lit(1))).cast("bigint"),
    )
    at = (
        stats.where(F.col("_cps") > 0)
        .select("series_id", F.explode(wanted).alias("pos"))
        .join(rows.select("series_id", "pos", micros.alias("_at")), ["series_id", "pos"])
        .groupBy("series_id")
        .agg(F.sort_array(F.collect_list("_at")).alias("changes"))
    )
    return (
        stats.drop("_history", "_cps")
        .join(at, "series_id", "left")
        .withColumn("changes", F.coalesce("changes", F.array().cast("array<bigint>")))
    )


def _design(micros: np.ndarray, spec: pd.Series) -> np.ndarray:
    span = float(spec["end"] - spec["start"])
    t = (micros - spec["start"]) / span
    columns = [t, np.ones(len(t))]
    columns += [np.maximum(t - (c - spec["start"]) / span, 0.0) for c in spec["changes"]]
    days = micros / _DAY
    for name, (period, order) in SEASONS.items():
        if spec[name]:
            for i in range(1, order + 1):
                angle = 2 * np.pi * i * days / period
                columns += [np.sin(angle), np.cos(angle)]
    return np.column_stack(columns)


def _gram(pdf: pd.DataFrame) -> np.ndarray:
    """Gram matrix of the design with the scaled value as last column, in bounded chunks."""
    spec = pdf.iloc[0]
    total = 0.0
    for lo in range(0, len(pdf), PIECE_ROWS):
        part = pdf.iloc[lo : lo + PIECE_ROWS]
        x = _design(part["micros"].to_numpy(np.int64), spec)
        xy = np.column_stack([x, part["y"].to_numpy(float) / spec["scale"]])
        total = total + xy.T @ xy
    return total


def posterior_mode(g: np.ndarray, n: int, changes: int, tau: float) -> tuple[np.ndarray, float]:
    """Mode of the posterior from a Gram matrix: Laplace prior on rate changes, normal on the rest.

    The Laplace prior is handled by reweighted ridge steps; the noise scale has a closed form
    given the coefficients.
    """
    p = len(g) - 1
    a, b, c = g[:p, :p], g[:p, p], g[p, p]
    precision = np.full(p, 1.0 / SEASON_SCALE**2)
    precision[:2] = 1.0 / TREND_SCALE**2
    delta = slice(2, 2 + changes)
    precision[delta] = 1.0 / tau**2
    noise, theta = max(c / n, 1e-12), np.zeros(p)
    for _ in range(100):
        new = np.linalg.solve(a / noise + np.diag(precision), b / noise)
        residual = max(float(c - 2 * new @ b + new @ a @ new), 0.0)
        # Stationary point of n log s + R / (2 s^2) + s^2 / (2 h^2) in s^2.
        h2 = NOISE_SCALE**2
        noise = max(2 * residual / (n + math.sqrt(n * n + 4 * residual / h2)), 1e-12)
        precision[delta] = 1.0 / (tau * np.maximum(np.abs(new[delta]), 1e-6))
        done = np.max(np.abs(new - theta)) < 1e-9
        theta = new
        if done:
            break
    return theta, math.sqrt(noise)


_FIT = (
    "series_id string, n bigint, k double, m double, delta array<double>, yearly_beta array<double>, "
    "weekly_beta array<double>, daily_beta array<double>, sigma double, error string"
)


def _solved(sid: str, g: np.ndarray, spec: pd.Series, tau: float) -> pd.DataFrame:
    row = dict.fromkeys(["k", "m", "delta", "yearly_beta", "weekly_beta", "daily_beta", "sigma", "error"])
    try:
        changes = len(spec["changes"])
        theta, sigma = posterior_mode(g, int(spec["n"]), changes, tau)
        scale, at = float(spec["scale"]), 2 + changes
        row.update(k=theta[0] * scale, m=theta[1] * scale, delta=(theta[2:at] * scale).tolist(), sigma=sigma * scale)
        for name, (_, order) in SEASONS.items():
            size = 2 * order if spec[name] else 0
            row[f"{name}_beta"] = (theta[at : at + size] * scale).tolist()
            at += size
    except Exception as exc:  # recorded against this series only
        row["error"] = f"{type(exc).__name__}: {exc}"
    return pd.DataFrame([{"series_id": sid, "n": int(spec["n"]), **row}])


def _whole_kernel(tau: float):
    return lambda key, pdf: _solved(key[0], _gram(pdf), pdf.iloc[0], tau)


def _piece_kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    g = _gram(pdf)
    i, j = np.triu_indices(len(g))
    return pd.DataFrame({"series_id": key[0], "i": i, "j": j, "v": g[i, j]})


def _cells_kernel(tau: float):
    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(pdf["j"].max()) + 1
        g = np.zeros((size, size))
        g[pdf["i"], pdf["j"]] = pdf["v"]
        g[pdf["j"], pdf["i"]] = pdf["v"]
        return _solved(key[0], g, pdf.iloc[0], tau)

    return kernel


def gram_cells(keyed: DataFrame) -> DataFrame:
    """``(series_id, i, j, v)``: upper triangle of each series' Gram matrix, summed over its pieces."""
    return (
        pieces(keyed)
        .groupBy("series_id", "piece")
        .applyInPandas(_piece_kernel, "series_id string, i int, j int, v double")
        .groupBy("series_id", "i", "j")
        .agg(F.sum("v").alias("v"))
    )


def fit_additive(rows: DataFrame, spec: DataFrame, changepoint_scale: float, bounded: bool) -> DataFrame:
    """Coefficients per series from :func:`compact` rows and their spec."""
    keyed = rows.select("series_id", "pos", F.unix_micros("ts").alias("micros"), "y").join(spec, "series_id")
    if bounded:
        return keyed.groupBy("series_id").applyInPandas(_whole_kernel(changepoint_scale), _FIT)
    return gram_cells(keyed).join(spec, "series_id").groupBy("series_id").applyInPandas(_cells_kernel(changepoint_scale), _FIT)


def _season(beta: str, period: float, days: Column) -> Column:
    """Fourier sum from interleaved sine and cosine coefficients; 0 for an empty array."""
    return F.aggregate(
        F.transform(beta, lambda b, i: b * F.when(
            i % 2 == 0, F.sin((F.floor(i / 2) + 1) * days * F.lit(2 * math.pi / period))
        ).otherwise(F.cos((F.floor(i / 2) + 1) * days * F.lit(2 * math.pi / period)))),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def predict_additive(fit: DataFrame, spec: DataFrame, grid: DataFrame, metadata: Column) -> DataFrame:
    """Join future times to coefficients; bounds from noise plus future rate changes, closed form."""
    span = (F.col("end") - F.col("start")).cast("double")
    t = (F.unix_micros("ts") - F.col("start")) / span
    kinks = F.aggregate(
        F.zip_with("delta", "changes", lambda d, c: d * F.greatest(t - (c - F.col("start")) / span, F.lit(0.0))),
        F.lit(0.0),
        lambda total, x: total + x,
    )
    days = F.unix_micros("ts") / F.lit(_DAY)
    mean = F.col("k") * t + F.col("m") + kinks
    for name, (period, _) in SEASONS.items():
        mean = mean + _season(f"{name}_beta", period, days)
    count = F.size("delta")
    size = F.aggregate(F.transform("delta", F.abs), F.lit(0.0), lambda total, x: total + x)
    rate = F.when(count > 0, size / F.greatest(count, F.lit(1))).otherwise(F.lit(0.0))
    beyond = F.greatest(t - 1, F.lit(0.0))
    spread = F.sqrt(F.col("sigma") * F.col("sigma") + count * 2 * rate * rate * F.pow(beyond, F.lit(3.0)) / 3)
    out = (
        grid.join(fit.where(F.col("error").isNull()).drop("n"), "series_id")
        .join(spec.select("series_id", "start", "end", "changes"), "series_id")
        .withColumn("yhat", mean)
        .withColumn("_w", spread)
    )
    return out.select(
        "series_id",
        F.lit("prophet").alias("model_name"),
        "step_no",
        "ts",
        "yhat",
        (F.col("yhat") - Z80 * F.col("_w")).alias("lo80"),
        (F.col("yhat") + Z80 * F.col("_w")).alias("hi80"),
        (F.col("yhat") - Z95 * F.col("_w")).alias("lo95"),
        (F.col("yhat") + Z95 * F.col("_w")).alias("hi95"),
        metadata.alias("metadata"),
        F.lit(None).cast("string").alias("error"),
    )


def additive(
    panel: DataFrame,
    horizon: int | DataFrame,
    yearly: str | bool = "auto",
    weekly: str | bool = "auto",
    daily: str | bool = "auto",
    changepoint_scale: float = CHANGEPOINT_SCALE,
    n_changepoints: int = CHANGEPOINTS,
) -> DataFrame:
    """Fit and forecast every series; missing values are skipped, future times follow the step."""
    panel = checkpoint(panel)  # read by the step, the fit and the grid
    steps = checkpoint(steps_of(panel))
    rows = compact(spread(panel, "series_id") if is_bounded(panel) else panel)
    spec = checkpoint(additive_spec(rows, yearly, weekly, daily, n_changepoints))
    fit = checkpoint(fit_additive(rows, spec, changepoint_scale, is_bounded(panel)))
    # Future times continue after the last usable row, not after trailing missing ones.
    grid = future_grid(drop_missing(panel), horizon, steps)
    meta = F.create_map(
        F.lit("changepoint_prior_scale"), F.lit(str(changepoint_scale)),
        F.lit("yearly_seasonality"), F.lit(str(yearly).lower()),
        F.lit("weekly_seasonality"), F.lit(str(weekly).lower()),
        F.lit("daily_seasonality"), F.lit(str(daily).lower()),
    )
    # A regular series with too few usable rows, or all at one time, has no spec and so no fit.
    few = F.lit("ValueError: the additive model needs at least two usable rows at different times.")
    unfit = steps.where("regular").join(spec, "series_id", "left_anti").select("series_id", few.alias("error"))
    bad = fit.where(F.col("error").isNotNull()).select("series_id", "error").unionByName(irregular_series(steps)).unionByName(unfit)
    return predict_additive(fit, spec, grid, meta).unionByName(failures(bad, "prophet"))
