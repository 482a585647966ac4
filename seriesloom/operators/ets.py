"""Exponential smoothing with additive or multiplicative error, trend and season.

For additive components the one-step errors are linear in the initial state. One pass
over the values, vectorised over candidate smoothing parameters, therefore gives the
squared error of every candidate as a small quadratic form, whose minimum over the
initial state is exact. Such forms compose: a long series is cut into pieces, each piece
yields its form and its state map, and a fold over those few matrices gives the result.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.lineage import checkpoint
from seriesloom.functions.numeric import exact_round, ratio
from seriesloom.functions.order import PIECE_ROWS, pieces, spread
from seriesloom.operators.grid import future_grid, period_of, steps_of
from seriesloom.sources.panel import SERIES_ROWS, is_bounded, with_pos

Z80, Z95 = NormalDist().inv_cdf(0.90), NormalDist().inv_cdf(0.975)
# Simulated paths per series, and the quantiles taken of them.
PATHS, BOUNDS = 10_000, (0.025, 0.1, 0.9, 0.975)
GAPS = "ValueError: smoothing cannot run over missing values; fill them or drop them before the fit."

# Search space per parameter: first grid, then steps halved around the best point.
_LEVELS = {"alpha": (0.02, 0.1, 0.3, 0.6, 0.9), "beta": (0.005, 0.1, 0.5), "gamma": (0.005, 0.1, 0.5), "phi": (0.0, 0.5, 1.0)}
_ROUNDS = 6
_FIRST_STEP = 0.15
_PHI = (0.80, 0.98)

FIT = (
    "n bigint, period int, fell_back boolean, alpha double, beta double, gamma double, phi double, "
    "level double, slope double, season array<double>, sse double, sigma2 double, aic double, error string"
)
_FIT_COLUMNS = [c.split()[0] for c in FIT.split(", ")]


def _space(trend: bool, damped: bool, seasonal: bool, fixed: dict | None) -> list[str]:
    names = ["alpha"] + ["beta"] * trend + ["gamma"] * seasonal + ["phi"] * (trend and damped)
    return [p for p in names if p not in (fixed or {})]


def _parameters(points: np.ndarray, free: list[str], trend: bool, damped: bool, fixed: dict | None) -> np.ndarray:
    """Unit-cube points to (alpha, beta, gamma, phi) inside the admissible region."""
    fixed = fixed or {}
    unit = {p: points[:, i] for i, p in enumerate(free)}
    one = np.ones(len(points))
    alpha = one * fixed["alpha"] if "alpha" in fixed else np.clip(unit["alpha"], 1e-4, 1 - 1e-4)
    beta = one * fixed["beta"] if "beta" in fixed else alpha * np.clip(unit.get("beta", 0 * one), 1e-4, 1 - 1e-4)
    gamma = one * fixed["gamma"] if "gamma" in fixed else (1 - alpha) * np.clip(unit.get("gamma", 0 * one), 1e-4, 1 - 1e-4)
    if not trend:
        beta = 0 * one
    phi = one * fixed["phi"] if "phi" in fixed else (
        _PHI[0] + (_PHI[1] - _PHI[0]) * np.clip(unit["phi"], 0, 1) if trend and damped else one
    )
    return np.column_stack([alpha, beta, gamma, phi])


def _first_points(free: list[str]) -> np.ndarray:
    return np.array(list(itertools.product(*[_LEVELS[p] for p in free])) or [[]], dtype=float)


def _around(best: np.ndarray, step: float) -> np.ndarray:
    moves = np.array(list(itertools.product((-step, 0.0, step), repeat=len(best))) or [[]])
    return np.clip(best + moves, 0.0, 1.0)


def sweep(y: np.ndarray, start: int, params: np.ndarray, m: int, trend: bool) -> tuple[np.ndarray, np.ndarray]:
    """Run the recursions from a symbolic initial state.

    Returns, per candidate, the Gram matrix of the errors as affine functions of that state
    and the affine map to the state after the last value.
    """
    k, base = len(params), 1 + int(trend)
    p = base + m
    alpha, beta, gamma, phi = (np.repeat(params[:, [i]], p + 1, axis=1) for i in range(4))
    parts = np.zeros((p, k, p + 1))
    parts[np.arange(p), :, np.arange(p)] = 1.0
    level, slope, season = parts[0], parts[1] if trend else None, parts[base:]
    gram = np.zeros((k, p + 1, p + 1))
    size = max(1, min(len(y), 4_000_000 // (k * (p + 1)) + 1, 1024))
    buffer, step = np.empty((size, k, p + 1)), np.empty((k, p + 1))
    filled = 0
    for i, value in enumerate(y.tolist()):
        if trend:
            slope *= phi
            level += slope
        e = buffer[filled]
        if m:
            now = season[(start + i) % m]
            np.add(level, now, out=e)
            np.negative(e, out=e)
        else:
            np.negative(level, out=e)
        e[:, -1] += value
        level += np.multiply(alpha, e, out=step)
        if trend:
            slope += np.multiply(beta, e, out=step)
        if m:
            now += np.multiply(gamma, e, out=step)
        filled += 1
        if filled == size:
            gram += buffer.transpose(1, 2, 0) @ buffer.transpose(1, 0, 2)
            filled = 0
    if filled:
        part = buffer[:filled]
        gram += part.transpose(1, 2, 0) @ part.transpose(1, 0, 2)
    return gram, parts.transpose(1, 0, 2)


def best_initial(gram: np.ndarray, m: int, trend: bool) -> tuple[np.ndarray, np.ndarray]:
    """Initial states that minimise each quadratic form (seasons summing to zero), and the minima."""
    p = gram.shape[1] - 1
    q = gram[:, :p, :p].copy()
    scale = np.maximum(np.trace(q, axis1=1, axis2=2) / p, 1e-300)
    if m:
        ones = np.zeros(p)
        ones[1 + int(trend):] = 1.0
        q += scale[:, None, None] * np.outer(ones, ones)
    q += (1e-10 * scale)[:, None, None] * np.eye(p)
    x = -np.linalg.solve(q, gram[:, :p, p:])[:, :, 0]
    full = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    return full, np.maximum(np.einsum("ki,kij,kj->k", full, gram, full), 0.0)


def _aic(sse: float, n: int, states: int) -> float:
    return n * (math.log(2 * math.pi * max(sse, 1e-300) / n) + 1) + 2 * states


def _row(params, state, sse, n, m, trend, free, scale, centre, aic=None) -> dict:
    alpha, beta, gamma, phi = params
    states = len(free) + 1 + int(trend) + m
    sse = float(sse) * scale**2
    return {
        "alpha": alpha,
        "beta": beta,
        "gamma": gamma if m else 0.0,
        "phi": phi,
        "level": state[0] * scale + centre,
        "slope": state[1] * scale if trend else 0.0,
        "season": (state[1 + int(trend):] * scale).tolist(),
        "sse": sse,
        "sigma2": sse / n,
        "aic": _aic(sse, n, states) if aic is None else aic,
    }


def fit_values(y: np.ndarray, m: int, trend: bool, damped: bool, fixed: dict | None = None) -> dict:
    """Least-squares fit of one series: zooming search over the smoothing parameters."""
    free = _space(trend, damped, m > 0, fixed)
    centre, scale = float(y.mean()), float(y.std()) or 1.0
    z = (y - centre) / scale
    points, best = _first_points(free), None
    for turn in range(_ROUNDS + 1):
        params = _parameters(points, free, trend, damped, fixed)
        gram, state = sweep(z, 0, params, m, trend)
        x, sse = best_initial(gram, m, trend)
        i = int(np.argmin(sse))
        if best is None or sse[i] <= best[0]:
            best = (sse[i], points[i], params[i], state[i] @ x[i])
        if not free:
            break
        points = _around(best[1], _FIRST_STEP / 2**turn)
    return _row(best[2], best[3], best[0], len(y), m, trend, free, scale, centre)


# -- multiplicative components -------------------------------------------------------


def _start_values(y: np.ndarray, m: int, trend: str | None, seasonal: str | None) -> tuple[float, float, np.ndarray]:
    """Level, slope and seasons from the first cycles (classical decomposition)."""
    season = np.zeros(0)
    if m:
        cycles = y[: len(y) // m * m].reshape(-1, m)
        means = cycles.mean(axis=1, keepdims=True)
        season = (cycles / means if seasonal == "mul" else cycles - means).mean(axis=0)
    head = y[: max(2 * m, min(10, len(y)))].mean()
    span = max(m, 1)
    later = y[span : 2 * span].mean() if len(y) >= 2 * span else y[-1]
    first = y[:span].mean()
    if trend == "mul":
        return head, (later / first) ** (1.0 / span), season
    return head, (later - first) / span if trend else 0.0, season


def _ahead(level, slope, s, phi, trend: str | None, seasonal: str | None):
    """One step ahead: the damped slope, the level without season, and the mean."""
    damped = slope**phi if trend == "mul" else phi * slope
    ahead = level * damped if trend == "mul" else level + (damped if trend else 0.0)
    return damped, ahead, ahead if s is None else (ahead * s if seasonal == "mul" else ahead + s)


def _moved(raw, damped, ahead, s, alpha, beta, gamma, trend: str | None, seasonal: str | None):
    """Level, slope and season after a value that was ``raw`` off the mean."""
    gain = raw / s if s is not None and seasonal == "mul" else raw  # the error in units of the level
    level, slope = ahead + alpha * gain, damped
    if trend == "mul":
        slope = damped + beta * gain / np.maximum(np.abs(ahead), 1e-12)
    elif trend:
        slope = damped + beta * gain
    return level, slope, None if s is None else s + gamma * (raw / ahead if seasonal == "mul" else raw)


class _Fold:
    """Recursions with multiplicative parts, vectorised over candidates; takes a series stretch by stretch."""

    def __init__(self, start: tuple, params: np.ndarray, m: int, error: str, trend: str | None, seasonal: str | None) -> None:
        self.params, self.m, self.kinds, self.n = params, m, (error, trend, seasonal), 0
        level0, slope0, season0 = start
        self.level, self.slope = np.full(len(params), level0), np.full(len(params), slope0)
        self.season = np.tile(season0, (len(params), 1))
        self.squares, self.logs = np.zeros(len(params)), np.zeros(len(params))

    def take(self, y: np.ndarray) -> None:
        alpha, beta, gamma, phi = self.params.T
        m, (error, trend, seasonal) = self.m, self.kinds
        level, slope, season, squares, logs = self.level, self.slope, self.season, self.squares, self.logs
        for i, value in enumerate(y, self.n):
            s = season[:, i % m] if m else None
            damped, ahead, mean = _ahead(level, slope, s, phi, trend, seasonal)
            raw = value - mean
            e = raw / mean if error == "mul" else raw
            squares += e * e
            logs += np.log(np.abs(mean)) if error == "mul" else 0.0
            level, slope, moved = _moved(raw, damped, ahead, s, alpha, beta, gamma, trend, seasonal)
            if s is not None:
                season[:, i % m] = moved
        self.level, self.slope = level, slope
        self.n += len(y)

    def best(self) -> tuple[int, float, float, np.ndarray]:
        """The best candidate: its number, objective, sum of squares and last state."""
        objective = self.n * np.log(np.maximum(self.squares, 1e-300)) + 2 * self.logs
        objective = np.where(np.isfinite(objective), objective, np.inf)
        i = int(np.argmin(objective))
        state = np.concatenate([[self.level[i]], [self.slope[i]] * (self.kinds[1] is not None), self.season[i]])
        return i, objective[i], self.squares[i], state


def _general_row(params, state, objective, squares, n, m, has_trend, free) -> dict:
    aic = objective + n * (math.log(2 * math.pi / n) + 1) + 2 * (len(free) + 1 + int(has_trend) + m)
    return _row(params, state, squares, n, m, has_trend, free, 1.0, 0.0, aic)


def fit_general(
    y: np.ndarray, m: int, error: str, trend: str | None, seasonal: str | None, damped: bool, fixed: dict | None = None
) -> dict:
    """Fit with at least one multiplicative part; needs positive values."""
    if (y <= 0).any():
        raise ValueError("multiplicative components need strictly positive values.")
    has_trend = trend is not None
    free = _space(has_trend, damped, m > 0, fixed)
    points, best = _first_points(free), None
    with np.errstate(all="ignore"):
        start = _start_values(y, m, trend, seasonal)
        for turn in range(_ROUNDS + 1):
            params = _parameters(points, free, has_trend, damped, fixed)
            fold = _Fold(start, params, m, error, trend, seasonal)
            fold.take(y)
            i, objective, squares, state = fold.best()
            if best is None or objective <= best[0]:
                best = (objective, points[i], params[i], state, squares)
            if not free:
                break
            points = _around(best[1], _FIRST_STEP / 2**turn)
    return _general_row(best[2], best[3], best[0], best[4], len(y), m, has_trend, free)


# -- fitting a panel -----------------------------------------------------------------


def _fit_kernel(error: str, trend: str | None, seasonal: str | None, damped: bool, fixed: dict | None):
    additive = error == "add" and trend in (None, "add") and seasonal in (None, "add")

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        period = pdf["period"].iloc[0]
        m = 0 if seasonal is None or pd.isna(period) else int(period)
        row = dict.fromkeys(_FIT_COLUMNS)
        row.update(n=len(pdf), period=m or None, fell_back=bool(pdf["fell_back"].iloc[0]))
        try:
            y = pdf["y"].to_numpy(float)
            if np.isnan(y).any():
                raise ValueError(GAPS.removeprefix("ValueError: "))
            if additive:
                row.update(fit_values(y, m, trend is not None, damped, fixed))
            else:
                row.update(fit_general(y, m, error, trend, seasonal, damped, fixed))
        except Exception as exc:  # one series' failure is its own result, never the batch's
            row["error"] = f"{type(exc).__name__}: {exc}"
        return pd.DataFrame([{"series_id": key[0], **row}])

    return kernel


def fit_ets(
    panel: DataFrame,
    seasonal_periods: int | None = None,
    error: str = "add",
    trend: str | None = "add",
    seasonal: str | None = "add",
    damped: bool = True,
    fixed: dict | None = None,
    steps: DataFrame | None = None,
) -> DataFrame:
    """One row of parameters, final state and fit statistics per series.

    ``fixed`` pins some of alpha, beta, gamma and phi. A series that cannot be fitted has
    its message in ``error``.
    """
    steps = steps_of(panel) if steps is None else steps
    rows = with_pos(spread(panel, "series_id") if is_bounded(panel) else panel)
    sizes = panel.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    period, fell_back = period_of(F.col("n"), F.col("step"), seasonal_periods)
    if seasonal is None:
        period, fell_back = F.lit(None).cast("int"), F.lit(False)
    keyed = rows.join(
        sizes.join(steps, "series_id").select(
            "series_id", "n", period.alias("period"), fell_back.alias("fell_back")
        ),
        "series_id",
    )
    columns = ["series_id", "pos", "y", "period", "fell_back"]
    kernel = _fit_kernel(error, trend, seasonal, damped, fixed)
    additive = error == "add" and trend in (None, "add") and seasonal in (None, "add")
    if is_bounded(panel):
        return keyed.select(*columns).groupBy("series_id").applyInPandas(kernel, f"series_id string, {FIT}")
    if not additive:  # no composable form: one task per series, above the task's bound batch by batch
        fits = keyed.where(F.col("n") <= SERIES_ROWS).select(*columns).groupBy("series_id").applyInPandas(
            kernel, f"series_id string, {FIT}"
        )
        long_rows = keyed.where(F.col("n") > SERIES_ROWS).select(*columns, "n")
        return fits.unionByName(fit_streamed(long_rows, error, trend, seasonal, damped, fixed))
    short = keyed.where(F.col("n") <= PIECE_ROWS).select(*columns)
    fitted = short.groupBy("series_id").applyInPandas(kernel, f"series_id string, {FIT}")
    long_rows = keyed.where(F.col("n") > PIECE_ROWS).select(*columns, "n")
    return fitted.unionByName(fit_pieces(long_rows, trend is not None, damped, seasonal is not None, fixed))


_FORM = "series_id string, candidate int, piece bigint, n bigint, period int, fell_back boolean, points array<double>, gram array<double>, state array<double>"


def _piece_kernel(trend: bool, damped: bool, seasonal: bool, fixed: dict | None, turn: int):
    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        period = pdf["period"].iloc[0]
        m = int(period) if seasonal and not pd.isna(period) else 0
        free = _space(trend, damped, m > 0, fixed)
        points = _first_points(free) if turn == 0 else _around(np.array(pdf["best"].iloc[0], float), _FIRST_STEP / 2 ** (turn - 1))
        z = (pdf["y"].to_numpy(float) - float(pdf["m_"].iloc[0])) / float(pdf["s_"].iloc[0])
        gram, state = sweep(z, int(pdf["pos"].iloc[0]), _parameters(points, free, trend, damped, fixed), m, trend)
        return pd.DataFrame(
            {
                "series_id": key[0],
                "candidate": range(len(points)),
                "piece": key[1],
                "n": int(pdf["n"].iloc[0]),
                "period": pd.array([m or None] * len(points), dtype="Int32"),
                "fell_back": bool(pdf["fell_back"].iloc[0]),
                "points": list(points),
                "gram": [g.ravel() for g in gram],
                "state": [s.ravel() for s in state],
            }
        )

    return kernel


def _fold_forms(trend: bool, damped: bool, seasonal: bool, fixed: dict | None):
    """Compose the pieces of one candidate: substitute each piece's start state by the first one."""

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        period = pdf["period"].iloc[0]
        m = 0 if pd.isna(period) else int(period)
        p = 1 + int(trend) + m
        total, reach = np.zeros((p + 1, p + 1)), np.eye(p + 1)
        for gram, state in zip(pdf["gram"], pdf["state"]):
            total += reach.T @ np.array(gram).reshape(p + 1, p + 1) @ reach
            reach = np.vstack([np.array(state).reshape(p, p + 1) @ reach, reach[-1:]])
        x, sse = best_initial(total[None], m, trend)
        point = np.array(pdf["points"].iloc[0], float)
        return pd.DataFrame(
            [{"series_id": key[0], "best": point.tolist(), "sse": float(sse[0]), "end": (reach[:p] @ x[0]).tolist(),
              "n": int(pdf["n"].iloc[0]), "period": m or None, "fell_back": bool(pdf["fell_back"].iloc[0])}]
        )

    return kernel


def _finish_kernel(trend: bool, damped: bool, seasonal: bool, fixed: dict | None):
    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        m = 0 if pd.isna(r["period"]) else int(r["period"])
        free = _space(trend, damped, m > 0, fixed)
        params = _parameters(np.array(r["best"], float)[None], free, trend, damped, fixed)[0]
        row = dict.fromkeys(_FIT_COLUMNS)
        row.update(n=int(r["n"]), period=m or None, fell_back=bool(r["fell_back"]))
        row.update(_row(params, np.array(r["end"]), r["sse"], int(r["n"]), m, trend, free, r["s_"], r["m_"]))
        return pd.DataFrame([{"series_id": key[0], **row}])

    return kernel


def fit_pieces(rows: DataFrame, trend: bool, damped: bool, seasonal: bool, fixed: dict | None = None) -> DataFrame:
    """The same search for long series: each round is one pass over the pieces.

    A group of the first shuffle is one piece; a group of the second is one candidate of one
    series and holds one small matrix per piece.
    """
    scale = rows.groupBy("series_id").agg(
        F.avg("y").alias("m_"),
        F.when(F.stddev_pop("y") > 0, F.stddev_pop("y")).otherwise(F.lit(1.0)).alias("s_"),
        F.count_if(F.col("y").isNull()).alias("_missing"),
    )
    gaps = scale.where(F.col("_missing") > 0).select(
        "series_id",
        F.lit(GAPS).alias("error"),
    )
    # Every round reads the rows again, and each depends on the one before: both are cut off here.
    cut = checkpoint(pieces(rows).join(scale.where(F.col("_missing") == 0).drop("_missing"), "series_id"))
    result = "series_id string, best array<double>, sse double, end array<double>, n bigint, period int, fell_back boolean"
    best = None
    for turn in range(_ROUNDS + 1):
        source = cut if best is None else cut.join(best.select("series_id", "best"), "series_id")
        forms = source.groupBy("series_id", "piece").applyInPandas(
            _piece_kernel(trend, damped, seasonal, fixed, turn), _FORM
        )
        tried = forms.groupBy("series_id", "candidate").applyInPandas(_fold_forms(trend, damped, seasonal, fixed), result)
        # The zero move keeps the previous best among the candidates.
        best = checkpoint(
            tried.groupBy("series_id")
            .agg(F.min_by(F.struct("best", "sse", "end", "n", "period", "fell_back"), "sse").alias("_b"))
            .select("series_id", "_b.*")
        )
        if fixed and set(fixed) >= {"alpha", "beta", "gamma", "phi"}:
            break
    done = best.join(scale.drop("_missing"), "series_id").groupBy("series_id").applyInPandas(
        _finish_kernel(trend, damped, seasonal, fixed), f"series_id string, {FIT}"
    )
    return done.unionByName(gaps, allowMissingColumns=True)


class _Starts:
    """``_start_values`` of a series taken stretch by stretch; holds its first cycles and the open one."""

    def __init__(self, head: pd.Series, trend: str | None, seasonal: str | None) -> None:
        self.m, self.trend, self.seasonal = int(head["m"]), trend, seasonal
        self.first, self.open, self.season, self.cycles = np.zeros(0), np.zeros(0), np.zeros(self.m), 0

    def take(self, y: np.ndarray) -> None:
        m = self.m
        self.first = np.append(self.first, y[: max(0, max(2 * m, 10) - len(self.first))])
        if m:
            y = np.append(self.open, y)
            cycles = y[: len(y) // m * m].reshape(-1, m)
            means = cycles.mean(axis=1, keepdims=True)
            self.season += (cycles / means if self.seasonal == "mul" else cycles - means).sum(axis=0)
            self.cycles += len(cycles)
            self.open = y[cycles.size :]

    def row(self) -> dict:
        level, slope, _ = _start_values(self.first, self.m, self.trend, self.seasonal)
        return {"start": [level, slope, *(self.season / self.cycles if self.m else ())]}


class _Round:
    """One round of the search over a series taken stretch by stretch."""

    def __init__(self, head: pd.Series, turn: int, error: str, trend: str | None, seasonal: str | None, damped: bool, fixed: dict | None) -> None:
        self.head, self.m, self.trend = head, int(head["m"]), trend
        self.free = _space(trend is not None, damped, self.m > 0, fixed)
        self.points = _first_points(self.free) if turn == 0 else _around(np.array(head["best"], float), _FIRST_STEP / 2 ** (turn - 1))
        params = _parameters(self.points, self.free, trend is not None, damped, fixed)
        start = np.array(head["start"], float)
        self.fold = _Fold((start[0], start[1], start[2:]), params, self.m, error, trend, seasonal)

    def take(self, y: np.ndarray) -> None:
        self.fold.take(y)

    def row(self) -> dict:
        i, objective, squares, state = self.fold.best()
        row = dict.fromkeys(_FIT_COLUMNS)
        row.update(n=self.fold.n, period=self.m or None, fell_back=bool(self.head["fell_back"]), best=self.points[i].tolist())
        params = self.fold.params[i]
        row.update(_general_row(params, state, objective, squares, self.fold.n, self.m, self.trend is not None, self.free))
        return row


def _streamed(heads: DataFrame, rows: DataFrame, begin, made: str) -> DataFrame:
    """One row per series by an object that takes the values in order, Arrow batch by Arrow batch.

    A series' row in ``heads`` comes before its values, at position -1; ``begin`` makes the object from it.
    """

    def kernel(batches):
        def ended(key, now) -> pd.DataFrame:
            return pd.DataFrame([{"series_id": key, **now.row()}])

        key = now = None
        with np.errstate(all="ignore"):
            for pdf in batches:
                for sid, part in pdf.groupby("series_id", sort=False):
                    if sid != key:
                        if now is not None:
                            yield ended(key, now)
                        key, now, part = sid, begin(part.iloc[0]), part.iloc[1:]
                    now.take(part["y"].to_numpy(float))
            if now is not None:
                yield ended(key, now)

    both = rows.unionByName(heads.withColumn("pos", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = both.repartition(parts, "series_id").sortWithinPartitions("series_id", "pos")
    return sorted_.mapInPandas(kernel, f"series_id string, {made}")


def fit_streamed(
    rows: DataFrame, error: str, trend: str | None, seasonal: str | None, damped: bool, fixed: dict | None = None
) -> DataFrame:
    """The search of ``fit_general`` for series of any length: each round is one ordered pass over the values.

    A series stays in one task, since its recursion has no composable form, but that task holds one batch and the
    state of the candidates.
    """
    bad = F.col("y").isNull() | F.isnan("y")
    facts = checkpoint(
        rows.groupBy("series_id").agg(
            F.max("n").alias("n"),
            (F.coalesce(F.max("period"), F.lit(0)) if seasonal else F.lit(0)).alias("m"),
            F.bool_or("fell_back").alias("fell_back"),
            F.when(F.count_if(bad) > 0, GAPS)
            .when(F.count_if(F.col("y") <= 0) > 0, "ValueError: multiplicative components need strictly positive values.")
            .alias("error"),
        )
    )
    period = F.when(F.col("m") > 0, F.col("m")).alias("period")
    refused = facts.where("error IS NOT NULL").select("series_id", "n", period, "fell_back", "error")
    good = facts.where("error IS NULL").select("series_id", "m", "fell_back")
    # Every round reads the rows again, and each depends on the one before: both are cut off here.
    values = checkpoint(rows.select("series_id", "pos", "y").join(good.select("series_id"), "series_id", "left_semi"))
    starts = _streamed(good, values, lambda head: _Starts(head, trend, seasonal), "start array<double>")
    heads = checkpoint(good.join(starts, "series_id"))
    best = None
    for turn in range(_ROUNDS + 1):
        known = heads if best is None else heads.join(best.select("series_id", "best"), "series_id")

        def begin(head: pd.Series, turn: int = turn) -> _Round:
            return _Round(head, turn, error, trend, seasonal, damped, fixed)

        best = checkpoint(_streamed(known, values, begin, f"best array<double>, {FIT}"))
        if not _space(trend is not None, damped, seasonal is not None, fixed):
            break
    return best.drop("best").unionByName(refused, allowMissingColumns=True)


# -- prediction ------------------------------------------------------------------------


def _variance_growth(h: Column, m: Column) -> Column:
    """``sum(c_j ** 2, j = 1 .. h-1)`` of the additive model in closed form (Hyndman et al. 2008)."""
    a, b, g, phi = F.col("alpha"), F.col("beta"), F.col("gamma"), F.col("phi")
    j = (h - 1).cast("double")
    cycles = F.when(m > 0, F.floor(ratio(h - 1, m))).otherwise(F.lit(0)).cast("double")
    u = ratio(b * phi, 1 - phi)
    top = a + u
    power_j, power_m = F.pow(phi, j), F.pow(phi, m.cast("double"))
    damped = (
        top * top * j
        - 2 * top * u * ratio(phi * (1 - power_j), 1 - phi)
        + u * u * ratio(phi * phi * (1 - power_j * power_j), 1 - phi * phi)
        + cycles * (2 * g * top + g * g)
        - F.when(m > 0, 2 * g * u * ratio(power_m * (1 - F.pow(power_m, cycles)), 1 - power_m)).otherwise(F.lit(0.0))
    )
    linear = (
        a * a * j
        + a * b * j * (j + 1)
        + b * b * j * (j + 1) * (2 * j + 1) / 6
        + cycles * (2 * g * a + g * g)
        + g * b * m * cycles * (cycles + 1)
    )
    return F.when(phi < 1, damped).otherwise(linear)


def simulated_bounds(
    row: dict, horizon: int, kinds: tuple[str, str | None, str | None], paths: int = PATHS
) -> np.ndarray:
    """Quantiles of simulated paths, one row per step: the bounds ``lo95, lo80, hi80, hi95``.

    The errors are counter-based normals, keyed by the series and counted by step and path: a series has the same
    paths in every run, whatever else is forecast with it. Only the states of one step are held at a time.
    """
    error, trend, seasonal = kinds
    m = len(row["season"]) if row["season"] is not None else 0
    level, slope = np.full(paths, row["level"], float), np.full(paths, row["slope"] if row["slope"] is not None else 0.0, float)
    season = np.tile(np.array(row["season"], float), (paths, 1)) if m else None
    key = int.from_bytes(hashlib.blake2b(str(row["series_id"]).encode(), digest_size=16).digest(), "little")
    sigma, out = math.sqrt(row["sigma2"]), np.empty((horizon, len(BOUNDS)))
    with np.errstate(all="ignore"):
        for h in range(horizon):
            normal = np.random.Generator(np.random.Philox(key=key, counter=[0, 0, h, 0])).standard_normal(paths)
            at = (row["n"] + h) % m if m else 0
            s = season[:, at] if m else None
            damped, ahead, mean = _ahead(level, slope, s, row["phi"], trend, seasonal)
            raw = sigma * normal * (mean if error == "mul" else 1.0)
            out[h] = np.quantile(mean + raw, BOUNDS)
            level, slope, moved = _moved(raw, damped, ahead, s, row["alpha"], row["beta"], row["gamma"], trend, seasonal)
            if m:
                season[:, at] = moved
    return out


def path_bounds(fit: DataFrame, grid: DataFrame, kinds: tuple[str, str | None, str | None], paths: int = PATHS) -> DataFrame:
    """Simulated bounds for every step of every series: ``series_id, step_no, lo95, lo80, hi80, hi95``."""
    names = ["series_id", "n", "season", "level", "slope", "alpha", "beta", "gamma", "phi", "sigma2"]
    longest = grid.groupBy("series_id").agg(F.max("step_no").alias("horizon"))
    asked = fit.where(F.col("error").isNull()).select(*names).join(longest, "series_id")

    def simulate(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                found = simulated_bounds(row, int(row["horizon"]), kinds, paths)
                made = pd.DataFrame(found, columns=["lo95", "lo80", "hi80", "hi95"])
                yield made.assign(series_id=row["series_id"], step_no=np.arange(1, len(found) + 1))

    made = "series_id string, step_no int, lo95 double, lo80 double, hi80 double, hi95 double"
    return spread(asked, "series_id").mapInPandas(simulate, made)


def predict_ets(
    fit: DataFrame, grid: DataFrame, trend: str | None = "add", seasonal: str | None = "add", error: str = "add", paths: int = PATHS
) -> DataFrame:
    """Join each future step to its series' fit: point forecast and 80/95 % bounds.

    Additive models have a closed variance, so their bounds are a formula. With any multiplicative part there is none, and
    the bounds are quantiles of ``paths`` simulated paths per series.
    """
    h = F.col("step_no")
    m = F.coalesce("period", F.lit(0))
    steps = F.when(F.col("phi") < 1, ratio(F.col("phi") * (1 - F.pow("phi", h)), 1 - F.col("phi"))).otherwise(
        h.cast("double")
    )
    season = F.when(m > 0, F.try_element_at("season", (F.pmod(F.col("n") + h - 1, F.greatest(m, F.lit(1))) + 1).cast("int")))
    if trend == "mul":
        base = F.col("level") * F.pow(F.col("slope"), steps)
    else:
        base = F.col("level") + F.col("slope") * steps
    mean = base * F.coalesce(season, F.lit(1.0)) if seasonal == "mul" else base + F.coalesce(season, F.lit(0.0))
    out = grid.join(fit.where(F.col("error").isNull()), "series_id").withColumn("yhat", mean)
    kinds = (error, trend, seasonal)
    if "mul" in kinds:
        out = out.join(path_bounds(fit, grid, kinds, paths), ["series_id", "step_no"])
    else:
        width = F.sqrt(F.col("sigma2") * (1 + _variance_growth(h, m)))
        for level, z in (("80", Z80), ("95", Z95)):
            out = out.withColumn(f"lo{level}", F.col("yhat") - z * width).withColumn(f"hi{level}", F.col("yhat") + z * width)
    meta = F.create_map(
        F.lit("error"), F.lit(error),
        F.lit("trend"), F.lit(trend or "none"),
        F.lit("seasonal"), F.when(m > 0, F.lit(seasonal)).otherwise(F.lit("none")),
        F.lit("damped_trend"), (F.col("phi") < 1).cast("string"),
        F.lit("seasonal_periods"), F.coalesce(F.col("period").cast("string"), F.lit("none")),
        F.lit("seasonal_fallback"), F.col("fell_back").cast("string"),
        F.lit("aic"), exact_round(F.col("aic"), 3).cast("string"),
    )
    return out.select(
        "series_id",
        F.lit("ets").alias("model_name"),
        "step_no",
        "ts",
        "yhat",
        "lo80",
        "hi80",
        "lo95",
        "hi95",
        meta.alias("metadata"),
        F.lit(None).cast("string").alias("error"),
    )


def failures(ids: DataFrame, model: str) -> DataFrame:
    """Forecast rows that only carry an error, one per ``(series_id, error)``."""
    empty = [F.lit(None).cast("double").alias(c) for c in ("yhat", "lo80", "hi80", "lo95", "hi95")]
    return ids.select(
        "series_id",
        F.lit(model).alias("model_name"),
        F.lit(None).cast("int").alias("step_no"),
        F.lit(None).cast("timestamp").alias("ts"),
        *empty,
        F.lit(None).cast("map<string,string>").alias("metadata"),
        "error",
    )


def irregular_series(steps: DataFrame) -> DataFrame:
    message = "ValueError: the series has no regular step, so future times are undefined."
    return steps.where(~F.col("regular")).select("series_id", F.lit(message).alias("error"))


def ets(
    panel: DataFrame,
    horizon: int | DataFrame,
    seasonal_periods: int | None = None,
    error: str = "add",
    trend: str | None = "add",
    seasonal: str | None = "add",
    damped: bool = True,
    fixed: dict | None = None,
) -> DataFrame:
    """Fit and forecast every series; series that fail have one row with ``error``."""
    panel = checkpoint(panel)  # read by the step, the fit and the grid
    steps = checkpoint(steps_of(panel))
    usable = panel.join(steps.where("regular").select("series_id"), "series_id", "left_semi")
    # One small row per series, expensive to make and read twice below.
    fit = checkpoint(fit_ets(usable, seasonal_periods, error, trend, seasonal, damped, fixed, steps))
    grid = future_grid(panel, horizon, steps)
    bad = fit.where(F.col("error").isNotNull()).select("series_id", "error").unionByName(irregular_series(steps))
    return predict_ets(fit, grid, trend, seasonal, error).unionByName(failures(bad, "ets"))
