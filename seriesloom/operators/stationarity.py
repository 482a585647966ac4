"""Stationarity: differences, ADF and KPSS tests, and the differencing they recommend."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.numeric import exact_round
from seriesloom.functions.order import PIECE_ROWS, pieces, spread
from seriesloom.operators.seasonality import lagged_sums
from seriesloom.sources.panel import compact, is_bounded

# Shortest series tested and the significance level.
MIN_OBS = 20
ALPHA = 0.05

# MacKinnon (1994) p-value polynomials for a constant term, lowest power
# first, and the statistic's limits; KPSS (1992) critical values for a level.
_ADF_SMALL = [2.1659, 1.4412, 0.038269]
_ADF_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]
_ADF_MAX, _ADF_MIN, _ADF_STAR = 2.74, -18.83, -1.61
KPSS_TABLE = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]


def differences(panel: DataFrame, orders: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """``(series_id, d, ts, pos, y)`` for each order of differencing, over non-missing rows.

    Neighbours come from one window per series, or per piece with two rows of halo in a
    panel with blocks.
    """
    rows = compact(panel).select("series_id", "ts", "pos", "y")
    if is_bounded(panel):
        cut, group = rows.withColumn("core", F.lit(True)), ["series_id"]
    else:
        cut, group = pieces(rows, 2), ["series_id", "piece"]
    w = Window.partitionBy(*group).orderBy("pos")
    one, two = F.lag("y", 1).over(w), F.lag("y", 2).over(w)
    formula = {
        0: F.col("y"),
        1: F.col("y") - F.col("_1"),
        2: (F.col("y") - F.col("_1")) - (F.col("_1") - F.col("_2")),
    }
    return (
        cut.withColumn("_1", one)
        .withColumn("_2", two)
        .where("core")
        .select(
            "series_id",
            "ts",
            F.col("pos").alias("_pos"),
            F.inline(F.array(*[F.struct(F.lit(d).alias("d"), formula[d].alias("y")) for d in orders])),
        )
        .where((F.col("_pos") >= F.col("d")) & F.col("y").isNotNull())
        .select("series_id", "d", "ts", (F.col("_pos") - F.col("d")).alias("pos"), "y")
    )


def gram(df: DataFrame, by: Sequence[str], x_cols: Sequence[str], y_col: str) -> DataFrame:
    """``(…by, i, j, v)``: sums of products of the design columns, and with ``y`` as the last one.

    One wide aggregate with map-side partial sums; rows are never paired or collected.
    """
    cols = [*x_cols, y_col]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    wide = df.groupBy(*by).agg(
        *[F.sum(F.col(cols[i]).cast("double") * F.col(cols[j]).cast("double")).alias(f"p{i}_{j}") for i, j in pairs]
    )
    cells = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p{i}_{j}").alias("v")) for i, j in pairs
    ]
    return wide.select(*by, F.inline(F.array(*cells)))


# -- ADF ---------------------------------------------------------------------------


def adf_max_lag(n: Column) -> Column:
    """Largest lag tried: min(ceil(12 (n/100)^(1/4)), n div 2 - 2)."""
    return F.greatest(
        F.least(F.ceil(12 * F.pow(n.cast("double") / 100, F.lit(0.25))), F.floor(n / 2) - 2), F.lit(0)
    ).cast("int")


def _design(x: np.ndarray, first: int, lags: int) -> np.ndarray:
    """Rows t = first.. of [1, x[t-1], dx[t-1] … dx[t-lags], dx[t]] for one run of values."""
    dx = np.diff(x)
    t = np.arange(first, len(x))
    columns = [np.ones(len(t)), x[t - 1], *[dx[t - 1 - j] for j in range(1, lags + 1)], dx[t - 1]]
    return np.column_stack(columns)


def _design_gram(x: np.ndarray, first: int, lags: int) -> np.ndarray:
    """Gram matrix of the design, built a bounded number of rows at a time."""
    g = np.zeros((lags + 3, lags + 3))
    for lo in range(first, len(x), PIECE_ROWS):
        rows = _design(x[max(lo - lags - 1, 0) : lo + PIECE_ROWS], min(lo, lags + 1), lags)
        g += rows.T @ rows
    return g


def _adf_partial(keys: list[str]):
    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        lags = int(pdf["_lags"].iloc[0])
        x = pdf["_z"].to_numpy(float)
        pos = pdf["pos"].to_numpy(np.int64)
        head = int((~pdf["core"].to_numpy(bool)).sum())
        first = max(head, lags + 1)
        g = _design_gram(x, first, lags)
        i, j = np.triu_indices(lags + 3)
        cells = pd.DataFrame({"i": i, "j": j, "v": g[i, j]})
        start = (pos <= lags + 1) & pdf["core"].to_numpy(bool)  # the series' first values, for the refit
        edge = pd.DataFrame({"i": -1, "j": pos[start], "v": x[start]})
        out = pd.concat([cells, edge], ignore_index=True)
        return out.assign(**dict(zip(keys, key)))[[*keys, "i", "j", "v"]]

    return kernel


def _fit(g: np.ndarray, k: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Least squares on the first ``k`` columns of a Gram matrix: coefficients, SSR, inverse."""
    inverse = np.linalg.pinv(g[:k, :k], hermitian=True)
    beta = inverse @ g[:k, -1]
    return beta, max(float(g[-1, -1] - beta @ g[:k, -1]), 0.0), inverse


def adf_pvalue(tau: float) -> float:
    if tau > _ADF_MAX:
        return 1.0
    if tau < _ADF_MIN:
        return 0.0
    powers = _ADF_SMALL if tau <= _ADF_STAR else _ADF_LARGE
    return 0.5 * math.erfc(-sum(c * tau**i for i, c in enumerate(powers)) / math.sqrt(2.0))


def adf_from_sums(g: np.ndarray, edge: np.ndarray, n: int) -> tuple[float, int]:
    """Statistic and AIC lag from the Gram matrix of all lags and the series' first values."""
    size = len(g)
    lags = size - 3
    common = n - 1 - lags
    best, best_aic = 0, math.inf
    for lag in range(lags + 1):
        _, ssr, _ = _fit(g, lag + 2)
        aic = common * math.log(max(ssr, 1e-300) / common) + 2 * (lag + 2)
        if aic < best_aic:
            best, best_aic = lag, aic
    # Refit on the longer sample: the same sums plus the rows only this lag can use.
    keep = [*range(best + 2), size - 1]
    extra = _design(edge[: lags + 1], best + 1, best)
    full = g[np.ix_(keep, keep)] + extra.T @ extra
    beta, ssr, inverse = _fit(full, best + 2)
    spread = math.sqrt(max(ssr / max(n - 2 * best - 3, 1) * inverse[1, 1], 0.0))
    if spread == 0:
        return (-math.inf if beta[1] < 0 else math.inf), best
    return float(beta[1]) / spread, best


def _adf_solve(keys: list[str]):
    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cells = pdf[pdf["i"] >= 0]
        size = int(cells["j"].max()) + 1
        g = np.zeros((size, size))
        g[cells["i"], cells["j"]] = cells["v"]
        g[cells["j"], cells["i"]] = cells["v"]
        edge = pdf[pdf["i"] < 0].sort_values("j")["v"].to_numpy()
        tau, lag = adf_from_sums(g, edge, int(pdf["n"].iloc[0]))
        out = pd.DataFrame({"stat": [tau], "lag": [lag], "p": [adf_pvalue(tau)]})
        return out.assign(**dict(zip(keys, key)))[[*keys, "stat", "lag", "p"]]

    return kernel


def _key_schema(df: DataFrame, by: Sequence[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)


def adf(panel: DataFrame, by: Sequence[str] = ("series_id",), max_lag: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, lag chosen by AIC up to ``max_lag``.

    Each piece adds its rows to a small matrix of sums; the matrices are added per series
    and solved once for all lags. Only sums, never rows, meet in one place. Needs ``pos``
    without gaps; constant groups and those under four rows are left out.
    """
    by = list(by)
    stats = panel.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("_m"), F.stddev_pop("y").alias("_s")
    )
    rows = (
        panel.join(stats.where((F.col("_s") > 0) & (F.col("n") >= 6)), by)
        .withColumn("_z", (F.col("y") - F.col("_m")) / F.col("_s"))
        .withColumn("_lags", adf_max_lag(F.col("n")) if max_lag is None else F.lit(max_lag))
    )
    cut = pieces(rows.select(*by, "pos", "_z", "_lags"), F.col("_lags") + 1)
    keys = _key_schema(panel, by)
    sums = (
        cut.groupBy(*by, "piece")
        .applyInPandas(lambda key, pdf: _adf_partial(by)(key[:-1], pdf), f"{keys}, i int, j int, v double")
        .groupBy(*by, "i", "j")
        .agg(F.sum("v").alias("v"))
    )
    return (
        sums.join(stats.select(*by, "n"), by)
        .groupBy(*by)
        .applyInPandas(_adf_solve(by), f"{keys}, stat double, lag int, p double")
    )


# -- KPSS --------------------------------------------------------------------------


def _cumulated(keys: list[str]):
    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        e, core = pdf["e"].to_numpy(float), pdf["core"].to_numpy(bool)
        width, last = int(pdf["lags"].iloc[0]) + 1, int(pdf["n"].iloc[0]) - 1
        own = np.cumsum(e[core])
        total = np.concatenate([[0.0], np.cumsum(e)])
        at = np.flatnonzero(core) + 1
        moving = total[at] - total[np.maximum(at - width, 0)]
        spill = 0.0
        if pdf["pos"].iloc[-1] == last:  # windows that run past the end of the series
            tail = total[-1] - total[np.maximum(len(e) - width, 0) + 1 : len(e)]
            spill = float(tail @ tail)
        row = {"m": len(own), "s1": own.sum(), "s2": own @ own, "total": own[-1], "mv": moving @ moving + spill}
        return pd.DataFrame([{**dict(zip(keys, key)), "piece": key[-1], **row}])

    return kernel


def kpss_pvalue(stat: Column) -> Column:
    """Linear interpolation in the published table, clipped at its ends."""
    out = F.lit(KPSS_TABLE[-1][1])
    for (x0, p0), (x1, p1) in reversed(list(zip(KPSS_TABLE, KPSS_TABLE[1:]))):
        out = F.when(stat < x1, p0 + (stat - x0) * ((p1 - p0) / (x1 - x0))).otherwise(out)
    return F.when(stat <= KPSS_TABLE[0][0], F.lit(KPSS_TABLE[0][1])).otherwise(out)


def kpss(panel: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """KPSS test around a level, with the automatic bandwidth of Hobijn et al. (1998).

    The bandwidth needs a few lagged sums. The Bartlett-weighted variance for any bandwidth
    L equals the energy of the series' moving sums of width L+1, so the second pass is
    linear in n however large L comes out. Partial cumulated sums per piece are joined up
    from one row per piece.
    """
    by = list(by)
    stats = panel.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("_m"), F.stddev_pop("y").alias("_s")
    )
    rows = panel.join(stats.where(F.col("_s") > 0), by).select(
        *by,
        "pos",
        "n",
        ((F.col("y") - F.col("_m")) / F.col("_s")).alias("e"),
        F.floor(F.pow(F.col("n").cast("double"), F.lit(2.0 / 9.0))).cast("int").alias("_c"),
    )
    n = F.col("n").cast("double")
    sums = lagged_sums(rows, by, "e", "_c").join(stats.select(*by, "n"), by)
    q = F.when(F.col("lag") == 0, F.col("s") / n).otherwise(2 * F.col("s") / n)
    ratio_ = F.pow(F.pow(F.try_divide(F.col("_s1"), F.col("_s0")), F.lit(2.0)), F.lit(1.0 / 3.0))
    bandwidth = sums.groupBy(*by).agg(
        F.first("n").alias("n"), F.sum(q).alias("_s0"), F.sum(F.col("lag") * q).alias("_s1")
    ).select(
        *by,
        F.least(
            F.floor(1.1447 * F.coalesce(ratio_, F.lit(0.0)) * F.pow(n, F.lit(1.0 / 3.0))), F.col("n") - 1
        ).cast("int").alias("lags"),
    )
    cut = pieces(rows.drop("_c").join(bandwidth, by), F.col("lags"))
    # Windows reach one piece further than the data; those rows have no core row.
    cut = cut.where(F.col("piece") <= F.floor((F.col("n") - 1) / PIECE_ROWS))
    keys = _key_schema(panel, by)
    parts = cut.groupBy(*by, "piece").applyInPandas(
        _cumulated(by), f"{keys}, piece bigint, m bigint, s1 double, s2 double, total double, mv double"
    )
    earlier = Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("total").over(earlier), F.lit(0.0))
    joined = parts.withColumn("_o", offset)
    energy = F.col("s2") + 2 * F.col("_o") * F.col("s1") + F.col("m") * F.col("_o") * F.col("_o")
    final = joined.groupBy(*by).agg(
        F.sum("m").alias("n"), F.sum(energy).alias("_eta"), F.sum("mv").alias("_mv")
    ).join(bandwidth, by)
    variance = F.col("_mv") / (F.col("lags") + 1) / n
    stat = F.try_divide(F.col("_eta") / (n * n), variance)
    return final.select(*by, stat.alias("stat"), "lags").withColumn("p", kpss_pvalue(F.col("stat")))


# -- one series in one task ------------------------------------------------------------


def kpss_whole(e: np.ndarray) -> tuple[float, int]:
    """Statistic and bandwidth from the centred values of one series."""
    n = len(e)
    c = int(math.floor(n ** (2.0 / 9.0)))
    sums = np.array([e[lag:] @ e[: n - lag] for lag in range(c + 1)])
    q = np.where(np.arange(c + 1) == 0, 1.0, 2.0) * sums / n
    s0, s1 = float(q.sum()), float((np.arange(c + 1) * q).sum())
    ratio_ = ((s1 / s0) ** 2) ** (1.0 / 3.0) if s0 else 0.0
    lags = int(min(math.floor(1.1447 * ratio_ * n ** (1.0 / 3.0)), n - 1))
    total = np.concatenate([[0.0], np.cumsum(e), np.full(lags, e.sum())])
    moving = total[1:] - np.concatenate([np.zeros(lags + 1), total])[1 : len(total)]
    variance = float(moving @ moving) / (lags + 1) / n
    eta = float(total[1 : n + 1] @ total[1 : n + 1]) / (float(n) * n)
    return (eta / variance if variance else math.nan), lags


def _whole_kernel(keys: list[str]):
    table_x, table_p = zip(*KPSS_TABLE)

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("pos")["y"].to_numpy(float)
        n = len(y)
        sd = float(y.std(ddof=1)) if n > 1 and (y != y[0]).any() else 0.0
        adf_p = kpss_p = None
        if n >= MIN_OBS and sd > 0:
            z = (y - y.mean()) / y.std()
            lags = max(min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2), 0)
            tau, _ = adf_from_sums(_design_gram(z, lags + 1, lags), z[: lags + 2], n)
            stat, _ = kpss_whole(z)
            adf_p, kpss_p = adf_pvalue(tau), float(np.interp(stat, table_x, table_p))
        row = {**dict(zip(keys, key)), "n": n, "sd": sd, "adf_p": adf_p, "kpss_p": kpss_p}
        return pd.DataFrame([row]).astype({"adf_p": float, "kpss_p": float})

    return kernel


def stationarity_tests(diffs: DataFrame, by: Sequence[str], bounded: bool) -> DataFrame:
    """``(…by, n, sd, adf_p, kpss_p)``: one kernel per group if it fits in a task, else by pieces."""
    by = list(by)
    if bounded:
        tests = spread(diffs.select(*by, "pos", "y"), *by).groupBy(*by).applyInPandas(
            _whole_kernel(by), f"{_key_schema(diffs, by)}, n bigint, sd double, adf_p double, kpss_p double"
        )
        clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("adf_p", "kpss_p")]
        return tests.select(*by, "n", "sd", *clean)
    size = diffs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("y").alias("sd"))
    tested = diffs.join(size.where((F.col("n") >= MIN_OBS) & (F.col("sd") > 0)).select(*by), by)
    return size.join(adf(tested, by).select(*by, F.col("p").alias("adf_p")), by, "left").join(
        kpss(tested, by).select(*by, F.col("p").alias("kpss_p")), by, "left"
    )


# -- verdict -----------------------------------------------------------------------


def check_stationarity(panel: DataFrame) -> DataFrame:
    """Both tests on the series and its two differences in one job, and the verdict per series."""
    every = panel.groupBy("series_id").agg(F.count("y").alias("rows"))
    return verdict(stationarity_tests(differences(panel), ["series_id", "d"], is_bounded(panel)), every)


def verdict(tests: DataFrame, every: DataFrame) -> DataFrame:
    """Whether each series is stationary, and how often to difference it, from the tests of its differences.

    tests: ``(series_id, d, n, sd, adf_p, kpss_p)``; every: ``(series_id, rows)``, also of series without a test.
    """
    # A constant difference has nothing left to remove, so it passes.
    constant = (F.col("n") >= MIN_OBS) & (F.col("sd") == 0)
    passes = F.coalesce(constant | ((F.col("adf_p") < ALPHA) & (F.col("kpss_p") > ALPHA)), F.lit(False))
    level = F.col("d") == 0
    per_series = tests.groupBy("series_id").agg(
        F.max(F.when(level, F.col("n"))).alias("n"),
        F.max(F.when(level, F.col("sd"))).alias("sd"),
        F.max(F.when(level, F.col("adf_p"))).alias("adf_p"),
        F.max(F.when(level, F.col("kpss_p"))).alias("kpss_p"),
        F.min(F.when(passes, F.col("d"))).alias("first_d"),
    )
    short = F.col("rows") < MIN_OBS
    flat = ~short & (F.coalesce(F.col("sd"), F.lit(0.0)) == 0)
    p = lambda name, constant_p: F.when(short, F.lit(None).cast("double")).when(flat, F.lit(constant_p)).otherwise(
        exact_round(F.col(name), 6)
    )
    stationary = ~short & (flat | (F.col("first_d") == 0))
    return every.join(per_series, "series_id", "left").select(
        "series_id",
        F.coalesce(stationary, F.lit(False)).alias("is_stationary"),
        p("adf_p", 0.0).alias("adf_pvalue"),
        p("kpss_p", 1.0).alias("kpss_pvalue"),
        F.when(short | flat, F.lit(0)).otherwise(F.coalesce("first_d", F.lit(2))).cast("int").alias(
            "recommended_differencing"
        ),
        # The two notes.
        F.when(short, F.concat(F.lit("series too short ("), F.col("rows").cast("string"),
                               F.lit(f" obs, need ≥ {MIN_OBS})")))
        .when(flat, F.lit("constant series"))
        .alias("note"),
    )
