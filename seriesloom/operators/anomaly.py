"""Anomalies: z-score, isolation forest, and the normality test that picks between them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.numeric import exact_round
from seriesloom.functions.order import exact_quantile, pieces, spread
from seriesloom.sources.panel import drop_missing, is_bounded, with_pos

# Flag threshold in standard deviations, expected share of anomalies,
# rows drawn for the normality test, and its significance level.
Z_THRESHOLD = 3.0
CONTAMINATION = 0.05
NORMALITY_ROWS = 500
NORMALITY_ALPHA = 0.05

# Isolation forest sizes as published (Liu, Ting & Zhou 2008).
TREES = 100
TREE_ROWS = 256


def positioned(panel: DataFrame) -> DataFrame:
    return panel if "pos" in panel.columns else with_pos(panel)


def zscores(panel: DataFrame) -> DataFrame:
    """Every non-missing row with its z-score; no rows for a constant series.

    Mean and deviation are a window beside the positions where series fit in a task; else
    an aggregate with map-side partial sums, joined back as one row per series.
    """
    rows = drop_missing(positioned(panel))
    if is_bounded(panel):
        w = Window.partitionBy("series_id")
        scored = rows.withColumn("_mean", F.avg("y").over(w)).withColumn("_std", F.stddev_samp("y").over(w))
    else:
        stats = panel.groupBy("series_id").agg(F.avg("y").alias("_mean"), F.stddev_samp("y").alias("_std"))
        scored = rows.join(stats, "series_id")
    return scored.where(F.col("_std") > 0).select(
        "series_id", "pos", F.col("y").alias("value"), ((F.col("y") - F.col("_mean")) / F.col("_std")).alias("z")
    )


def zscore_anomalies(panel: DataFrame, threshold: float = Z_THRESHOLD) -> DataFrame:
    """Rows more than ``threshold`` sample standard deviations from the mean."""
    return (
        zscores(panel)
        .where(F.abs("z") > threshold)
        .select("series_id", "pos", "value", exact_round(F.col("z"), 4).alias("score"))
    )


# -- isolation forest --------------------------------------------------------------


def _average_depth(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(sample: np.ndarray, rng: np.random.Generator) -> tuple[list[float], list[float]]:
    """One random tree over sorted values: its cut points, and the depth in between."""
    limit = math.ceil(math.log2(max(len(sample), 2)))
    cuts: list[float] = []
    depths: list[float] = []
    todo: list[tuple] = [(0, len(sample), 0)]
    while todo:
        node = todo.pop()
        if len(node) == 1:
            cuts.append(node[0])
            continue
        lo, hi, depth = node
        if depth == limit or hi - lo <= 1 or sample[lo] == sample[hi - 1]:
            depths.append(depth + _average_depth(hi - lo))
            continue
        cut = rng.uniform(sample[lo], sample[hi - 1])
        mid = lo + int(np.searchsorted(sample[lo:hi], cut, side="right"))
        todo += [(mid, hi, depth + 1), (cut,), (lo, mid, depth + 1)]  # left side pops first
    return cuts, depths


def forest_of(sid: str, values: np.ndarray, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The forest over (a pool of) one series' values as a step function: cut points and scores."""
    values = np.sort(values)
    rng = np.random.default_rng([seed, *str(sid).encode()])
    size = min(TREE_ROWS, len(values))
    cuts, jumps, base = [], [], 0.0
    for _ in range(trees):
        tree_cuts, depths = _grow(np.sort(rng.choice(values, size, replace=False)), rng)
        cuts.append(tree_cuts)
        jumps.append(np.diff(depths))
        base += depths[0]
    at = np.concatenate(cuts)
    order = np.argsort(at, kind="stable")
    path = np.concatenate([[base], base + np.cumsum(np.concatenate(jumps)[order])]) / trees
    return at[order], -np.exp2(-path / max(_average_depth(size), 1e-12))


def _steps_kernel(trees: int, seed: int):
    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at, score = forest_of(key[0], pdf["y"].to_numpy(float), trees, seed)
        return pd.DataFrame({"series_id": key[0], "lo": np.concatenate([[-np.inf], at]), "score": score})

    return build


def forest_steps(panel: DataFrame, trees: int = TREES, seed: int = 0) -> DataFrame:
    """The forest of each series as one step function of the value: ``(series_id, lo, score)``.

    A one-dimensional tree is a step function, and so is the mean of many. The trees only
    ever use ``trees * 256`` random rows, so a series longer than that is thinned by a
    hash of the position before the shuffle and the grouped kernel stays bounded.
    """
    rows = drop_missing(positioned(panel))
    pool = trees * TREE_ROWS * 1.1
    size = panel.groupBy("series_id").agg(F.count("y").alias("_n"))
    draw = F.pmod(F.xxhash64("series_id", "pos", F.lit(seed)), F.lit(2**31)) / F.lit(float(2**31))
    sampled = rows.join(size, "series_id").where(draw < F.lit(pool) / F.col("_n")).select("series_id", "y")
    return sampled.groupBy("series_id").applyInPandas(
        _steps_kernel(trees, seed), "series_id string, lo double, score double"
    )


def _lookup(key: tuple, rows: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
    order = np.argsort(steps["lo"].to_numpy())
    lo, score = steps["lo"].to_numpy()[order], steps["step"].to_numpy()[order]
    at = np.maximum(np.searchsorted(lo, rows["y"].to_numpy(), side="left") - 1, 0)
    value = score[at] if len(score) else np.full(len(rows), np.nan)
    return pd.DataFrame(
        {"series_id": rows["series_id"], "pos": rows["pos"], "value": rows["y"], "score": value}
    )


def forest_scores(panel: DataFrame, trees: int = TREES, seed: int = 0) -> DataFrame:
    """Score every row.

    Every forest is built by :func:`forest_steps`, whatever the panel's form, so a series scores the same
    beside any neighbour. The steps are handed to the series, or to each piece of it, and looked up there.
    """
    return look_up(drop_missing(positioned(panel)), forest_steps(panel, trees, seed), is_bounded(panel))


def look_up(rows: DataFrame, steps: DataFrame, bounded: bool) -> DataFrame:
    """The score of the last step ``(series_id, lo, score)`` below each row's value, or of the first step."""
    schema = "series_id string, pos bigint, value double, score double"
    steps = steps.select(F.col("series_id").alias("step_id"), "lo", F.col("score").alias("step"))
    if bounded:
        mine = spread(rows.select("series_id", "pos", "y"), "series_id").groupBy("series_id")
        return mine.cogroup(steps.groupBy("step_id")).applyInPandas(_lookup, schema)
    cut = pieces(rows).select("series_id", "piece", "pos", "y")
    used = cut.select("series_id", F.col("piece").alias("step_piece")).distinct()
    handed = steps.join(used, F.col("step_id") == F.col("series_id")).drop("series_id")
    return cut.groupBy("series_id", "piece").cogroup(handed.groupBy("step_id", "step_piece")).applyInPandas(
        _lookup, schema
    )


def flag_lowest(scores: DataFrame, contamination: float = CONTAMINATION, bounded: bool = False) -> DataFrame:
    """Rows scoring strictly below the series' ``contamination`` quantile, relative to it."""
    if bounded:
        w = Window.partitionBy("series_id")
        ranked = scores.withColumn("_offset", F.percentile("score", F.lit(contamination)).over(w))
    else:
        ranked = scores.join(exact_quantile(scores, ["series_id"], "score", contamination, "_offset"), "series_id")
    return ranked.where(F.col("score") < F.col("_offset")).select(
        "series_id", "pos", "value", exact_round(F.col("score") - F.col("_offset"), 4).alias("score")
    )


def isolation_forest_anomalies(
    panel: DataFrame, contamination: float = CONTAMINATION, trees: int = TREES, seed: int = 0
) -> DataFrame:
    return flag_lowest(forest_scores(panel, trees, seed), contamination, is_bounded(panel))


# -- normality ---------------------------------------------------------------------

# Polynomials of Royston (1995), algorithm AS R94, highest power first.
_A_LAST = [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0]
_A_NEXT = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]
_MU_SMALL = [-0.0006714, 0.025054, -0.39978, 0.5440]
_SD_SMALL = [-0.0020322, 0.062767, -0.77857, 1.3822]
_MU_LARGE = [0.0038915, -0.083751, -0.31082, -1.5861]
_SD_LARGE = [0.0030302, -0.082676, -0.4803]


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and its p-value for a small sample (3 to a few thousand values)."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        normal = NormalDist()
        m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        total, u = float(m @ m), 1.0 / math.sqrt(n)
        last = np.polyval(_A_LAST, u) + m[-1] / math.sqrt(total)
        a = m.copy()
        if n > 5:
            nxt = np.polyval(_A_NEXT, u) + m[-2] / math.sqrt(total)
            rest = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * nxt**2)
            a /= math.sqrt(rest)
            a[1], a[-2] = -nxt, nxt
        else:
            a /= math.sqrt((total - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[0], a[-1] = -last, last
    centred = x - x.mean()
    w = min(float(a @ x) ** 2 / float(centred @ centred), 1.0)
    if n == 3:
        return w, max(6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))), 0.0)
    tail = math.log(max(1.0 - w, 1e-300))
    if n <= 11:
        gamma = 0.459 * n - 2.273
        if tail >= gamma:
            return w, 0.0
        z = (-math.log(gamma - tail) - np.polyval(_MU_SMALL, n)) / math.exp(np.polyval(_SD_SMALL, n))
    else:
        z = (tail - np.polyval(_MU_LARGE, math.log(n))) / math.exp(np.polyval(_SD_LARGE, math.log(n)))
    return w, 0.5 * math.erfc(z / math.sqrt(2.0))


def _shapiro_kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    w, p = shapiro_wilk(pdf["y"].to_numpy())
    return pd.DataFrame({"series_id": [key[0]], "rows_tested": [len(pdf)], "w": [w], "p": [p]})


def normality(panel: DataFrame, max_rows: int = NORMALITY_ROWS, seed: int = 0) -> DataFrame:
    """Shapiro-Wilk on at most ``max_rows`` rows per series, and the method it selects.

    The draw is by a hash of the position. Long series are thinned on that hash first, so
    the ranking that takes exactly ``max_rows`` orders a few times that many.
    """
    rows = drop_missing(positioned(panel))
    if is_bounded(panel):
        sized = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("series_id")))
    else:
        sized = rows.join(panel.groupBy("series_id").agg(F.count("y").alias("_n")), "series_id")
    thin = F.lit(float(2**31)) * (4.0 * max_rows) / F.col("_n")
    drawn = (
        sized.withColumn("_h", F.pmod(F.xxhash64("series_id", "pos", F.lit(seed)), F.lit(2**31)))
        .where(F.col("_h") < thin)
        .withColumn("_k", F.row_number().over(Window.partitionBy("series_id").orderBy("_h", "pos")))
        .where(F.col("_k") <= max_rows)
    )
    tested = drawn.select("series_id", "y").groupBy("series_id").applyInPandas(
        _shapiro_kernel, "series_id string, rows_tested bigint, w double, p double"
    )
    gaussian = F.col("p").isNull() | (F.col("rows_tested") < 3) | (F.col("p") > NORMALITY_ALPHA)
    return (
        panel.select("series_id").distinct().join(tested, "series_id", "left")
        .select(
            "series_id",
            F.coalesce("rows_tested", F.lit(0)).alias("rows_tested"),
            "w",
            "p",
            F.when(gaussian, F.lit("zscore")).otherwise(F.lit("isolation_forest")).alias("method"),
        )
    )


# -- choice and roll-up ------------------------------------------------------------


def anomaly_methods(panel: DataFrame, method: str = "auto", normality_rows: int = NORMALITY_ROWS) -> DataFrame:
    """``(series_id, method, rows_tested)``; any name but ``auto`` and ``zscore`` means isolation forest.

    ``auto`` rests on a normality test of at most ``normality_rows`` rows per series, drawn by hash;
    ``rows_tested`` says how many it had (NULL without a test).
    """
    if method == "auto":
        return normality(panel, normality_rows).select("series_id", "method", "rows_tested")
    fixed = "zscore" if method == "zscore" else "isolation_forest"
    return (
        panel.select("series_id").distinct()
        .withColumn("method", F.lit(fixed)).withColumn("rows_tested", F.lit(None).cast("bigint"))
    )


def detect_anomalies(
    panel: DataFrame, method: str = "auto", methods: DataFrame | None = None, normality_rows: int = NORMALITY_ROWS
) -> DataFrame:
    """Flagged rows of every series, ``(series_id, pos, value, score, method)``."""
    rows = positioned(panel)
    if methods is None:
        if method != "auto":
            found = zscore_anomalies(rows) if method == "zscore" else isolation_forest_anomalies(rows)
            return found.withColumn("method", F.lit("zscore" if method == "zscore" else "isolation_forest"))
        methods = anomaly_methods(rows, normality_rows=normality_rows)
    parts: Iterator[DataFrame] = (
        find(rows.join(methods.where(F.col("method") == name).select("series_id"), "series_id")).withColumn(
            "method", F.lit(name)
        )
        for name, find in (("zscore", zscore_anomalies), ("isolation_forest", isolation_forest_anomalies))
    )
    gaussian, other = parts
    return gaussian.unionByName(other)


def rollup_anomalies(found: DataFrame) -> DataFrame:
    """Count, indices and details in index order, one row per series.

    The arrays are as long as the series has anomalies. For totals only there is :func:`anomaly_counts`; for details
    of any number, ``found`` itself is the long table, one row per anomaly.
    """
    detail = F.struct("pos", "value", "score")
    return (
        found.groupBy("series_id")
        .agg(F.count(F.lit(1)).alias("anomaly_count"), F.sort_array(F.collect_list(detail)).alias("details"))
        .withColumn("anomaly_indices", F.col("details.pos"))
    )


def anomaly_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("series_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
