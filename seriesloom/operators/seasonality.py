"""Seasonality: de-spike, detrend, autocorrelation and power spectrum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.numeric import exact_round, ratio
from seriesloom.functions.order import pieces
from seriesloom.functions.spectrum import long_spectrum
from seriesloom.sources.panel import SERIES_ROWS, compact, is_bounded, with_pos

# Observations per natural cycle, the significance band of the
# autocorrelation in units of 1/sqrt(n), and the shortest series looked at.
CYCLE = {
    "minute": 60,
    "hourly": 24,
    "daily": 7,
    "weekly": 52,
    "monthly": 12,
    "quarterly": 4,
    "yearly": 1,
}
DEFAULT_CYCLE = 7
BAND = 2.0
MIN_OBS = 16

# Longest series whose spectrum is one FFT in one task; longer ones are split.
FFT_ROWS = SERIES_ROWS


def expected_period(frequency: Column) -> Column:
    """Cycle length of a named frequency, the daily one where it is irregular or unknown."""
    out = F.lit(DEFAULT_CYCLE)
    for name, period in CYCLE.items():
        out = F.when(frequency == name, F.lit(period)).otherwise(out)
    return out


def interpolate(panel: DataFrame) -> DataFrame:
    """Fill missing values linearly by position; the ends take the nearest value.

    In a panel with blocks the neighbours are found inside a piece by window, and beyond it
    from one boundary row per piece, so long gaps and long series both work.
    """
    known = F.when(F.col("y").isNotNull(), F.struct(F.col("pos").alias("p"), F.col("y").alias("v")))
    cut = panel if is_bounded(panel) else pieces(panel).drop("core")
    group = ["series_id"] if is_bounded(panel) else ["series_id", "piece"]
    before = Window.partitionBy(*group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # Looking ahead is looking back in reverse order: a frame that only grows is linear,
    # one that shrinks from the far end is evaluated anew for every row.
    after = Window.partitionBy(*group).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.withColumn("_lo", F.last(known, ignorenulls=True).over(before)).withColumn(
        "_hi", F.last(known, ignorenulls=True).over(after)
    )
    if not is_bounded(panel):
        left = Window.partitionBy("series_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        right = Window.partitionBy("series_id").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
        edges = (
            cut.groupBy(*group)
            .agg(F.max(known).alias("_last"), F.min(known).alias("_first"))
            .select(
                *group,
                F.last("_last", ignorenulls=True).over(left).alias("_carry"),
                F.last("_first", ignorenulls=True).over(right).alias("_ahead"),
            )
        )
        filled = (
            filled.join(edges, group)
            .withColumn("_lo", F.coalesce("_lo", "_carry"))
            .withColumn("_hi", F.coalesce("_hi", "_ahead"))
        )
    share = ratio(F.col("pos") - F.col("_lo.p"), F.col("_hi.p") - F.col("_lo.p"))
    between = F.col("_lo.v") + (F.col("_hi.v") - F.col("_lo.v")) * share
    return filled.withColumn("y", F.coalesce("y", between, "_lo.v", "_hi.v")).select(*panel.columns)


def despike(panel: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Replace flagged rows, and every missing one, by interpolation."""
    rows = panel if "pos" in panel.columns else with_pos(panel)
    flags = anomalies.select("series_id", "pos", F.lit(True).alias("_flag"))
    marked = rows.join(flags, ["series_id", "pos"], "left").withColumn(
        "y", F.when(F.col("_flag").isNull(), F.col("y"))
    )
    return interpolate(marked.drop("_flag"))


def detrend(panel: DataFrame) -> DataFrame:
    """Residuals ``e`` of the straight line over position, with ``n`` and the residual variance flag.

    The line is a window beside the positions, or one aggregate joined back for long series.
    """
    rows = compact(panel)
    line = {
        "n": F.count(F.lit(1)),
        "_slope": F.regr_slope("y", "pos"),
        "_cut": F.regr_intercept("y", "pos"),
        "_sd": F.stddev_pop("y"),
    }
    residual = (F.col("y") - (F.col("_cut") + F.col("_slope") * F.col("pos"))).alias("e")
    if is_bounded(panel):
        w = Window.partitionBy("series_id")
        fitted = rows.select("*", *[e.over(w).alias(k) for k, e in line.items()])
        return fitted.select("series_id", "ts", "pos", "n", "_sd", residual)
    fitted = rows.join(rows.groupBy("series_id").agg(*[e.alias(k) for k, e in line.items()]), "series_id")
    return fitted.select("series_id", "block", "ts", "pos", "n", "_sd", residual)


def lag_products(max_lag: str, value: str, keys: list[str]):
    """Kernel: one piece and its halo in, ``sum(x[t] * x[t - lag])`` over the piece's own rows out."""

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x = pdf[value].to_numpy(float)
        head = int((~pdf["core"].to_numpy(bool)).sum())
        top = int(pdf[max_lag].iloc[0])
        sums = np.zeros(top + 1)
        for lag in range(min(top, len(x) - 1) + 1):
            start = max(head, lag)
            sums[lag] = x[start:] @ x[start - lag : len(x) - lag]
        out = {k: v for k, v in zip(keys, key)}
        return pd.DataFrame({**{k: [v] * (top + 1) for k, v in out.items()}, "lag": np.arange(top + 1), "s": sums})

    return kernel


def lagged_sums(df: DataFrame, by: list[str], value: str, max_lag: str) -> DataFrame:
    """``sum(x[t] * x[t - lag])`` for lags 0..max_lag per group: partial sums per piece, then added.

    ``max_lag`` is a column that is constant per group. Only the last ``max_lag`` rows of a
    piece are sent twice; nothing is joined row to row.
    """
    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in by] + ["lag int", "s double"])
    cut = pieces(df.select(*by, "pos", value, max_lag), F.col(max_lag))
    return (
        cut.groupBy(*by, "piece")
        .applyInPandas(lag_products(max_lag, value, by), schema)
        .groupBy(*by, "lag")
        .agg(F.sum("s").alias("s"))
    )


def acf(panel: DataFrame, max_lag: Column | int) -> DataFrame:
    """Biased autocorrelation of ``e`` (see :func:`detrend`) at lags 0..max_lag."""
    top = F.lit(max_lag) if isinstance(max_lag, int) else max_lag
    top = F.greatest(F.least(top, F.floor(F.col("n") / 2) - 1), F.lit(0)).cast("int")
    sums = lagged_sums(panel.withColumn("_top", top), ["series_id"], "e", "_top")
    zero = sums.where(F.col("lag") == 0).select("series_id", F.col("s").alias("_s0"))
    return sums.join(zero.where(F.col("_s0") > 0), "series_id").select(
        "series_id", "lag", (F.col("s") / F.col("_s0")).alias("acf")
    )


def bin_period(k: Column, n: Column) -> Column:
    """Integer period of spectrum bin ``k``, rounding halves to even like the FFT grid does."""
    return F.rint(F.lit(1.0) / (k.cast("double") * (F.lit(1.0) / n.cast("double")))).cast("int")


def _fft_kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    e = pdf.sort_values("pos")["e"].to_numpy(float)
    power = np.abs(np.fft.rfft(e))[1:] ** 2
    return pd.DataFrame(
        {"series_id": key[0], "n": len(e), "k": np.arange(1, len(power) + 1), "power": power}
    )


def power(panel: DataFrame, fft_rows: int = FFT_ROWS) -> DataFrame:
    """One-sided power of ``e`` at bins 1..n/2 with each bin's integer period.

    Up to ``fft_rows`` points a series is one FFT; a longer one goes through a spectrum
    that is split over many groups, so neither path holds an unbounded series.
    """
    rows = panel.select("series_id", "pos", "n", "e")
    short = rows if is_bounded(panel) else rows.where(F.col("n") <= fft_rows)
    spectrum = short.groupBy("series_id").applyInPandas(
        _fft_kernel, "series_id string, n bigint, k bigint, power double"
    )
    if not is_bounded(panel):
        spectrum = spectrum.unionByName(long_spectrum(rows.where(F.col("n") > fft_rows)))
    return spectrum.withColumn("period", bin_period(F.col("k"), F.col("n")))


def total_power(panel: DataFrame) -> DataFrame:
    """Sum of the one-sided power without bin 0, from three sums (Parseval), linear in n."""
    sign = F.when(F.col("pos") % 2 == 0, F.col("e")).otherwise(-F.col("e"))
    sums = panel.groupBy("series_id").agg(
        F.first("n").alias("n"),
        F.sum(F.col("e") * F.col("e")).alias("_ss"),
        F.sum("e").alias("_s"),
        F.sum(sign).alias("_alt"),
    )
    nyquist = F.when(F.col("n") % 2 == 0, F.col("_alt") * F.col("_alt")).otherwise(F.lit(0.0))
    full = F.col("n") * F.col("_ss") - F.col("_s") * F.col("_s")
    return sums.select("series_id", "n", ((full + nyquist) / 2).alias("total_power"), F.col("_ss").alias("energy"))


def _season_kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Power and autocorrelation at every integer period of one series up to its lag limit."""
    e = pdf.sort_values("pos")["e"].to_numpy(float)
    n = len(e)
    top = min(int(pdf["_limit"].iloc[0]), n // 2 - 1)
    spectrum = np.abs(np.fft.rfft(e))[1:] ** 2
    period = np.rint(1.0 / (np.arange(1, len(spectrum) + 1) * (1.0 / n))).astype(np.int64)
    power = np.bincount(period[period <= top], spectrum[period <= top], top + 1)
    have = np.unique(period[period <= top])
    energy = float(e @ e)
    at = np.array([e[p:] @ e[: n - p] for p in have]) / energy if energy else np.zeros(len(have))
    return pd.DataFrame(
        {"series_id": key[0], "n": n, "period": have, "power": power[have], "acf": at, "total_power": spectrum.sum()}
    )


def periods(panel: DataFrame, frequency: DataFrame) -> DataFrame:
    """``(series_id, n, period, power, acf, total_power)`` for periods inside the lag limit.

    One kernel per series where it fits in a task; otherwise the piecewise autocorrelation,
    the split spectrum and the Parseval total, joined per period.
    """
    rows = detrend(panel).join(frequency.select("series_id", "frequency"), "series_id")
    rows = rows.where((F.col("n") >= MIN_OBS) & (F.col("_sd") > 0))
    rows = rows.withColumn("_limit", 2 * expected_period(F.col("frequency")))
    if is_bounded(panel):
        return rows.select("series_id", "pos", "e", "_limit").groupBy("series_id").applyInPandas(
            _season_kernel,
            "series_id string, n bigint, period int, power double, acf double, total_power double",
        )
    lags = acf(rows, F.col("_limit")).where(F.col("lag") > 0).withColumnRenamed("lag", "period")
    per_period = power(rows).groupBy("series_id", "period").agg(F.sum("power").alias("power"))
    return lags.join(per_period, ["series_id", "period"]).join(total_power(rows), "series_id").select(
        "series_id", "n", "period", "power", "acf", "total_power"
    )


def detect_seasonality(panel: DataFrame, frequency: DataFrame) -> DataFrame:
    """Confirmed periods, the dominant one and the share of power they explain, per series."""
    kept = periods(panel, frequency).where(F.col("acf") > F.lit(BAND) / F.sqrt("n"))
    found = kept.groupBy("series_id").agg(
        F.sort_array(F.collect_list("period")).alias("detected_periods"),
        F.max_by("period", F.struct("power", -F.col("period"))).alias("dominant_period"),
        F.sum("power").alias("_confirmed"),
        F.first("total_power").alias("total_power"),
    )
    share = ratio(F.col("_confirmed"), F.col("total_power"))
    empty = F.array().cast("array<int>")
    return (
        panel.select("series_id").distinct()
        .join(found, "series_id", "left")
        .select(
            "series_id",
            F.col("detected_periods").isNotNull().alias("has_seasonality"),
            F.coalesce("detected_periods", empty).alias("detected_periods"),
            F.when(share.isNull(), F.lit(0.0))
            .otherwise(exact_round(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)), 4))
            .alias("seasonality_strength"),
            "dominant_period",
        )
    )
