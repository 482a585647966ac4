"""The full diagnosis of a panel, and its six-line text digest."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.lineage import checkpoint
from seriesloom.functions.numeric import exact_round
from seriesloom.operators.anomaly import NORMALITY_ROWS, anomaly_counts, anomaly_methods, detect_anomalies
from seriesloom.operators.profile import column_stats, find_time_column
from seriesloom.operators.profile import profile as measure
from seriesloom.operators.seasonality import despike, detect_seasonality
from seriesloom.operators.stationarity import check_stationarity
from seriesloom.sources.panel import column_types, pick_target, series_key, to_panel, with_pos


def full_diagnosis(
    panel: DataFrame,
    target: str = "y",
    method: str = "auto",
    normality_rows: int = NORMALITY_ROWS,
    found: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """One row per series: profile, stationarity, seasonality and anomalies as structs.

    Stationarity is tested on the raw values, seasonality on the de-spiked ones. The
    positioned panel feeds every branch, so it is written once; a written table keeps no partitioning, so each branch
    shuffles it by series again.
    """
    if found is None:
        rows = checkpoint(with_pos(panel))
        methods = checkpoint(anomaly_methods(rows, method, normality_rows))
        anomalies = checkpoint(detect_anomalies(rows, methods=methods))
    else:  # a positioned, written panel with its methods and anomalies
        rows, (methods, anomalies) = panel, found
    measured = checkpoint(measure(rows))
    frequency = measured.select("series_id", "frequency")
    profile = measured.select(
        "series_id",
        F.struct(
            "row_count",
            F.col("start_ts"),
            F.col("end_ts"),
            F.col("frequency").alias("detected_frequency"),
            "duplicate_timestamps",
            "missing_count",
            "missing_pct",
            "mean",
            "std",
            "min",
            "max",
            "skew",
            "kurtosis",
        ).alias("profile"),
    )
    stationarity = check_stationarity(rows).select(
        "series_id",
        F.struct("is_stationary", "adf_pvalue", "kpss_pvalue", "recommended_differencing", "note").alias("stationarity"),
    )
    seasonality = detect_seasonality(despike(rows, anomalies), frequency).select(
        "series_id",
        F.struct("has_seasonality", "detected_periods", "seasonality_strength", "dominant_period").alias("seasonality"),
    )
    counted = methods.join(anomaly_counts(anomalies), "series_id", "left").select(
        "series_id",
        F.struct(
            F.coalesce("anomaly_count", F.lit(0)).alias("anomaly_count"),
            F.col("method").alias("method_used"),
            "rows_tested",
        ).alias("anomalies"),
    )
    return (
        profile.join(stationarity, "series_id")
        .join(seasonality, "series_id")
        .join(counted, "series_id")
        .select("series_id", F.lit(target).alias("target_column"), "profile", "stationarity", "seasonality", "anomalies")
    )


def _fixed(x: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, ties decided on the exact binary value."""
    value = exact_round(x, digits)
    text = F.format_string(f"%.{digits}f", value)
    return F.when((value == 0) & (x < 0), F.concat(F.lit("-"), text)).otherwise(text)


def digest_column() -> Column:
    """The digest over the columns of :func:`full_diagnosis`. Wording and formats are fixed values."""
    text, c = F.lit, F.col
    month = lambda name: F.date_format(c(name), "MMM yyyy")
    dates = F.when(
        c("profile.start_ts").isNotNull(),
        F.concat(text(", "), month("profile.start_ts"), text(" to "), month("profile.end_ts")),
    ).otherwise(text(""))
    dataset = F.concat(
        text("Dataset: "), c("profile.row_count").cast("string"), text(" rows, "),
        c("profile.detected_frequency"), text(" frequency"), dates, text("."),
    )
    target = F.concat(
        text("Target column: '"), c("target_column"), text("'"),
        F.when(
            c("profile.mean").isNotNull() & c("profile.std").isNotNull(),
            F.concat(text(" (mean: "), _fixed(c("profile.mean"), 1), text(", std: "), _fixed(c("profile.std"), 1), text(")")),
        ).otherwise(text("")),
        text("."),
    )
    missing = F.when(
        c("profile.missing_count") > 0,
        F.concat(
            c("profile.missing_count").cast("string"), text(" missing values detected ("),
            _fixed(c("profile.missing_pct"), 1), text("%)."),
        ),
    ).otherwise(text("No missing values in target column."))
    adf, kpss = c("stationarity.adf_pvalue"), c("stationarity.kpss_pvalue")
    order = c("stationarity.recommended_differencing")
    word = F.when(order == 1, "First").when(order == 2, "Second").otherwise("Higher-order")
    stationarity = (
        F.when(adf.isNull(), F.concat(text("Stationarity test skipped ("), F.coalesce(c("stationarity.note"), text("None")), text(").")))
        .when(
            c("stationarity.is_stationary"),
            F.concat(text("Series is stationary (ADF p="), _fixed(adf, 2), text(", KPSS p="), _fixed(kpss, 2), text(").")),
        )
        .otherwise(
            F.concat(text("Series is non-stationary (ADF p="), _fixed(adf, 2), text("). "), word, text(" differencing recommended."))
        )
    )
    strength = c("seasonality.seasonality_strength")
    label = F.when(strength >= 0.6, "Strong").when(strength >= 0.3, "Moderate").otherwise("Weak")
    seasonality = F.when(
        c("seasonality.has_seasonality"),
        F.concat(
            label, text(" seasonality detected (period="), c("seasonality.dominant_period").cast("string"),
            text(", strength="), _fixed(strength, 2), text(")."),
        ),
    ).otherwise(text("No clear seasonality detected."))
    anomalies = F.when(
        c("anomalies.anomaly_count") > 0,
        F.concat(
            c("anomalies.anomaly_count").cast("string"), text(" anomalies flagged ("),
            c("anomalies.method_used"), text(" method)."),
        ),
    ).otherwise(text("No anomalies detected."))
    return F.concat_ws("\n", dataset, target, missing, stationarity, seasonality, anomalies)


def digest(diagnosis: DataFrame) -> DataFrame:
    return diagnosis.select("series_id", digest_column().alias("summary"))


class Report(NamedTuple):
    """The full report on a table: one row per series, per series and column, and per anomaly."""

    series: DataFrame
    columns: DataFrame
    anomalies: DataFrame


def full_report(
    df: DataFrame,
    keys: Sequence[str],
    ts: str | None = None,
    target: str | None = None,
    grain: str | None = None,
    method: str = "auto",
    normality_rows: int = NORMALITY_ROWS,
) -> Report:
    """Diagnose a raw table: :func:`full_diagnosis` of the target with what else the table holds.

    ``series`` also names the ``datetime_column`` and lists ``columns``, ``numeric_columns`` and ``categorical_columns``;
    ``columns`` has missing values and moments of every column per series; ``anomalies`` is the long table of flagged rows
    ``(series_id, pos, value, score, method)``. Tables instead of arrays, so nothing grows with a series.
    """
    rest = df.drop(*keys)
    ts = ts or find_time_column(rest)
    if ts is None:
        raise ValueError("The table has no column that reads as times.")
    target = pick_target(rest, target, ts)
    panel = checkpoint(with_pos(to_panel(df, keys, ts, target, grain)))
    methods = checkpoint(anomaly_methods(panel, method, normality_rows))
    found = checkpoint(detect_anomalies(panel, methods=methods))
    numeric, categorical = column_types(rest, ts)
    names = lambda cols: F.array(*[F.lit(c) for c in cols]).cast("array<string>")
    series = full_diagnosis(panel, target, method, normality_rows, (methods, found)).withColumns(
        {
            "datetime_column": F.lit(ts),
            "columns": names(rest.columns),
            "numeric_columns": names(numeric),
            "categorical_columns": names(categorical),
        }
    )
    keyed = df.withColumn("series_id", series_key(keys)).drop(*keys)
    columns = column_stats(keyed.drop(ts), ["series_id"])
    return Report(series, columns, found)
