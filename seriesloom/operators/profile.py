"""Profiling: time column, frequency, duplicates, missing values and moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions.numeric import exact_round, ratio, sample_kurtosis, sample_skew
from seriesloom.functions.order import exact_quantile
from seriesloom.sources.panel import as_timestamp, column_types, is_bounded, is_numeric, series_key, to_panel, with_pos

# Inclusive bands of the median step in seconds, the largest tolerated
# MAD / median, and the share of rows that must parse in a time column.
FREQUENCY_BANDS = [
    (1_800, 5_400, "hourly"),
    (72_000, 108_000, "daily"),
    (518_400, 691_200, "weekly"),
    (2_246_400, 2_851_200, "monthly"),
]
MAX_DISPERSION = 0.25
MIN_PARSE_RATE = 0.8


def time_column_rates(df: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    """Share of rows that parse as a time, per non-numeric column: one pass, one row each."""
    simple = (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)
    fields = [f.name for f in df.schema.fields if isinstance(f.dataType, simple)]
    if not fields:
        return df.sparkSession.createDataFrame([], "position int, column string, parse_rate double")
    wide = df.agg(*[F.avg(as_timestamp(df, c, formats).isNotNull().cast("int")).alias(c) for c in fields])
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("position"),
                        F.lit(c).alias("column"),
                        F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias("parse_rate"),
                    )
                    for i, c in enumerate(fields)
                ]
            )
        )
    )


def find_time_column(df: DataFrame, min_rate: float = MIN_PARSE_RATE, formats: Sequence[str] = ()) -> str | None:
    """First non-numeric column, left to right, of which enough rows parse. Collects one row."""
    best = (
        time_column_rates(df, formats)
        .where(F.col("parse_rate") >= min_rate)
        .agg(F.min_by("column", "position").alias("c"))
        .first()
    )
    return best["c"]


def series_stats(panel: DataFrame) -> DataFrame:
    """Rows, date range, duplicate times, missing values and moments, one row per series.

    Times are counted per value first, so copies of one time collapse before the shuffle.
    """
    per_time = panel.groupBy("series_id", "ts").agg(F.count(F.lit(1)).alias("_c"))
    times = per_time.groupBy("series_id").agg(
        F.sum("_c").alias("row_count"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.sum(F.col("_c") - 1).alias("duplicate_timestamps"),
    )
    return times.join(column_stats(panel, ["series_id"], ["y"]).drop("column", "is_numeric"), "series_id")


def _moments(c: str, alias: str) -> list[Column]:
    x = F.col(f"`{c}`").cast("double")
    n = F.count(x)
    return [
        F.avg(x).alias(f"{alias}_mean"),
        F.stddev_samp(x).alias(f"{alias}_std"),
        F.min(x).alias(f"{alias}_min"),
        F.max(x).alias(f"{alias}_max"),
        sample_skew(F.skewness(x), n).alias(f"{alias}_skew"),
        sample_kurtosis(F.kurtosis(x), n).alias(f"{alias}_kurtosis"),
    ]


_STATS = ("mean", "std", "min", "max", "skew", "kurtosis")


def column_stats(df: DataFrame, by: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """One row per (group, column): missing rows and share, and the moments of numeric columns.

    A single wide aggregate over the table, then unpivoted; only the named columns are read.
    """
    by = list(by)
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in by]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs.append(F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}_missing"))
        if is_numeric(df.schema[c].dataType):
            aggs += _moments(c, f"c{i}")
    wide = df.groupBy(*by).agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        numeric = is_numeric(df.schema[c].dataType)
        stats = [
            (F.col(f"c{i}_{s}") if numeric else F.lit(None)).cast("double").alias(s) for s in _STATS
        ]
        pct = ratio(F.col(f"c{i}_missing"), F.col("_n")) * 100
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(numeric).alias("is_numeric"),
                F.col(f"c{i}_missing").alias("missing_count"),
                F.coalesce(exact_round(pct, 2), F.lit(0.0)).alias("missing_pct"),
                *stats,
            )
        )
    return wide.select(*by, F.inline(F.array(*rows)))


def _positioned(panel: DataFrame) -> DataFrame:
    return panel if "prev_ts" in panel.columns else with_pos(panel.where(F.col("ts").isNotNull()))


def deltas(panel: DataFrame) -> DataFrame:
    """Seconds between neighbouring rows of a series; zero for repeated times."""
    return (
        _positioned(panel).where(F.col("prev_ts").isNotNull())
        .select(
            "series_id", "ts", ((F.unix_micros("ts") - F.unix_micros("prev_ts")) / F.lit(1e6)).alias("delta_s")
        )
    )


def band_of(median_s: Column) -> Column:
    """The named frequency of a step in seconds, NULL between the bands."""
    out = F.lit(None).cast("string")
    for lo, hi, name in FREQUENCY_BANDS:
        out = F.when(median_s.between(lo, hi), F.lit(name)).otherwise(out)
    return out


def frequency_name(median_s: Column, mad_s: Column) -> Column:
    regular = (median_s > 0) & (ratio(mad_s, median_s) <= MAX_DISPERSION)
    return F.coalesce(F.when(regular, band_of(median_s)), F.lit("irregular"))


def _with_median_step(rows: DataFrame) -> DataFrame:
    """Positioned rows with their step and the series' median step, all in one partitioning."""
    step = (F.unix_micros("ts") - F.unix_micros("prev_ts")) / F.lit(1e6)
    return rows.withColumn("_step", step).withColumn(
        "_median", F.percentile("_step", F.lit(0.5)).over(Window.partitionBy("series_id"))
    )


def detect_frequency(panel: DataFrame) -> DataFrame:
    """Median step, its MAD and the frequency of each series.

    Series that fit in a task are measured where the position window left them: one shuffle.
    Otherwise steps are counted per value first (a regular series is a handful of distinct
    steps however long it is) and the exact medians run on those counts.
    """
    if is_bounded(panel):
        measured = _with_median_step(_positioned(panel)).groupBy("series_id").agg(
            F.first("_median").alias("median_s"),
            F.percentile(F.abs(F.col("_step") - F.col("_median")), F.lit(0.5)).alias("mad_s"),
        )
    else:
        steps = deltas(panel).groupBy("series_id", "delta_s").agg(F.count(F.lit(1)).alias("_w"))
        median = exact_quantile(steps, ["series_id"], "delta_s", 0.5, "median_s", F.col("_w"))
        apart = steps.join(median, "series_id").withColumn("_d", F.abs(F.col("delta_s") - F.col("median_s")))
        mad = exact_quantile(apart, ["series_id"], "_d", 0.5, "mad_s", F.col("_w"))
        measured = panel.select("series_id").distinct().join(median.join(mad, "series_id"), "series_id", "left")
    return measured.select(
        "series_id", "median_s", "mad_s", frequency_name(F.col("median_s"), F.col("mad_s")).alias("frequency")
    )


def profile(panel: DataFrame) -> DataFrame:
    """One row per series: range, frequency, duplicates, missing values and moments.

    For series that fit in a task this is one shuffle, one window and one aggregate.
    """
    if not is_bounded(panel):
        return series_stats(panel).join(detect_frequency(panel).select("series_id", "frequency", "median_s"), "series_id")
    wide = _with_median_step(_positioned(panel)).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count_if(F.col("ts") == F.col("prev_ts")).alias("duplicate_timestamps"),
        F.count_if(F.col("y").isNull()).alias("missing_count"),
        *_moments("y", "c"),
        F.first("_median").alias("median_s"),
        F.percentile(F.abs(F.col("_step") - F.col("_median")), F.lit(0.5)).alias("mad_s"),
    )
    pct = ratio(F.col("missing_count"), F.col("row_count")) * 100
    return wide.select(
        "series_id", "row_count", "start_ts", "end_ts", "duplicate_timestamps", "missing_count",
        exact_round(pct, 2).alias("missing_pct"),
        *[F.col(f"c_{s}").alias(s) for s in _STATS],
        frequency_name(F.col("median_s"), F.col("mad_s")).alias("frequency"),
        "median_s",
    )


def profile_table(df: DataFrame, by: Sequence[str], ts: str | None = None) -> DataFrame:
    """Profile every column of a raw table; ``ts`` is found from the data if not given."""
    ts = ts or find_time_column(df.drop(*by))
    numeric, categorical = column_types(df.drop(*by), ts)
    stats = column_stats(df, by, numeric + categorical)
    if ts is None:
        return stats.withColumn("frequency", F.lit("irregular")).withColumn("duplicate_timestamps", F.lit(0))
    keyed = df.withColumn("_one", F.lit(1.0))
    panel = to_panel(keyed, by, ts, "_one")
    sid = series_key(by)
    stamps = as_timestamp(df, ts)
    repeats = (
        df.groupBy(sid.alias("series_id"), stamps.alias("_ts"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .groupBy("series_id")
        .agg(
            F.sum("_c").alias("row_count"),
            F.min("_ts").alias("start_ts"),
            F.max("_ts").alias("end_ts"),
            F.sum(F.col("_c") - 1).alias("duplicate_timestamps"),
        )
    )
    header = repeats.join(detect_frequency(panel), "series_id", "left").withColumn(
        "frequency", F.coalesce("frequency", F.lit("irregular"))
    )
    return stats.withColumn("series_id", sid).join(header, "series_id")

