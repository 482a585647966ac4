"""Split-conformal intervals around any forecaster (Papadopoulos 2002; Angelopoulos & Bates 2021)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.lineage import checkpoint
from seriesloom.functions.numeric import exact_round
from seriesloom.functions.order import order_statistics
from seriesloom.operators.grid import horizons
from seriesloom.sources.panel import is_bounded, with_pos

Forecaster = Callable[[DataFrame, "int | DataFrame"], DataFrame]

_INFINITY = float("inf")


def training_rows(n: Column) -> Column:
    """Rows used for fitting: 70 %, in integer arithmetic."""
    return F.floor(7 * n / 10)


def conformal_rank(alpha: float, n: Column) -> Column:
    """Rank of the half-width among ``n`` sorted scores; above ``n`` it is unbounded."""
    return F.ceil(F.lit(1.0 - alpha) * (n + 1))


def conformal_quantile(
    scores: DataFrame, by: Sequence[str], alphas: dict[str, float], value: str = "score", bounded: bool = False
) -> DataFrame:
    """``(…by, n_calibration, one column per alpha)``: exact order statistics, infinity beyond the last."""
    by = list(by)
    rows = scores.where(F.col(value).isNotNull())
    if bounded:
        w = Window.partitionBy(*by)
        ranked = rows.withColumn("_k", F.row_number().over(w.orderBy(value))).withColumn(
            "_n", F.count(F.lit(1)).over(w)
        )
        found = ranked.groupBy(*by).agg(
            F.first("_n").alias("n_calibration"),
            *[
                F.max(F.when(F.col("_k") == conformal_rank(a, F.col("_n")), F.col(value))).alias(name)
                for name, a in alphas.items()
            ],
        )
    else:
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_calibration"))
        ranks = {name: conformal_rank(a, F.col("_n")) for name, a in alphas.items()}
        found = sizes.join(order_statistics(rows, by, value, ranks).drop("_n"), by, "left")
    return found.select(
        *by, "n_calibration", *[F.coalesce(name, F.lit(_INFINITY)).alias(name) for name in alphas]
    )


def split_panel(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positioned rows with their series' size, and the panel of both cuts.

    Each row goes to the full cut and, if early enough, also to the training cut, so both
    fits run in one job. The cut is the first character of the series id.
    """
    rows = with_pos(panel)
    sizes = panel.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    sized = rows.join(sizes, "series_id").withColumn("n_train", training_rows(F.col("n")))
    cuts = F.when(F.col("pos") < F.col("n_train"), F.array(F.lit("t"), F.lit("f"))).otherwise(F.array(F.lit("f")))
    both = sized.withColumn("_cut", F.explode(cuts)).withColumn("series_id", F.concat("_cut", "series_id"))
    return sized, both.select(*panel.columns)


def calibration_scores(sized: DataFrame, train_forecast: DataFrame) -> DataFrame:
    """Absolute errors of the training-cut forecast over the calibration rows, by step."""
    actual = sized.where((F.col("pos") >= F.col("n_train")) & F.col("y").isNotNull()).select(
        "series_id", (F.col("pos") - F.col("n_train") + 1).cast("int").alias("step_no"), "y"
    )
    return actual.join(train_forecast.select("series_id", "step_no", "yhat"), ["series_id", "step_no"]).select(
        "series_id", "step_no", F.abs(F.col("y") - F.col("yhat")).alias("score")
    )


def conformal(base: Forecaster, panel: DataFrame, horizon: int | DataFrame) -> DataFrame:
    """The base model's point forecast with one half-width per level for all steps."""
    panel = checkpoint(panel)  # read for the cuts, the sizes and the scores
    sized, both = split_panel(panel)
    sizes = panel.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    ahead = horizons(panel, horizon).select(F.concat(F.lit("f"), F.col("series_id")).alias("series_id"), "horizon")
    back = sizes.select(
        F.concat(F.lit("t"), F.col("series_id")).alias("series_id"),
        (F.col("n") - training_rows(F.col("n"))).cast("int").alias("horizon"),
    )
    made = base(both, ahead.unionByName(back)).withColumn("_cut", F.substring("series_id", 1, 1)).withColumn(
        "series_id", F.expr("substring(series_id, 2)")
    )
    made = checkpoint(made)  # read for the scores, the errors and the result
    scores = calibration_scores(sized, made.where((F.col("_cut") == "t") & F.col("error").isNull()))
    widths = conformal_quantile(scores, ["series_id"], {"q80": 0.20, "q95": 0.05}, bounded=is_bounded(panel))
    errors = made.where(F.col("error").isNotNull()).groupBy("series_id").agg(F.min("error").alias("_failed"))
    full = made.where(F.col("_cut") == "f").drop("_cut").join(errors, "series_id", "left")
    bound = lambda sign, q: F.when(F.col("_failed").isNull(), F.col("yhat") + sign * F.col(q))
    # Without a single calibration row every rank is beyond the last score: infinite, like any missing rank.
    ok = full.where(F.col("_failed").isNull()).join(widths, "series_id", "left").withColumns(
        {
            "q80": F.coalesce("q80", F.lit(_INFINITY)),
            "q95": F.coalesce("q95", F.lit(_INFINITY)),
            "n_calibration": F.coalesce("n_calibration", F.lit(0)),
        }
    )
    good = ok.select(
        "series_id",
        F.concat(F.lit("conformal("), F.col("model_name"), F.lit(")")).alias("model_name"),
        "step_no",
        "ts",
        "yhat",
        bound(-1, "q80").alias("lo80"),
        bound(1, "q80").alias("hi80"),
        bound(-1, "q95").alias("lo95"),
        bound(1, "q95").alias("hi95"),
        F.map_concat(
            "metadata",
            F.create_map(
                F.lit("n_calibration"), F.col("n_calibration").cast("string"),
                F.lit("q80"), exact_round(F.col("q80"), 4).cast("string"),
                F.lit("q95"), exact_round(F.col("q95"), 4).cast("string"),
            ),
        ).alias("metadata"),
        "error",
    )
    empty = [F.lit(None).cast("double").alias(c) for c in ("yhat", "lo80", "hi80", "lo95", "hi95")]
    failed = made.where(F.col("error").isNotNull()).groupBy("series_id").agg(
        F.first("model_name").alias("m"), F.min("error").alias("error")
    ).select(
        "series_id",
        F.concat(F.lit("conformal("), F.col("m"), F.lit(")")).alias("model_name"),
        F.lit(None).cast("int").alias("step_no"),
        F.lit(None).cast("timestamp").alias("ts"),
        *empty,
        F.lit(None).cast("map<string,string>").alias("metadata"),
        "error",
    )
    return good.unionByName(failed)


def unbounded_intervals(forecast: DataFrame) -> DataFrame:
    """Per series and model, whether the last step's 95 % interval is infinite or undefined."""
    last = forecast.where(F.col("step_no").isNotNull()).groupBy("series_id", "model_name").agg(
        F.max_by(F.struct("lo95", "hi95"), "step_no").alias("b")
    )
    open_ = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == _INFINITY)
    return last.select("series_id", "model_name", (open_("b.lo95") | open_("b.hi95")).alias("unbounded"))
