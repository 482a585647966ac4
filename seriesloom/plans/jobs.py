"""Forecast requests: validation, a whole batch in one go, and their results."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.lineage import checkpoint
from seriesloom.operators.ets import failures
from seriesloom.operators.registry import FLOORS, MODELS, build, floor_of, usable_counts
from seriesloom.plans.diagnosis import digest_column, full_diagnosis

# What a forecast row holds, also where a batch has none.
FORECAST = (
    "job_id string, series_id string, model_name string, step_no int, ts timestamp, yhat double, lo80 double, hi80 double, "
    "lo95 double, hi95 double, metadata map<string,string>"
)
REQUEST = "job_id string, series_id string, model_name string, horizon int, conformal boolean, created_at timestamp, target_column string"

# Request defaults and limits.
DEFAULT_MODEL = "prophet"
DEFAULT_HORIZON = 30
MAX_HORIZON = 1000


class ForecastBatch(NamedTuple):
    jobs: DataFrame
    forecasts: DataFrame


def with_defaults(requests: DataFrame) -> DataFrame:
    """Fill in model, horizon and conformal flag where the request leaves them open.

    A given horizon or flag that does not parse stays NULL, and the request is refused for it.
    """
    have = requests.columns

    def col(name: str, kind: str) -> Column:
        return F.col(name).cast("string").try_cast(kind) if name in have else F.lit(None).cast(kind)

    def default(name: str, kind: str, value: Column) -> Column:
        return F.when(F.col(name).isNull(), value).otherwise(col(name, kind)) if name in have else value

    return requests.select(
        "job_id",
        "series_id",
        F.coalesce(col("model_name", "string"), F.lit(DEFAULT_MODEL)).alias("model_name"),
        default("horizon", "int", F.lit(DEFAULT_HORIZON)).alias("horizon"),
        default("conformal", "boolean", F.lit(False)).alias("conformal"),
        F.coalesce(col("created_at", "timestamp"), F.current_timestamp()).alias("created_at"),
        col("target_column", "string").alias("target_column"),
        col("malformed", "string").alias("malformed"),
    )


def check_requests(requests: DataFrame, panel: DataFrame) -> DataFrame:
    """Requests with ``usable`` rows of their series and an ``error`` where they are refused."""
    usable = usable_counts(panel)
    floor, fits = F.lit(None).cast("int"), []
    for name in sorted(MODELS):
        fits.append(F.when(F.col("usable") >= FLOORS[name], F.lit(name)))
        for wrapped in (False, True):
            floor = F.when(
                (F.col("model_name") == name) & (F.col("conformal") == wrapped), F.lit(floor_of(name, wrapped))
            ).otherwise(floor)
    names = F.array_compact(F.array(*fits))
    label = F.when(F.col("conformal"), F.concat(F.lit("conformal("), "model_name", F.lit(")"))).otherwise(
        F.col("model_name")
    )
    # The wording of the refusals.
    unknown = F.concat(
        F.lit("ValueError: Unknown model '"), "model_name", F.lit(f"'. Available: {', '.join(MODELS)}.")
    )
    short = F.concat(
        F.lit("ValueError: "), label, F.lit(" needs at least "), floor.cast("string"),
        F.lit(" usable observations and this series has "), F.col("usable").cast("string"), F.lit(". "),
        F.when(F.size(names) > 0, F.concat(F.lit("Models that fit: "), F.array_join(names, ", "), F.lit(".")))
        .otherwise(F.lit("No model fits.")),
    )
    horizon = F.lit(f"ValueError: horizon must be between 1 and {MAX_HORIZON}.")
    missing = F.concat(F.lit("LookupError: No series '"), "series_id", F.lit("'."))
    return with_defaults(requests).join(usable, "series_id", "left").select(
        "job_id",
        "series_id",
        "model_name",
        "horizon",
        "conformal",
        "created_at",
        "target_column",
        label.alias("label"),
        F.coalesce("usable", F.lit(0)).alias("usable"),
        F.when(F.col("malformed").isNotNull(), F.lit("ValueError: the request is not a JSON object."))
        .when(~F.col("model_name").isin(*MODELS), unknown)
        .when(~F.coalesce(F.col("horizon").between(1, MAX_HORIZON), F.lit(False)), horizon)
        .when(F.col("conformal").isNull(), F.lit("ValueError: conformal must be true or false."))
        .when(F.col("usable").isNull(), missing)
        .when(F.col("usable") < floor, short)
        .alias("error"),
    )


Panels = DataFrame | dict[str, DataFrame]


def run_jobs(requests: DataFrame, panel: Panels, target: str = "y") -> ForecastBatch:
    """Run every request; a refused or failing one is a ``failed`` row and stops nothing else.

    ``panel`` is the panel of one target column, named ``target``, or a dict of panels by target column; a request
    without ``target_column`` gets the first. A target that no panel has is refused.
    """
    panels = panel if isinstance(panel, dict) else {target: panel}
    named = F.col("target_column") if "target_column" in requests.columns else F.lit(None).cast("string")
    asked = requests.withColumn("target_column", F.coalesce(named, F.lit(next(iter(panels)))))
    batches = [_run_one(asked.where(F.col("target_column") == name), one) for name, one in panels.items()]
    # Fixed value: the wording of this refusal.
    lost = F.concat(F.lit("ValueError: target_column '"), F.col("target_column"), F.lit("' not found in DataFrame."))
    unknown = (
        with_defaults(asked.where(~F.col("target_column").isin(*panels)))
        .withColumn("usable", F.lit(0).cast("bigint"))
        .withColumn("started_at", F.current_timestamp())
        .select(*_JOB, F.lit("failed").alias("status"), lost.alias("error"), F.current_timestamp().alias("finished_at"))
    )
    jobs, forecasts = unknown, None
    for batch in batches:
        jobs = batch.jobs.unionByName(jobs)
        forecasts = batch.forecasts if forecasts is None else forecasts.unionByName(batch.forecasts)
    return ForecastBatch(jobs, forecasts)


def _run_one(requests: DataFrame, panel: DataFrame) -> ForecastBatch:
    """The requests on one panel.

    Requests that agree on series, model and intervals share one fit at their largest
    horizon. Which model variants occur is read first: a handful of rows.
    """
    checked = checkpoint(check_requests(requests, panel).withColumn("started_at", F.current_timestamp()))
    accepted = checked.where(F.col("error").isNull())
    variants = accepted.select("model_name", "conformal").distinct().collect()
    # Every variant reads the panel several times; only requested series are kept.
    wanted = accepted.select("series_id").distinct()
    used = checkpoint(panel.join(wanted, "series_id", "left_semi")) if variants else panel
    made = None
    for name, wrapped in sorted((r["model_name"], r["conformal"]) for r in variants):
        mine = accepted.where((F.col("model_name") == name) & (F.col("conformal") == wrapped))
        need = mine.groupBy("series_id").agg(F.max("horizon").alias("horizon"))
        try:
            # Written here, so that a model whose plan fails to run fails alone as well.
            part = checkpoint(build(name, wrapped)(used.join(need.select("series_id"), "series_id", "left_semi"), need))
        except Exception as problem:  # whatever a plugged-in model raises is its requests' outcome
            label = f"conformal({name})" if wrapped else name
            message = f"{type(problem).__name__}: {str(problem).splitlines()[0][:500] if str(problem) else ''}"
            part = failures(need.select("series_id", F.lit(message).alias("error")), label)
        made = part if made is None else made.unionByName(part)
    if made is None:
        jobs = checked.select(*_JOB, F.lit("failed").alias("status"), "error", F.current_timestamp().alias("finished_at"))
        return ForecastBatch(jobs, checked.sparkSession.createDataFrame([], FORECAST))
    made = made.withColumnRenamed("model_name", "label").withColumnRenamed("error", "fit_error")
    outcome = made.groupBy("series_id", "label").agg(
        F.min("fit_error").alias("fit_error"), F.count("step_no").alias("_steps")
    )
    silent = F.lit("ValueError: the model gave no forecast.")
    problem = F.coalesce("error", "fit_error", F.when(F.coalesce("_steps", F.lit(0)) == 0, silent))
    jobs = (
        checked.join(outcome, ["series_id", "label"], "left")
        .withColumn("error", problem)
        .select(
            *_JOB,
            F.when(F.col("error").isNull(), F.lit("done")).otherwise(F.lit("failed")).alias("status"),
            "error",
            F.current_timestamp().alias("finished_at"),
        )
    )
    forecasts = (
        accepted.select("job_id", "series_id", "label", "horizon")
        .join(made.where(F.col("fit_error").isNull() & F.col("step_no").isNotNull()), ["series_id", "label"])
        .where(F.col("step_no") <= F.col("horizon"))
        .withColumnRenamed("label", "model_name")
        .select(*[c.split(" ")[0] for c in FORECAST.split(", ")])
    )
    return ForecastBatch(jobs, forecasts)


_JOB = ["job_id", "series_id", "target_column", "model_name", "horizon", "conformal", "usable", "created_at", "started_at"]


def run_forecast(panel: Panels, requests: DataFrame, target: str = "y") -> ForecastBatch:
    """:func:`run_jobs` with the diagnosis and digest of each requested series and target on its job row."""
    panels = panel if isinstance(panel, dict) else {target: panel}
    batch = run_jobs(requests, panels)
    jobs = checkpoint(batch.jobs)  # read once for what to diagnose, once for the result
    diagnosis = None
    for name, one in panels.items():
        asked = jobs.where(F.col("target_column") == name).select("series_id").distinct()
        found = full_diagnosis(one.join(asked, "series_id", "left_semi"), name)
        diagnosis = found if diagnosis is None else diagnosis.unionByName(found)
    told = diagnosis.withColumn("summary", digest_column())
    return ForecastBatch(jobs.join(told, ["series_id", "target_column"], "left"), batch.forecasts)


def job_by_id(jobs: DataFrame, job_id: str) -> DataFrame:
    """Point lookup, pushed down to the scan."""
    return jobs.where(F.col("job_id") == job_id)


def jobs_by_status(jobs: DataFrame, status: str) -> DataFrame:
    """Jobs in a state; the results are partitioned by status, so only its folder is read."""
    return jobs.where(F.col("status") == status)
