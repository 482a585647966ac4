"""Forecast requests that arrive as files, run as they come in."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seriesloom.operators.vectors import Embedder, WordCountEmbedder, memories_from_jobs
from seriesloom.plans.jobs import REQUEST, Panels, run_forecast


def finished_jobs(spark: SparkSession, out: str) -> DataFrame | None:
    """Job rows written so far, or None before the first batch; any other problem is raised."""
    return _written(spark, f"{out}/jobs")


def _written(spark: SparkSession, folder: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    found = files.listFiles(path, True)
    while found.hasNext():  # batches without any row leave folders without a data file
        if found.next().getPath().getName().startswith("part-"):
            return spark.read.parquet(folder)
    return None


def job_states(spark: SparkSession, out: str) -> DataFrame | None:
    """``(job_id, status)`` of every job taken in: ``done``, ``failed``, or ``running`` while it has no result.

    A request that waits in the folder and was not taken in yet is pending; :func:`pending_requests` lists those.
    """
    started, finished = _written(spark, f"{out}/started"), finished_jobs(spark, out)
    if started is None:
        return None
    ended = spark.createDataFrame([], "job_id string, status string") if finished is None else finished.select("job_id", "status")
    running = started.select("job_id").distinct().join(ended, "job_id", "left_anti")
    return ended.unionByName(running.withColumn("status", F.lit("running")))


def pending_requests(spark: SparkSession, request_dir: str, out: str) -> DataFrame:
    """Job ids of request lines that no batch has taken in."""
    asked = spark.read.schema("job_id string").json(request_dir).where("job_id IS NOT NULL").distinct()
    started = _written(spark, f"{out}/started")
    return asked if started is None else asked.join(started.select("job_id"), "job_id", "left_anti")


def stream_jobs(
    spark: SparkSession,
    request_dir: str,
    panel: Panels,
    checkpoint: str,
    out: str,
    max_files: int = 1000,
    embedder: Embedder | None = None,
) -> StreamingQuery:
    """Run every request file found in ``request_dir`` and stop when all are done.

    A job id runs once: repeats inside a batch collapse and ids already written are left
    out. Each batch writes its own folder and overwrites it when replayed, so a restart
    after a lost driver neither repeats nor loses a job.

    Folders of ``out``: ``started`` (ids as a batch takes them in), ``jobs`` (with diagnosis and digest), ``forecasts``, and
    ``memories``: the digests of done jobs, embedded, best effort.
    """
    embedder = embedder or WordCountEmbedder()

    # Values are read as text, so that one that does not parse is refused instead of taken for missing.
    fields = [c.split(" ")[0] for c in REQUEST.split(", ")]
    schema = ", ".join(f"{c} string" for c in (*fields, "malformed"))
    lines = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .option("columnNameOfCorruptRecord", "malformed")
        .json(request_dir)
    )
    # A line without a job id is named after its contents: it fails alone and runs once.
    name = F.concat(F.lit("unnamed-"), F.substring(F.sha2(F.to_json(F.struct("*")), 256), 1, 16))
    requests = lines.withColumn("job_id", F.coalesce("job_id", name))

    def run(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c != "job_id"]
        first = F.min_by(F.struct(*rest), F.struct("created_at", "series_id", "model_name", "horizon", "conformal"))
        new = batch.groupBy("job_id").agg(first.alias("r")).select("job_id", "r.*")
        done = finished_jobs(spark, out)
        if done is not None:
            earlier = done.where(F.col("batch") < batch_id).select("job_id")
            new = new.join(earlier, "job_id", "left_anti")
        new.select("job_id", F.current_timestamp().alias("started_at")).write.mode("overwrite").parquet(
            f"{out}/started/batch={batch_id}"
        )
        result = run_forecast(panel, new)
        result.forecasts.write.mode("overwrite").parquet(f"{out}/forecasts/batch={batch_id}")
        result.jobs.write.mode("overwrite").partitionBy("status").parquet(f"{out}/jobs/batch={batch_id}")
        try:
            jobs = spark.read.parquet(f"{out}/jobs").where(F.col("batch") == batch_id)
            memories_from_jobs(jobs, embedder).write.mode("overwrite").parquet(f"{out}/memories/batch={batch_id}")
        except Exception as problem:  # a job is done even if it cannot be remembered
            logging.getLogger(__name__).warning("batch %s was not remembered: %s", batch_id, problem)

    return (
        requests.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
