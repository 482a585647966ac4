"""Cutting lineage where a table is used by many branches."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder; on a cluster that would not
    survive the loss of a machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
            folder = tempfile.mkdtemp(prefix="seriesloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder once and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
