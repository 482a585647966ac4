"""Session settings the library expects."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    What ``--py-files`` does on submit; without it a worker can only import the package if
    it happens to be installed there.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="seriesloom-")) / root.name
        spark.sparkContext.addPyFile(shutil.make_archive(str(target), "zip", root.parent, root.name))
        _shipped.add(app)


def configure(spark: SparkSession) -> SparkSession:
    """UTC times, adaptive execution with skew-join handling, and the package on the workers.

    Safe to call again.
    """
    ship(spark)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in conf.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, name: str = "seriesloom") -> SparkSession:
    """A local session for tests and the benchmark."""
    return configure(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-", dir="/tmp"))
        .getOrCreate()
    )
