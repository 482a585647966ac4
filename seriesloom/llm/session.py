"""Session settings and small helpers that every operator of this subpackage uses."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions.lineage import shared_folder
from seriesloom.session import configure


def prepare(spark: SparkSession) -> SparkSession:
    """The library's settings, Arrow batches bounded in bytes (long texts), and no shuffle files kept behind a query."""
    configure(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def stored(
    df: DataFrame, name: str = "table", by: list[str] | None = None, codec: str | None = None, options: dict | None = None
) -> DataFrame:
    """Write a table to the folder all executors share and go on from the files.

    Cuts the lineage, like a checkpoint, but stays columnar and compressed. A lost executor costs
    nothing that was written. codec: compression of the files, the session's if None; options: others of
    Parquet's writer.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    writer = df.write.options(**options or {})
    if by:
        writer = writer.partitionBy(*by)
    if codec:
        writer = writer.option("compression", codec)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote, once nothing reads it any more."""
    spark = table.sparkSession
    marker = f"{shared_folder(spark)}/llm-"
    for folder in {f.split("/llm-", 1)[1].split("/", 1)[0] for f in table.inputFiles() if "/llm-" in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{marker}{folder}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def leading(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group in the given order, numbered from 1 in the column ``rank``.

    Groups are cut in buckets of tasks first and then as a whole, so no task holds more than k rows of each of about
    sqrt(tasks) buckets, however large a group is.
    """
    buckets = max(1, round(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    dealt = df.withColumn("_bucket", F.pmod(F.spark_partition_id(), F.lit(buckets)))
    first = Window.partitionBy(*by, "_bucket").orderBy(*order)
    some = dealt.withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= k).drop("_bucket")
    return some.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def body(text: str) -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes of the given columns, as ``key_a`` and ``key_b``.

    Rows that agree in all of them share the key, so a repeated row gets the same answer; ids may
    be null or repeat with another text. Nulls are marked, so that they differ from empty values.
    """
    marked = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [
        F.xxhash64(*marked).alias("key_a"),
        F.xxhash64(F.lit("second"), *reversed(marked)).alias("key_b"),
    ]


def documents(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def chosen(docs: DataFrame, decisions: DataFrame, how: str = "left_semi", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose row key is among ``decisions`` (or, with ``left_anti``, is not), all columns as they were.

    Of rows that repeat both id and text one is left.
    """
    a, b = row_key(id_col, text_col)
    keyed = docs.withColumns({"_row_a": a, "_row_b": b})
    keys = decisions.select(F.col("key_a").alias("_row_a"), F.col("key_b").alias("_row_b"))
    return keyed.join(keys, ["_row_a", "_row_b"], how).dropDuplicates(["_row_a", "_row_b"]).drop("_row_a", "_row_b")
