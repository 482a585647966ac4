"""Line dedup with levelled sorted runs of line hashes.

A run is a sorted table ``(line, n_docs)`` in the shared folder. Every batch of documents adds a run
at level 0; ``fanout`` runs of a level are merged into one run of the next, so b batches leave about
fanout * log(b) runs and every entry is rewritten log(b) times. A batch is cleaned by a merge anti
join of its lines with the runs, which are sorted and pre-counted: the texts never meet.

Where lines go by the number of documents in the whole table, a compaction settles the lines that have reached the number: they leave
the runs, and every later batch merge-anti-joins them before it adds its own, so a common line is not carried on. Since a line may
reach the number in the last batch, the documents are cleaned in one final pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.session import prepare, row_key, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"


class LineRuns:
    """Levelled sorted runs of line hashes with the number of documents that hold each.

    settle: lines that a compaction finds in so many documents are set aside, without their number. None settles none.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, settle: int | None = None) -> None:
        self.spark, self.fanout, self.settle = spark, fanout, settle
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []

    def add_new(self, run: DataFrame) -> None:
        """Add what a batch's run has beside the settled lines."""
        for lines in self.settled:
            run = run.join(lines.hint("merge"), "line", "left_anti")
        self.add(stored(run.sortWithinPartitions("line"), "run0") if self.settled else run)

    def add(self, run: DataFrame) -> None:
        """Add a stored, sorted run ``(line, n_docs)`` at level 0; compact the levels that are full."""
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run = stored(merged(self.levels[level]).sortWithinPartitions("line"), f"run{level + 1}")
            if self.settle:
                done = F.col("n_docs") >= self.settle
                self.settled.append(run.where(done).select("line"))
                run = run.where(~done)
            self.levels[level] = []
            level += 1

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def common(self, min_docs: int) -> DataFrame | None:
        """Lines found in at least ``min_docs`` documents so far; None before the first run. Settled lines are among them."""
        if self.settle and min_docs > self.settle:
            raise ValueError("settled lines are no longer counted.")
        runs = self.runs()
        counted = [merged(runs).where(F.col("n_docs") >= min_docs).select("line")] if runs else []
        return reduce(DataFrame.unionAll, [*self.settled, *counted]) if runs or self.settled else None


def merged(runs: list[DataFrame]) -> DataFrame:
    """One run of several: equal lines add their counts."""
    return reduce(DataFrame.unionAll, runs).groupBy("line").agg(F.sum("n_docs").alias("n_docs"))


def line_hashes(text: Column, min_chars: int = 1) -> Column:
    """A hash (128 bits, hexadecimal) for every line of a text; null for keys that are too short.

    A line's key is the line without white space at its ends, A-Z in lower case.
    """

    def key(line: Column) -> Column:
        k = F.btrim(F.translate(line, UPPER, LOWER), F.lit(BLANK))
        return F.when(F.char_length(k) >= min_chars, F.md5(k))

    return F.transform(F.split(text, "\n", -1), key)


def run_of(docs: DataFrame, text_col: str = "text", min_chars: int = 1, by: list[str] | None = None) -> DataFrame:
    """Documents per line hash: every row of ``docs`` is a document and counts a line once."""
    by = by or []
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.explode(F.array_distinct(line_hashes(text, min_chars))).alias("line")
    counted = docs.select(*by, lines).where("line IS NOT NULL").groupBy(*by, "line").agg(F.count(F.lit(1)).alias("n_docs"))
    return counted.sortWithinPartitions(*by, "line")


def without(docs: DataFrame, common: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Merge anti join of the documents' lines with the common ones.

    Only hashes and line numbers are joined; the numbers of the lines that stay then meet their text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("body"), *row_key(id_col, text_col))
    lines = keyed.select("key_a", "key_b", F.posexplode(line_hashes(F.col("body"), min_chars)).alias("place", "line"))
    # A null key (a short line) matches nothing, so it stays.
    stays = lines.join(common, "line", "left_anti").groupBy("key_a", "key_b").agg(F.collect_set("place").alias("places"))
    parts = F.split("body", "\n", -1)
    kept = F.transform(F.array_sort("places"), lambda p: F.element_at(F.col("parts"), p + 1))
    return (
        keyed.withColumn("parts", parts)
        .join(stays, ["key_a", "key_b"], "left")
        .select(
            F.col("id").alias(id_col),
            F.size("parts").cast("long").alias("n_lines"),
            (F.size("parts") - F.when(F.col("places").isNull(), 0).otherwise(F.size("places"))).cast("long").alias("n_dropped"),
            F.coalesce(F.array_join(kept, "\n"), F.lit("")).alias("kept_text"),
        )
    )


def drop_common_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    batches: int = 8,
    fanout: int = 4,
) -> DataFrame:
    """Drop the lines whose key is in at least ``min_docs`` documents, in every document.

    The documents' hashes arrive in ``batches``: each merge-anti-joins the lines settled so far and adds its own as a run, and
    runs are compacted level by level; all documents are then anti-joined with what the runs say. One row per row of ``docs``: the id, ``n_lines``,
    ``n_dropped`` and ``kept_text``. A null or empty text is one empty line, which stays (its key has
    no character). Every row counts as a document, also a repeated one or one without an id. An
    empty table gives an empty table; further columns are not read. Lines are equal when their keys'
    128-bit hashes are.
    """
    spark = prepare(docs.sparkSession)
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64(text_col), F.lit(batches)).cast("int"))
    counts = stored(run_of(dealt.select("batch", text_col), text_col, min_chars, ["batch"]), "lines", ["batch"])
    runs = LineRuns(spark, fanout, settle=min_docs)
    for b in range(batches):
        runs.add_new(counts.where(F.col("batch") == b).select("line", "n_docs"))
    return without(docs, stored(runs.common(min_docs), "common"), id_col, text_col, min_chars)


def dedup_batch(
    runs: LineRuns, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 1, min_chars: int = 1
) -> DataFrame:
    """Clean one arriving batch: lines that at least ``min_docs`` earlier documents hold go.

    The batch merge-anti-joins the runs as they are and then adds its own. Nulls, repeated rows and empty
    tables as in ``drop_common_lines``.
    """
    spark = prepare(docs.sparkSession)
    common = runs.common(min_docs)
    common = spark.createDataFrame([], "line string") if common is None else common
    cleaned = stored(without(docs, common, id_col, text_col, min_chars), "batch")
    runs.add(stored(run_of(docs, text_col, min_chars), "run0"))
    return cleaned
