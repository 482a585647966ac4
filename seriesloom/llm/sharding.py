"""Shards of near equal size by sampled splitters.

Records are ordered by the digest of their text, so equal texts stand together. Keys are sampled with a chance in
proportion to the record's size; quantiles of the sample are the splitters that deal the records to ranges. The ranges' exact
sizes are then summed: a range that turned out overfull is sampled again and subdivided, inside one text by
the digest of the id, until every range fits a task. With the exact size in front of each range, running sums inside the ranges
give every record its place in the whole order, and shards are cut from that.

A group of equal texts goes to the shard that holds its middle, as a whole, if it is small against a shard; a larger
one is cut wherever a border falls.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from seriesloom.llm.session import discard, prepare, stored

#: Sampled keys per range in the mean; a range of more than ``OVERFULL`` times its due size, and of more than one record, is subdivided.
POINTS, OVERFULL = 32, 3
#: Characters of a text's digest, which come first in a key; a character behind all hexadecimal ones.
DIGEST, BEHIND = 32, "g"


def keyed(docs: DataFrame, id_col: str, text_col: str, number: Column) -> DataFrame:
    """Id, number, size, checksum of the text, and a key of its own for every record: digests of text and id, then the number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    records = docs.select(
        F.col(id_col).alias("id"),
        number.alias("number"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.concat(F.md5(text.cast("binary")), own).alias("key"),
    )
    return records.withColumn("key", F.concat("key", F.lpad(F.hex("number"), 16, "0")))


def ranges_of(splitters: list[str]):
    """The range of a key: how many splitters are not above it. Splitters are ascending; range k begins at splitter k - 1."""
    table = np.array(splitters, "S80")

    @F.arrow_udf("int")
    def place(key: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(table, key.to_numpy(zero_copy_only=False).astype("S80"), "right").astype(np.int32))

    return place(F.col("key")) if splitters else F.lit(0)


def sample_points(size: Column, due: float, seed: int) -> Column:
    """How many sample points a record holds: one per ``due`` bytes in the mean, in proportion to its size."""
    chance = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(size / F.lit(due) + chance)


def quantiles(points: list[tuple[str, int]], parts: int) -> list[str]:
    """The ``parts - 1`` keys that part the sampled points, ascending by key, into equal numbers; repeated ones once."""
    keys = [k for k, _ in points]
    upto = np.cumsum([n for _, n in points])
    if not len(upto):
        return []
    wanted = upto[-1] * np.arange(1, parts) / parts
    return sorted({keys[k] for k in np.searchsorted(upto, wanted, "right")})


def splitters_for(records: DataFrame, parts: int, points: int = POINTS, overfull: float = OVERFULL) -> tuple[list[str], list[Row]]:
    """Splitters so that no range is overfull, and of every range that has records: range, rows, bytes, lowest and highest key.

    At most about ``points * parts`` sampled keys and a few times ``parts`` splitters and sizes come to the driver, however many records
    there are. The first splitters are bare digests of texts, so they part no group of equal texts.
    """
    total = records.agg(F.sum("size").alias("size")).first()["size"] or 0
    due = max(1.0, total / parts)

    def sampled(some: DataFrame, seed: int, width: int) -> list[Row]:
        drawn = some.withColumn("points", sample_points(F.col("size"), due / points, seed)).where("points > 0")
        drawn = drawn.groupBy("range", F.substring("key", 1, width).alias("key")).agg(F.sum("points").alias("points"))
        return sorted(drawn.collect(), key=lambda r: r["key"])

    first = sampled(records.withColumn("range", F.lit(0)), 0, DIGEST)
    splitters = quantiles([(r["key"], r["points"]) for r in first], parts)
    seed = 0
    while True:
        seed += 1
        placed = records.withColumn("range", ranges_of(splitters))
        sums = placed.groupBy("range").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        held = sorted(sums.collect(), key=lambda r: r["range"])
        much = [r for r in held if r["rows"] > 1 and r["bytes"] > overfull * due]
        if not much:
            return splitters, held
        more: set[str] = set()
        # A range of several texts is parted between texts, one of a single text by the ids.
        for width, some in ((80, [r for r in much if _text(r["low"]) == _text(r["high"])]), (DIGEST, [r for r in much if _text(r["low"]) != _text(r["high"])])):
            inside = sampled(placed.where(F.col("range").isin([r["range"] for r in some])), seed, width) if some else []
            for r in some:
                mine = [(x["key"], x["points"]) for x in inside if x["range"] == r["range"]]
                more |= set(quantiles(mine, int(r["bytes"] // due) + 2))
                if width == DIGEST:  # its most common text may fill it: part it from what comes before and behind
                    heavy = max(mine, key=lambda p: p[1])[0] if mine else _text(r["low"])
                    more |= {heavy, heavy + BEHIND}
                else:
                    more.add(r["high"])
        splitters = sorted({*splitters, *more})


def _text(key: str) -> str:
    return key[:DIGEST]


def _decided(docs: DataFrame, number: Column, count: int, id_col: str, text_col: str, slack: float, ranges: int | None) -> DataFrame:
    """Id, number, size, checksum, shard and slot of every row."""
    spark = prepare(docs.sparkSession)
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = stored(keyed(docs, id_col, text_col, number), "records")
    splitters, held = splitters_for(records, parts)
    total = max(1, sum(r["bytes"] for r in held))
    # Rows and bytes in front of every range, and of texts that fill several ranges where they start and what they hold in all.
    fronts, filled, rows, bytes_ = [], {}, 0, 0
    for r in held:
        fronts.append((r["range"], rows, bytes_))
        if _text(r["low"]) == _text(r["high"]):
            start, had = filled.get(_text(r["low"]), (bytes_, 0))
            filled[_text(r["low"])] = start, had + r["bytes"]
        rows, bytes_ = rows + r["rows"], bytes_ + r["bytes"]
    fronts = spark.createDataFrame(fronts, "range int, rows long, bytes long")
    filled = spark.createDataFrame([(t, *x) for t, x in filled.items()], "text string, from long, full long")
    placed = records.withColumn("range", ranges_of(splitters)).withColumn("text", F.substring("key", 1, DIGEST))
    # Both tables have at most a row per range, and there are a few times ``parts`` ranges.
    placed = placed.join(F.broadcast(fronts), "range").join(F.broadcast(filled), "text", "left")
    order = Window.partitionBy("range").orderBy("key")
    group = Window.partitionBy("range", "text")
    summed = placed.withColumns(
        {
            "before": F.col("bytes") + F.sum("size").over(order) - F.col("size"),
            "spot": F.col("rows") + F.row_number().over(order) - 1,
        }
    ).withColumns({"start": F.coalesce("from", F.min("before").over(group)), "all": F.coalesce("full", F.sum("size").over(group))})
    whole = F.col("all") * F.lit(count) <= F.lit(float(slack * total))
    twice = F.when(whole, 2 * F.col("start") + F.col("all")).otherwise(2 * F.col("before") + F.col("size"))
    shard = F.expr(f"least({count - 1}, (twice * {count}) div {2 * total})").cast("int")
    dealt = summed.withColumn("twice", twice).select("id", "number", "size", "crc", "spot", shard.alias("shard"))
    dealt = stored(dealt, "dealt")
    discard(records)
    counted = {r["shard"]: r["n"] for r in dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    ahead = F.array(*[F.lit(sum(counted.get(j, 0) for j in range(k))).cast("long") for k in range(count)])
    return dealt.withColumn("slot", F.col("spot") - F.element_at(ahead, F.col("shard") + 1)).drop("spot")


def shards(
    docs: DataFrame, count: int = 8, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.02, ranges: int | None = None
) -> DataFrame:
    """Put every row into one of ``count`` shards with near equal bytes.

    A record's size is the UTF-8 length of its text (null: empty) plus 1. Columns: id, ``size``, ``text_crc32``, ``law`` (``bytes``),
    ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (null: shards follow the bytes of all records, not
    the id). Rows with equal texts share a shard if together they have at most ``slack`` of its size, and else are cut where a
    border falls; so a shard is off its due size by at most ``slack`` of it, or by one longer record. Null and repeated ids and
    repeated rows are records like any other; an empty table gives an empty table; further columns are not read.
    ranges: how many ranges the records are dealt to, one task each; the session's shuffle partitions if None. The result does
    not depend on it, nor on the sample.
    """
    dealt = _decided(docs, F.monotonically_increasing_id(), count, id_col, text_col, slack, ranges)
    return dealt.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(
    docs: DataFrame,
    path: str,
    count: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    slack: float = 0.02,
    ranges: int | None = None,
    files: int = 1,
) -> DataFrame:
    """Write the whole rows of ``docs`` to ``path``, a folder per shard (``shard=0`` on), and return what was written.

    All columns stay, ``shard`` and ``slot`` are added (or replaced). Rows are numbered in a stored copy first, so that each meets its own
    decision whatever it repeats. A shard is written by ``files`` tasks, each with an equal run of its slots in order.
    """
    number = "_number"
    while number in docs.columns:
        number += "_"
    copy = stored(prepare(docs.sparkSession) and docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    told = _decided(copy, F.col(number), count, id_col, text_col, slack, ranges)
    sizes = told.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))  # a row per shard
    told = told.join(F.broadcast(sizes), "shard").select(
        F.col("number").alias(number), "shard", "slot", F.floor(F.col("slot") * files / F.col("n")).alias("_file")
    )
    rows = copy.drop("shard", "slot").join(told.hint("merge"), number).drop(number)
    dealt = rows.repartition(count * files, "shard", "_file").sortWithinPartitions("shard", "slot").drop("_file")
    dealt.write.partitionBy("shard").parquet(path)
    discard(copy)
    return docs.sparkSession.read.parquet(path)
