"""Exact dedup by recipes of content-defined chunks.

A text is cut where a rolling sum of its last 32 bytes says so, so equal stretches are cut alike. Each
chunk gets a 128-bit identifier; chunks that share one are compared byte by byte (smallest and largest
content per identifier), and only then does the identifier stand for its content. Texts are equal when
their ordered lists of identifiers are. Contents move once, to be verified, and copies within a
task are merged before that; everything after moves recipes of some dozen bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.flat import BYTE_VALUE, flat, pieces
from seriesloom.llm.session import body, prepare, row_key, stored

WINDOW = 32


def cuts(data: np.ndarray, offsets: np.ndarray, average: int = 4096, least: int = 1024, most: int = 65_536) -> list[list[int]]:
    """Ends of the chunks of every text; an empty text has none.

    A cut falls after a byte whose rolling sum is a multiple of ``average`` (a power of two) in its upper bits, at
    least ``least`` and at most ``most`` bytes after the last one.
    """
    roll = BYTE_VALUE[data] >> np.uint64(32)
    step = 1
    while step < WINDOW:  # sums over 2, 4, ... 32 bytes, each byte weighted by its age
        older = np.zeros_like(roll)
        older[step:] = roll[:-step]
        roll = roll + (older << np.uint64(step))
        step *= 2
    bits = np.uint64(average.bit_length() - 1)
    marks = np.flatnonzero((roll >> (np.uint64(32) - bits) & np.uint64(average - 1)) == 0) + 1
    bounds = np.searchsorted(marks, offsets)
    out = []
    for i, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        ends, at = [], begin
        # The window reaches back over the text's begin only within its first WINDOW bytes: never cut there.
        for m in marks[bounds[i] : bounds[i + 1]].tolist() if end - begin > least else ():
            while m - at > most:
                at += most
                ends.append(at)
            if m - at >= max(least, WINDOW) and m < end:
                ends.append(m)
                at = m
        while end - at > most:
            at += most
            ends.append(at)
        if end > at:
            ends.append(end)
        out.append(ends)
    return out


def _chunks(column: pa.Array, digest_bytes: int, sizes: dict) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """Row number, identifiers and contents of every text of a batch."""
    data, offsets = flat(column)
    for i, j in pieces(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        for k, ends in enumerate(cuts(part, at, **sizes)):
            begins = [int(at[k]), *ends[:-1]] if ends else []
            contents = [part[a:b].tobytes() for a, b in zip(begins, ends)]
            yield i + k, [hashlib.blake2b(c, digest_size=digest_bytes).digest() for c in contents], contents


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 16, sizes: dict | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, row key, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Of equal texts the row with the largest id stays. A null text equals an empty one. Rows that repeat
    both id and text are ``kept`` together; ids that are null come after all others, and if a group
    has no other, ``keep_id`` is null and its rows are kept. Texts of any length are compared
    whole. An empty table gives an empty table; further columns are not read.

    digest_bytes, sizes: length of the identifiers and the chunk sizes (``average``, ``least``, ``most``).
    Short identifiers collide; the verification finds that and tells such contents apart, so
    the result stays exact.
    """
    prepare(docs.sparkSession)
    sizes = sizes or {}
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), body(text_col).alias("body"))

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [b"".join(ids) for _, ids, _ in _chunks(batch.column(4), digest_bytes, sizes)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(rows, pa.binary())], ["id", "key_a", "key_b", "text_sha256", "recipe"]
            )

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows: list[list] = [[], [], [], [], []]
            held = 0
            for row, ids, chunks in _chunks(batch.column(2), digest_bytes, sizes):
                for place, (key, chunk) in enumerate(zip(ids, chunks)):
                    for out, value in zip(rows, (a[row], b[row], place, key, chunk)):
                        out.append(value)
                    held += len(chunk)
                if held > 4_000_000:
                    yield _chunk_batch(rows)
                    rows, held = [[], [], [], [], []], 0
            if rows[0]:
                yield _chunk_batch(rows)

    hashed = keyed.select("id", "key_a", "key_b", F.sha2("body", 256).alias("text_sha256"), "body")
    recipe = stored(
        hashed.mapInArrow(recipes, f"id {kind}, key_a long, key_b long, text_sha256 string, recipe binary"), "recipes"
    )
    chunks = keyed.select("key_a", "key_b", "body").mapInArrow(
        contents, "key_a long, key_b long, place int, identifier binary, content binary"
    )
    spread = chunks.groupBy("identifier").agg(F.min("content").alias("low"), F.max("content").alias("high"))
    clashes = stored(spread.where("low <> high").select("identifier"), "clashes")
    if not clashes.isEmpty():
        recipe = _told_apart(recipe, chunks, clashes)
    groups = recipe.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    several = stored(groups.where("group_size > 1"), "groups")
    joined = recipe.join(several, "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col),
        "key_a",
        "key_b",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def _chunk_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    names = ["key_a", "key_b", "place", "identifier", "content"]
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names)


def _told_apart(recipe: DataFrame, chunks: DataFrame, clashes: DataFrame) -> DataFrame:
    """Recipes in which identifiers of several contents are followed by a digest that tells these apart."""
    unclear = chunks.join(clashes, "identifier", "left_semi")
    note = F.concat_ws(":", "place", F.sha2("content", 512))
    notes = unclear.groupBy("key_a", "key_b").agg(F.array_join(F.sort_array(F.collect_set(note)), ",").alias("notes"))
    told = recipe.join(notes, ["key_a", "key_b"], "left")
    return told.withColumn("recipe", F.concat("recipe", F.coalesce("notes", F.lit("")).cast("binary"))).drop("notes")
