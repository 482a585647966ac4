"""Phrase collocations by set-oriented relational mining.

The occurrences of all phrases of one length are a relation, sorted by piece and position and written to the shared
folder. Joining it with itself where one occurrence begins a word after the other (a merge join, as both sides are sorted) gives
the occurrences that are one word longer; a group-count finds the frequent phrases, and a semi-join with these thins the
relation before it is extended again.

The relation is kept in blocks of about ``BLOCK_BYTES`` of text: a row holds the sorted places of a block, the number of the
phrase at each, and the block's own list of distinct phrases with their counts. Only these lists are counted, joined and
shuffled row by row, so a phrase as common as a third of all words is one row per block, and no group grows with the
number of its occurrences. Phrases of length k + 1 are named by the two phrases of length k they begin and end with.

A task has one block in memory at a time, however many it has to do: a block's text is looked up and hashed in stretches
of ``STRETCH_BYTES``, and each block is a row group of its own in the written relation.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.flat import LOWER, SpanHash, flat, mix, same_bytes, words
from seriesloom.llm.session import body, discard, leading, prepare, stored

BLOCK_BYTES = 4_000_000
STRETCH_BYTES = 250_000

#: Frequent phrases for each partition up to which they are hashed; a hash table cannot spill, so more are merged.
HASHED_ROWS = 1_000_000

#: What parts pieces, and what parts the words of a piece as well.
PART = np.zeros(256, bool)
PART[[ord(c) for c in ".,;:!?"]] = PART[10:14] = True
APART = PART.copy()
APART[[9, 32]] = True

UNKNOWN = "und"


def looked_up(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """``table[data]`` for a table of 256 bytes or flags, without the index of eight times the data that numpy makes."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def give_back() -> None:
    """Return freed memory to the system; the C library would keep it for the worker, also while that waits between stages."""
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def block_ends(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``most`` bytes, cut only between rows or pieces; a longer piece is a block of its own."""
    border = np.append(False, looked_up(PART, data))
    border[offsets[1:]] = True
    borders = np.flatnonzero(border)
    a = 0
    while a < len(data):
        k = int(np.searchsorted(borders, a + most, "right")) - 1
        b = int(borders[k]) if k >= 0 and borders[k] > a else int(borders[k + 1])
        yield a, b
        a = b


def block_words(text: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and hashes of the words of a block, stretch by stretch."""
    found = []
    for a, b in block_ends(text, edges, STRETCH_BYTES):
        i, j = np.searchsorted(edges, (a, b))
        start, stop, _ = words(text[a:b], edges[i:j] - a, APART)
        found.append((start + a, stop + a, SpanHash(text[a:b])(start, stop)))
    start, stop, value = (np.concatenate(x) for x in zip(*found))
    return start, stop, value


def strings(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The spans as an Arrow column of strings, checked to be UTF-8."""
    ends = np.cumsum(stop - start)
    taken = data[np.repeat(stop - ends, stop - start) + np.arange(ends[-1])]
    column = pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.append(0, ends).astype("<i4")), pa.py_buffer(taken))
    column.validate(full=True)
    return column


def same_spans(data: np.ndarray, start: np.ndarray, stop: np.ndarray, code: np.ndarray, mine: np.ndarray, like: np.ndarray) -> bool:
    """Whether the spans numbered ``mine`` equal those numbered ``like``, one by one."""
    length = stop[mine] - start[mine]
    same = (length == stop[like] - start[like]) & (code[mine] == code[like])
    return bool(same.all() and same_bytes(data, start[mine], data, start[like], length).all())


def distinct_spans(
    data: np.ndarray, start: np.ndarray, stop: np.ndarray, code: np.ndarray, value: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """One span of every distinct (bytes, code), and the number of the distinct one for each span; hashes are verified.

    value: the spans' hashes, where they are known.
    """
    value = (SpanHash(data)(start, stop) if value is None else value) ^ mix(code.astype(np.uint64) + np.uint64(1))
    _, one, inverse = np.unique(value, return_index=True, return_inverse=True)
    del value
    each = np.array_split(np.arange(len(start)), 1 + len(data) // STRETCH_BYTES // 4)
    if all(same_spans(data, start, stop, code, mine, one[inverse[mine]]) for mine in each):
        return one, inverse
    known: dict[tuple[int, bytes], int] = {}  # two words share a hash: name them by their bytes
    for k, (c, a, b) in enumerate(zip(code.tolist(), start.tolist(), stop.tolist())):
        known.setdefault((c, data[a:b].tobytes()), k)
    first = {k: n for n, k in enumerate(known.values())}
    inverse = np.array([first[known[c, data[a:b].tobytes()]] for c, a, b in zip(code.tolist(), start.tolist(), stop.tolist())])
    return np.array(list(known.values())), inverse


def block_row(block: int, place: np.ndarray, item: np.ndarray, a: pa.Array, b: pa.Array, n: np.ndarray) -> list[pa.Array]:
    """One row of the relation: steps between sorted places, the phrase at each, and the distinct phrases with counts."""
    steps = np.diff(place, prepend=0).astype("<i4").tobytes()
    entries = pa.StructArray.from_arrays([a, b, pa.array(n.astype(np.int64))], ["a", "b", "n"])
    return [
        pa.array([block], pa.int64()),
        pa.array([steps], pa.binary()),
        pa.array([item.astype("<i4").tobytes()], pa.binary()),
        pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries),
    ]


COLUMNS = ["block", "place", "item", "entries"]


def word_row(
    block: int, data: np.ndarray, offsets: np.ndarray, a: int, b: int, codes: np.ndarray, langs: pa.Array
) -> list[pa.Array] | None:
    """The row of the words in bytes ``a`` to ``b``, None if there are none; what it needs meanwhile ends with the call."""
    text = looked_up(LOWER, data[a:b])
    start, stop, value = block_words(text, np.clip(offsets, a, b) - a)
    if not len(start):
        return None
    row = np.searchsorted(offsets, start + a, "right") - 1
    piece = np.searchsorted(np.flatnonzero(looked_up(PART, text)), start)
    place = np.append(0, np.cumsum((piece[1:] != piece[:-1]) | (row[1:] != row[:-1]))) + np.arange(len(start))
    code = codes[row]
    del row, piece
    one, item = distinct_spans(text, start, stop, code, value)
    return block_row(block, place, item, langs.take(pa.array(code[one])), strings(text, start[one], stop[one]), np.bincount(item))


def word_relation(docs: DataFrame, text_col: str, lang_col: str, block_bytes: int) -> DataFrame:
    """The occurrences of all words: ``block``, ``place``, ``item`` and ``entries`` of (language, word, count).

    Words of a piece have successive places; between two pieces one place is left out.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = flat(batch.column(0))
            named = batch.column(1).dictionary_encode()
            codes = named.indices.to_numpy(zero_copy_only=False)
            for a, b in block_ends(data, offsets, block_bytes):
                row = word_row(block, data, offsets, a, b, codes, named.dictionary)
                if row is not None:
                    yield pa.RecordBatch.from_arrays(row, COLUMNS)
                    block += 1
                row = None
            give_back()

    said = docs.select(body(text_col).alias("body"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    return said.mapInArrow(split, "block long, place binary, item binary, entries array<struct<a:string,b:string,n:bigint>>")


def blocks_stored(relation: DataFrame, name: str) -> DataFrame:
    """``stored`` for blocks: few, large values per row, so they are worth a stronger codec.

    Each block is a row group. By default Parquet counts 100 rows before it looks at their bytes, and then its writer and
    reader hold all of a task's blocks at once.
    """
    return stored(relation, name, codec="zstd", options={"parquet.block.row.count.limit": 1})


def frequent(relation: DataFrame, least: int) -> DataFrame:
    """Group-count: phrases with at least ``least`` occurrences, each with a number of its own."""
    counted = relation.select(F.explode("entries").alias("e")).groupBy("e.a", "e.b").agg(F.sum("e.n").alias("n"))
    return stored(counted.where(F.col("n") >= least).withColumn("id", F.monotonically_increasing_id()), "frequent")


def extended(relation: DataFrame, kept: DataFrame) -> DataFrame:
    """Occurrences that are one word longer, of those whose phrase is among ``kept``.

    The semi-join meets the blocks' lists of phrases; each block then gets the numbers of its frequent phrases and
    merge-joins what is left of it by adjacent places.
    """
    listed = relation.select("block", F.posexplode("entries").alias("item", "e")).select("block", "item", "e.a", "e.b")
    # Both sides grow with the corpus and are shuffled, never broadcast. A phrase is listed once and is in the lists of many
    # blocks, so these need no sorting: a partition's frequent phrases are hashed, unless there are too many for its memory.
    partitions = int(relation.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    how = "shuffle_hash" if kept.count() <= HASHED_ROWS * partitions else "merge"
    wanted = listed.join(kept.select("a", "b", "id").hint(how), ["a", "b"]).select(F.col("block").alias("home"), "item", "id")

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for r in range(left.num_rows if right.num_rows else 0):
            place = np.cumsum(np.frombuffer(left.column("place")[r].as_py(), "<i4").astype(np.int64))
            item = np.frombuffer(left.column("item")[r].as_py(), "<i4")
            number = np.full(int(item.max()) + 1, -1, np.int64)
            number[right.column("item").to_numpy()] = np.arange(right.num_rows)
            mine = number[item]
            place, mine = place[mine >= 0], mine[mine >= 0]
            # Sorted by place, each place once: the occurrence a word later is the next one or none.
            at = np.flatnonzero(np.diff(place) == 1)
            if not len(at):
                continue
            pair = mine[at] * right.num_rows + mine[at + 1]
            found, longer, n = np.unique(pair, return_inverse=True, return_counts=True)
            ids = right.column("id").to_numpy()
            a, b = (pa.array(ids[k]) for k in (found // right.num_rows, found % right.num_rows))
            rows.append(block_row(left.column("block")[r].as_py(), place[at], longer, a, b, n))
            del place, item, number, mine, at, pair, found, longer, n, ids
        batches = [pa.RecordBatch.from_arrays(row, COLUMNS) for row in rows]
        give_back()
        return pa.Table.from_batches(batches, LONGER)

    both = relation.select("block", "place", "item").groupBy("block").cogroup(wanted.groupBy("home"))
    return both.applyInArrow(extend, "block long, place binary, item binary, entries array<struct<a:bigint,b:bigint,n:bigint>>")


_entry = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
LONGER = pa.schema([("block", pa.int64()), ("place", pa.binary()), ("item", pa.binary()), ("entries", pa.list_(_entry))])


def named(kept: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases of one more word: language, text, last word, and the counts of all their beginnings and ends.

    heads: counts of the first 1, 2, … words; tails: counts of the last 1, 2, … words.
    """
    p = shorter.select(F.col("id").alias("a"), "lang", "phrase", F.array_append("heads", F.col("n")).alias("heads"))
    q = shorter.select(F.col("id").alias("b"), "last", F.array_append("tails", F.col("n")).alias("tails"))
    both = kept.join(p.hint("merge"), "a").join(q.hint("merge"), "b")
    phrase = F.concat_ws(" ", "phrase", "last").alias("phrase")
    return stored(both.select("id", "a", "b", "lang", phrase, "last", "n", "heads", "tails"), "phrases")


def weakest_cut() -> Column:
    """The lowest score over all cuts of a phrase, the smallest cut among equals: ``struct<score, k, l, r>``.

    Exact: the squared count and the product of both parts' counts are decimals of 38 digits (counts below 10^15).
    """
    cut = (
        "struct(cast((cast(1000000 as decimal(7,0)) * cast(n as decimal(15,0)) * cast(n as decimal(15,0)))"
        " div (cast(heads[k - 1] as decimal(15,0)) * cast(tails[size(heads) - k] as decimal(15,0))) as bigint) as score,"
        " k, heads[k - 1] as l, tails[size(heads) - k] as r)"
    )
    return F.expr(f"array_min(transform(sequence(1, size(heads)), k -> {cut}))")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = 3,
    least: int = 10,
    inside: int = 50,
    top: int = 2000,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words per language whose parts belong together most.

    Texts are lower-cased (A-Z), split at ``. , ; : ! ?`` and line ends into pieces and these at spaces and tabs into words. A
    phrase counts with all its occurrences within pieces, overlapping ones too; from ``least`` on it is a candidate. Its score is
    the lowest ``floor(10^6 a^2 / (l r))`` over its cuts in two parts with counts l and r (the first such cut among
    equals). Candidates inside a longer candidate, dropped or not, that has at least ``inside`` % of their occurrences are
    dropped; looking one word further is enough, since a phrase in between occurs at least as often as the longest.

    Columns: lang, rank (from 1; by score and count descending, then by phrase in byte order), phrase (joined by spaces), a, l, r,
    n (all words of the language) and score. A null language is ``und``; null, empty and blank texts have no words;
    every row counts, repeated ones too; ids play no part; an empty table gives an empty table; further columns are not read.
    Texts of any length count whole; a task holds a block of text, or its longest piece.
    """
    spark = prepare(docs.sparkSession)
    relation = blocks_stored(word_relation(docs, text_col, lang_col, block_bytes), "words")
    totals = stored(relation.select(F.explode("entries").alias("e")).groupBy("e.a").agg(F.sum("e.n").alias("n")), "totals")
    kept = frequent(relation, least)
    none = F.array().cast("array<bigint>")
    phrases = kept.select(
        "id", F.col("a").alias("lang"), F.col("b").alias("phrase"), F.col("b").alias("last"), "n", none.alias("heads"), none.alias("tails")
    )
    candidates: list[DataFrame] = []
    for size in range(2, longest + 1):
        longer = extended(relation, kept)
        longer = blocks_stored(longer if size < longest else longer.select("entries"), f"length{size}")
        discard(relation)
        relation, kept = longer, frequent(longer, least)
        phrases = named(kept, phrases)
        candidates.append(phrases)
    discard(relation)
    left = []
    for found, longer in zip(candidates, [*candidates[1:], None]):
        if longer is not None:
            around = longer.select(F.col("a").alias("id"), F.col("n").alias("more")).union(longer.select("b", "n"))
            around = around.groupBy("id").agg(F.max("more").alias("more")).hint("merge")
            found = found.join(around, "id", "left").where(F.expr(f"more is null or 100 * more < {inside} * n"))
        left.append(found.select("lang", "phrase", F.col("n").alias("a"), weakest_cut().alias("cut")))
    scored = reduce(DataFrame.unionAll, left) if left else spark.createDataFrame([], "lang string, phrase string, a long, cut struct<score:long,l:long,r:long>")
    flat_ = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = leading(flat_, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.join(totals.withColumnRenamed("a", "lang"), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
