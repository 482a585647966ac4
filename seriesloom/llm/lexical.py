"""Ranked lexical search by dense blocked matrix products.

Items are dealt to tiles with a compact vocabulary of their own: only terms that an item of the tile has. For a tile of
documents the impacts of these terms are a dense matrix of float64, and one matrix product with the items' weights gives
all scores of the tile. Weights and impacts are integers, and the terms of one product are few enough that no sum can reach
2^53, so every sum is exact; products of further terms are added as 64-bit integers. Each task keeps the k best
documents of every item, ties by id, and these meet in two steps.

Documents are read as text once for each block of items (about ``BLOCK_TERMS`` terms, many thousands of items); what is kept of them
is the number of their terms and the counts of the block's terms. Only a block's own terms come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from seriesloom.llm.flat import LOWER, SpanHash, flat, lists, pieces, same_bytes, words
from seriesloom.llm.line_dedup import LOWER as SMALL
from seriesloom.llm.line_dedup import UPPER
from seriesloom.llm.session import body, discard, leading, prepare, stored

#: (item, term) pairs of a block of items, items and terms of one product, documents of one product.
BLOCK_TERMS, ITEMS, TERMS, DOCUMENTS = 200_000, 32, 2048, 1024

#: Bytes that part terms: ASCII but letters and digits.
APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = APART[128:] = False
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Fixed parts of the score: largest impact, scale of the weights, saturation, share of the length that is not normalised.
IMPACT, SCALE, K1, FLAT = 1_000_000, 1000, 20, 50


def terms_of(text: Column) -> Column:
    """The distinct terms of a text: runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, SMALL), F.lit(TERM), F.lit(0)))


class Vocabulary:
    """The terms of a block of items, found in texts by hash and verified by their bytes."""

    def __init__(self, terms: list[bytes]) -> None:
        self.size = len(terms)
        length = np.array([len(t) for t in terms], np.int64)
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        stop = np.cumsum(length)
        for self.seed in range(100):
            value = SpanHash(self.data, self.seed)(stop - length, stop)
            order = np.argsort(value)
            if not self.size or (np.diff(np.append(value[order], 0)) != 0)[:-1].all():
                break  # no two terms share a hash
        self.value, self.number = value[order], order
        self.start, self.length = (stop - length)[order], length[order]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of all terms per row; row, term and count of the block's terms, ascending."""
        data = LOWER[data]
        start, stop, first = words(data, offsets, APART)
        n = np.diff(first)
        if not self.size or not len(start):
            return n, *(np.zeros(0, np.int64),) * 3
        value = SpanHash(data, self.seed)(start, stop)
        slot = np.minimum(np.searchsorted(self.value, value), self.size - 1)
        hit = np.flatnonzero((self.value[slot] == value) & (self.length[slot] == stop - start))
        slot = slot[hit]
        hit, slot = (x[same_bytes(data, start[hit], self.data, self.start[slot], self.length[slot])] for x in (hit, slot))
        row = np.searchsorted(first, hit, "right") - 1
        key, count = np.unique(row * self.size + self.number[slot], return_counts=True)
        return n, key // self.size, key % self.size, count


def postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary) -> DataFrame:
    """Per row: id, ``n`` (all its terms), ``term`` and ``count`` (those of the vocabulary)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in pieces(offsets):
                n, row, term, times = shared.value.counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = np.searchsorted(row, np.arange(j - i + 1))
                columns = [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), lists(term, at, pa.int32()), lists(times, at, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "term", "count"])

    said = docs.select(F.col(id_col).alias("id"), body(text_col).alias("body"))
    return said.mapInArrow(count, f"id {kind}, n long, term array<int>, count array<int>")


def document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    """Documents per term; one row per term and task meets, and one per term of the block comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for row in found.select("term").mapInArrow(add, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row["term"]] = row["df"]
    return out


def weights_of(frequency: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(SCALE * math.log((2 * documents + 2) / (2 * int(f) + 1))) for f in frequency], np.int64)


def item_tiles(owned: list[np.ndarray], weights: np.ndarray, items: int = ITEMS, terms: int = TERMS) -> list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """``(first item, [(terms, matrix items x terms), ...])`` for every tile of items.

    A tile's vocabulary is compact; it is cut so that no product's partial sums can reach 2^53.
    """
    most = max(1, min(terms, (2**53 - 1) // (IMPACT * max(1, int(weights.max(initial=1))))))
    out = []
    for first in range(0, len(owned), items):
        mine = owned[first : first + items]
        compact = np.unique(np.concatenate(mine)) if mine else np.zeros(0, np.int64)
        parts = []
        for a in range(0, len(compact), most):
            part = compact[a : a + most]
            matrix = np.zeros((len(mine), len(part)))
            for k, own in enumerate(mine):
                has = np.isin(part, own)
                matrix[k, has] = weights[part[has]]
            parts.append((part, matrix))
        out.append((first, parts))
    return out


class Best:
    """The k best documents of every item so far; equal scores by ascending id, nulls last."""

    def __init__(self, items: int, k: int, kind: pa.DataType) -> None:
        self.k = k
        self.least = np.ones(items, np.int64)  # the lowest score that can still enter
        self.kept = [pa.table({"score": pa.array([], pa.int64()), "id": pa.array([], kind)}) for _ in range(items)]

    def add(self, first: int, scores: np.ndarray, ids: pa.Array) -> None:
        """Take the documents of a tile in, scores by item and document. A tie with the last one enters by its id."""
        enters = scores >= self.least[first : first + len(scores), None]
        for k in np.flatnonzero(enters.any(axis=1)):
            at = np.flatnonzero(enters[k])
            more = pa.table({"score": pa.array(scores[k, at]), "id": ids.take(pa.array(at))})
            both = pa.concat_tables([self.kept[first + k], more])
            order = pc.sort_indices(both, sort_keys=[("score", "descending"), ("id", "ascending")], null_placement="at_end")
            kept = both.take(order[: self.k]).combine_chunks()
            self.kept[first + k] = kept
            if kept.num_rows == self.k:
                self.least[first + k] = kept.column("score")[self.k - 1].as_py()


def block_best(
    found: DataFrame, owned: list[np.ndarray], names: list, named: DataType, weights: np.ndarray, total: tuple[int, int], k: int
) -> DataFrame:
    """The k best documents of every item of a block, per task: ``item``, ``id``, ``score``."""
    spark, kind = found.sparkSession, found.schema["id"].dataType
    shared = spark.sparkContext.broadcast((item_tiles(owned, weights), pa.array(names, to_arrow_type(named))))
    size, (documents, terms) = len(weights), total

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, items = shared.value
        best = Best(len(items), k, to_arrow_type(kind))
        column = np.full(size, -1, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(i, DOCUMENTS)
                term, count = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                length = part.column(2).value_lengths().to_numpy()
                doc = np.repeat(np.arange(part.num_rows), length)
                # Python integers: the product may pass 64 bits.
                long = {n: 100 - FLAT + (FLAT * n * documents) // terms if terms else 0 for n in set(part.column(1).to_pylist())}
                norm = np.array([long[n] for n in part.column(1).to_pylist()], np.int64)
                impact = (1000 * IMPACT * count) // (1000 * count + K1 * norm[doc])
                for first, parts in tiles:
                    scores = 0
                    for compact, matrix in parts:
                        column[compact] = np.arange(len(compact))
                        place = column[term]
                        column[compact] = -1
                        mine = place >= 0
                        dense = np.zeros((len(compact), part.num_rows))
                        dense[place[mine], doc[mine]] = impact[mine]
                        scores = scores + np.rint(matrix @ dense).astype(np.int64)
                    if parts:
                        best.add(first, scores, part.column(0))
        for item, kept in zip(items, best.kept):
            if kept.num_rows:
                owner = pa.array([item.as_py()] * kept.num_rows, items.type)
                yield from pa.table({"item": owner, "id": kept.column("id"), "score": kept.column("score")}).to_batches()

    return found.mapInArrow(search, f"item {named.simpleString()}, id {kind.simpleString()}, score long")


def ranked(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 50,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``k`` best documents for every item: item, ``rank`` (from 1), id and ``score`` (above 0).

    A term's weight falls with the number of documents that hold it, its impact rises with its occurrences and falls with
    the document's length; all in integers, so results do not depend on the order of work. Every term of an item counts
    once; items are named by their id, so rows that share an id are one item with the terms of all. Equal scores rank by
    ascending id, null ids last. Every row of ``docs`` is a document, repeated ones too. Null and empty texts, and texts
    without a term, have no score and do not count as documents; items without terms have no rows; either
    table may be empty; further columns are not read.
    """
    spark = prepare(docs.sparkSession)
    named = items.schema[item_col].dataType
    said = items.select(F.col(item_col).alias("item"), F.explode(terms_of(F.col(item_text_col))).alias("term")).distinct()
    said = stored(said, "items")
    blocks = -(-said.count() // block_terms)
    found, total = [], None
    for b in range(blocks):
        mine = said.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).groupBy("item").agg(F.collect_list("term").alias("terms"))
        rows = mine.collect()
        numbers = {t: n for n, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
        owned = [np.unique([numbers[t] for t in r["terms"]]) for r in rows]
        counted = stored(postings(docs, id_col, text_col, Vocabulary([t.encode() for t in numbers])), "postings")
        if total is None:
            sums = counted.where("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
            total = sums["documents"], sums["terms"] or 0
        weights = weights_of(document_frequencies(counted, len(numbers)), total[0])
        best = block_best(counted, owned, [r["item"] for r in rows], named, weights, total, k)
        found.append(stored(best, "best"))
        discard(counted)
    kind = docs.schema[id_col].dataType.simpleString()
    every = reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], f"item {named.simpleString()}, id {kind}, score long")
    first = leading(every, ["item"], [F.desc("score"), F.asc_nulls_last("id")], k)
    return first.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
