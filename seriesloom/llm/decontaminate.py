"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on shared runs of words (seeds). For a pair whose seeds could cover
enough of the item, the longest common runs of unmarked words are found by running Karp-Rabin hashes and
marked, again and again, until none of the least length is left. The share of the item's words under
tiles is the coverage; since tiles may come in any order, reordered passages count in full.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.flat import flat, grams, pieces, word_hashes
from seriesloom.llm.session import body, prepare, row_key

#: Fixed modulus and base of the running hash.
PRIME, ROLL = (1 << 61) - 1, 1_000_003


def running(words: list[int], marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """Start and hash of every window of ``size`` unmarked words, each from the one before."""
    high = pow(ROLL, size, PRIME)
    value = length = 0
    for end, word in enumerate(words):
        if marked[end]:
            value = length = 0
            continue
        value, length = (value * ROLL + word) % PRIME, length + 1
        if length > size:
            value = (value - words[end - size] * high) % PRIME
            length = size
        if length == size:
            yield end - size + 1, value


def matches(item: list[int], text: list[int], item_marked: list[bool], text_marked: list[bool], size: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of at least ``size`` unmarked words: ``(length, in item, in text)``."""
    at = defaultdict(list)
    for start, value in running(text, text_marked, size):
        at[value].append(start)
    found = []
    for p, value in running(item, item_marked, size):
        for t in at.get(value, ()):
            before = p > 0 and t > 0 and item[p - 1] == text[t - 1] and not item_marked[p - 1] and not text_marked[t - 1]
            if before:
                continue  # part of the longer run that began earlier
            n = 0
            while (
                p + n < len(item)
                and t + n < len(text)
                and item[p + n] == text[t + n]
                and not item_marked[p + n]
                and not text_marked[t + n]
            ):
                n += 1
            if n >= size:
                found.append((n, p, t))
    return found


def tiles(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word sequences: ``(length, in item, in text)`` in the order they were marked.

    The search starts with long windows and halves their size; a match of more than twice the size starts
    over with its own length, so longer matches are always marked before shorter ones. Among
    equally long ones the first in the item, then in the text, is marked.
    """
    item_marked, text_marked = [False] * len(item), [False] * len(text)
    size, out = max(least, len(item)), []
    while True:
        found = matches(item, text, item_marked, text_marked, size)
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        while found:
            n = max(n for n, _, _ in found)
            for _, p, t in sorted(f for f in found if f[0] == n):
                if not any(item_marked[p : p + n]) and not any(text_marked[t : t + n]):
                    item_marked[p : p + n] = text_marked[t : t + n] = [True] * n
                    out.append((n, p, t))
            # Marks cut the remaining matches; what is left of them is found anew.
            found = matches(item, text, item_marked, text_marked, size) if any(f[0] < n for f in found) or len(found) > 1 else []
        if size <= least:
            return out
        size = max(least, size // 2)


class Benchmark:
    """The words of a block of benchmark items and the index of their seeds."""

    def __init__(self, ids: list, texts: list[str], least: int) -> None:
        raw = [t.encode() for t in texts]
        offsets = np.append(0, np.cumsum([len(t) for t in raw])).astype(np.int64)
        word, self.first = word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)
        self.ids, self.least, self.words = ids, least, word
        self.sizes = np.diff(self.first)
        seeds = []
        # Items with fewer words than a seed are looked up by runs of their own length.
        for size in sorted({least, *self.sizes[(self.sizes > 0) & (self.sizes < least)].tolist()}):
            value, row, begin = grams(word, self.first, size, whole=False)
            mine = (self.sizes[row] >= least) if size == least else (self.sizes[row] == size)
            value, row, begin = value[mine], row[mine], begin[mine]
            order = np.argsort(value, kind="stable")
            seeds.append((size, value[order], row[order], (begin - self.first[row])[order]))
        self.seeds = seeds

    def pairs(self, word: np.ndarray, first: np.ndarray, coverage: float) -> list[tuple[int, int, int, int]]:
        """``(row, item, tiles, covered words)`` of all pairs that reach the coverage."""
        held: dict[tuple[int, int], tuple[set, list]] = defaultdict(lambda: (set(), []))
        for size, value, item, place in self.seeds:
            if not len(value):
                continue
            seen, row, begin = grams(word, first, size, whole=False)
            low = np.searchsorted(value, seen)
            hit = np.flatnonzero(value[np.minimum(low, len(value) - 1)] == seen)
            high = np.searchsorted(value, seen[hit], "right")
            for h, a, b in zip(hit.tolist(), low[hit].tolist(), high.tolist()):
                for k in range(a, b):
                    covered, begins = held[int(row[h]), int(item[k])]
                    covered.update(range(int(place[k]), int(place[k]) + size))
                    begins.append(int(begin[h]))
        out = []
        for (row, item), (covered, begins) in held.items():
            n = int(self.sizes[item])
            if len(covered) < coverage * n:  # no tiling can cover more than the seeds do
                continue
            least = min(self.least, n)
            mine = self.words[self.first[item] : self.first[item + 1]].tolist()
            found = tiles(mine, self._around(word, begins, least), least)
            total = sum(f[0] for f in found)
            if total >= coverage * n:
                out.append((row, item, len(found), total))
        return out

    @staticmethod
    def _around(word: np.ndarray, begins: list[int], least: int) -> list[int]:
        """The text's words under seeds, runs of them parted by a word that equals none.

        Every tile consists of seeds of the pair, so nothing else can matter.
        """
        out: list[int] = []
        end = -1
        for b in sorted(set(begins)):
            if end >= 0 and b > end:
                out.append(-1 - len(out))
            out += word[max(b, end) : b + least].tolist()
            end = b + least
        return out


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: int = 5,
    coverage: float = 0.5,
    block_bytes: int = 8_000_000,
) -> DataFrame:
    """One row per pair of a document and a benchmark item it gives away.

    Columns: id, row key, item, ``n_tiles``, ``covered_words``, ``item_words`` and ``coverage`` (0 to 1, at
    least ``coverage``). Words are lower-cased (A-Z) runs without ASCII white space, compared by 64-bit hashes; tiles have at
    least ``least`` words, or all words of a shorter item. Documents and items without words (null, empty,
    blank) are in no pair. Repeated rows of ``docs`` give repeated pairs, repeated items count once. Either table may be
    empty; further columns are not read.

    The benchmark is the stated query set: it is broadcast in blocks of about ``block_bytes`` of text, one pass over the
    documents per block, so a task holds one block whatever the benchmark's size.
    """
    spark = prepare(docs.sparkSession)
    kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, id_col), (benchmark, item_col)))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("words")).where("words IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = -(-int(total) // block_bytes)
    keyed = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), body(text_col).alias("body"))
    schema = f"id {kind}, key_a long, key_b long, item {item_kind}, n_tiles int, covered_words int, item_words int"
    item_type = pa.array([], _arrow(items)).type

    def scan_with(shared):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, texts = shared.value
            index = Benchmark(ids, texts, least)
            for batch in batches:
                data, offsets = flat(batch.column(3))
                rows, values = [], []
                for i, j in pieces(offsets):
                    word, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    for row, item, n, covered in index.pairs(word, first, coverage):
                        rows.append(i + row)
                        values.append((index.ids[item], n, covered, int(index.sizes[item])))
                if rows:
                    part = batch.select(["id", "key_a", "key_b"]).take(pa.array(rows))
                    columns = [pa.array(c, t) for c, t in zip(zip(*values), (item_type, pa.int32(), pa.int32(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*part.columns, *columns], [x.split(" ")[0] for x in schema.split(", ")])

        return scan

    found = []
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(([r["item"] for r in mine], [r["words"] for r in mine]))
        found.append(keyed.mapInArrow(scan_with(shared), schema))
    pairs = reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)
    return pairs.withColumn("coverage", F.col("covered_words") / F.col("item_words")).withColumnsRenamed(
        {"id": id_col, "item": item_col}
    )


def _arrow(items: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(items.schema["item"].dataType)
