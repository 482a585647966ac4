"""Suffix-array dedup: the bytes of all strings of a given length that occur more than once.

Equal strings of ``length`` bytes choose the same anchor in themselves: the ``GRAM`` bytes with the smallest hash, the
first among equals. So suffixes need to be sorted only from anchors, and only where an anchor's bytes occur
again. Occurrences with the same surroundings (as far as a string through the anchor can reach) are counted as one class, by 128-bit
hashes, before anything is sorted; a class of several occurrences is repeated as a whole.

The classes that share an anchor are sorted by what follows the anchor (a sparse suffix array, sorted by Spark), the
common prefixes of neighbours are computed, and a stack scan walks the tree of common-prefix intervals from the deepest
up. Within an interval the preceding bytes are compared: where extensions to the left differ, the occurrences part
into the groups of a maximal repeat, each with all its members. Groups that reach the length cover their members.

An anchor with more classes than one task should sort is dealt first. The strings through it begin 0 to length - GRAM bytes before it;
that range is cut into a few smaller ones. All strings of a range share the bytes between the last beginning and the
first end, so only classes equal in these can share one of them: they are a group. Classes that agree in every byte
which the range touches are one in it and, if several, repeated throughout. Groups still too large are cut again, down to ranges of one
string, where a group is one class; all others are sorted and scanned like a small anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.flat import SpanHash, flat, mix, pieces, whole_groups
from seriesloom.llm.session import body, prepare, row_key, stored

GRAM = 32
#: Bytes handled at once; positions within it take the lower 21 bits of an anchor's sort key.
PIECE, POSITION_BITS = 1_000_000, 21
#: Classes that are sorted and scanned together. An anchor with more is dealt to smaller groups.
CLASSES = 4096
#: Smaller ranges that a range of beginnings is cut into.
FANOUT = 8


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Ascending positions of the anchors of all strings of ``length`` bytes inside the rows ``[begin, end)``."""
    gram = min(GRAM, length)
    span = length - gram + 1
    n = len(data) - gram + 1
    if n < span:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    low = np.uint64((1 << POSITION_BITS) - 1)
    value = SpanHash(data)(at, at + gram) & ~low | at.astype(np.uint64)
    # Minimum of every window of ``span`` values, from running minima of blocks in both directions.
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = value
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - span + 1], ahead[span - 1 : n])
    starts = np.zeros(len(data) + 1, np.int64)  # +1 where strings may begin, -1 where no longer
    some = end - begin >= length
    np.add.at(starts, begin[some], 1)
    np.add.at(starts, end[some] - length + 1, -1)
    valid = np.cumsum(starts)[: len(least)] > 0
    return np.unique((least[valid] & low).astype(np.int64))


def stretches(offsets: np.ndarray, length: int, piece_bytes: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``(first row, last row, from, to, strings from, strings to)`` of stretches that fit a piece.

    A text longer than a piece is cut into stretches that overlap, so each of its strings is in one and its anchor has
    all surroundings; the last two numbers bound the strings that are the stretch's own.
    """
    for i, j in pieces(offsets, piece_bytes):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= piece_bytes:
            yield i, j, a, b, a, b
            continue
        for s in range(a, b, piece_bytes - 4 * length):
            e = min(b, s + piece_bytes - 4 * length)
            yield i, j, max(a, s - length), min(b, e + 2 * length), s, min(b, e + length - 1)


def occurrences(data: np.ndarray, offsets: np.ndarray, length: int, piece_bytes: int = PIECE) -> dict[str, np.ndarray]:
    """Anchors of all rows: row, place in the row, bytes to both sides, hash of the anchor and two of its surroundings."""
    gram = min(GRAM, length)
    out: dict[str, list] = {k: [] for k in ("row", "place", "left", "right", "anchor", "c1", "c2")}
    last = -1
    for i, j, a, b, s, e in stretches(offsets, length, piece_bytes):
        part = data[a:b]
        begin, end = np.maximum(offsets[i:j], a) - a, np.minimum(offsets[i + 1 : j + 1], b) - a
        found = anchors(part, np.maximum(begin, s - a), np.minimum(end, e - a), length)
        # The last strings of a stretch and the first of the next may share their anchor, which occurs once.
        found = found[found + a > last]
        if not len(found):
            continue
        last = int(found[-1]) + a
        row = np.searchsorted(begin, found, "right") - 1
        left = np.minimum(found - begin[row], length - gram)
        right = np.minimum(end[row] - found, length)
        one, two = SpanHash(part), SpanHash(part, seed=1)
        side = mix(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))
        out["row"].append(row + i)
        out["place"].append(found + a - offsets[row + i])
        out["left"].append(left)
        out["right"].append(right)
        out["anchor"].append(one(found, found + gram).view(np.int64))
        out["c1"].append((one(found - left, found + right) ^ side).view(np.int64))
        out["c2"].append(mix(two(found - left, found + right) + side).view(np.int64))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def common_prefixes(sorted_rows: list[bytes]) -> list[int]:
    """Length of the common prefix of each string with the next."""
    out = []
    for a, b in zip(sorted_rows, sorted_rows[1:]):
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            out.append(n)
            continue
        x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
        out.append(int(x.argmax()))
    return out


def intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals ``(depth, first, last)`` of at least ``least``, children before their parents."""
    stack: list[tuple[int, int]] = []
    for k, depth in enumerate([*common, -1]):
        first = k
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, k
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def repeat_groups(left: list[bytes], right: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats through one anchor: ``(bytes before, bytes from the anchor on, members)``.

    left: what precedes each occurrence, reversed; right: what follows, anchor included, in ascending order.
    A group is given if its members' extensions differ on both sides (or end) and it has at least ``length`` bytes.
    """
    n = len(right)
    order = sorted(range(n), key=left.__getitem__)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    beside = np.array([*common_prefixes([left[k] for k in order]), 0], np.int64)
    child = np.arange(n)  # the deepest interval that each member has been in so far
    done = n
    reach = max(map(len, left))
    for depth, first, last in intervals(common_prefixes(right), max(1, length - reach)):
        members = np.arange(first, last + 1)
        members = members[np.argsort(rank[members])]
        gaps = np.minimum.reduceat(beside, rank[members])[:-1].tolist()
        for ext, a, b in intervals(gaps, max(0, length - depth)):
            group = members[a : b + 1]
            if (child[group] != child[group[0]]).any():
                yield ext, depth, group.tolist()
        child[first : last + 1] = done
        done += 1


def covers(left: list[bytes], right: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """``(member, bytes before, bytes from the anchor on)`` that repeats cover, for every member of a group.

    All repeats through an anchor hold the anchor, so together they cover one run: from the widest reach to the left to
    the widest to the right.
    """
    reach: dict[int, tuple[int, int]] = {}
    for ext, depth, group in repeat_groups(left, right, length):
        for m in group:
            before, after = reach.get(m, (0, 0))
            reach[m] = max(before, ext), max(after, depth)
    return [(m, before, after) for m, (before, after) in reach.items()]


def narrower(low: int, high: int) -> list[tuple[int, int]]:
    """The ranges that a range of beginnings, counted in bytes before the anchor, is cut into."""
    step = -(-(high - low + 1) // FANOUT)
    return [(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]


def dealt(before: bytes, after: bytes, low: int, high: int, length: int) -> Iterator[tuple[int, ...]]:
    """``(low, high, group, two halves of the content's hash, bytes before, bytes from the anchor on)`` per smaller range.

    Ranges in which no string of ``length`` bytes fits the text are left out.
    """
    for a, b in narrower(low, high):
        left, right = min(b, len(before)), min(length - a, len(after))
        if max(a, length - right) > left:
            continue
        shared = blake2b(b"%d:" % a + before[:a] + after[: length - b], digest_size=8).digest()
        whole = blake2b(b"%d:%d:" % (a, left) + before[:left] + after[:right], digest_size=16).digest()
        yield a, b, *(int.from_bytes(x, "big", signed=True) for x in (shared, whole[:8], whole[8:])), left, right


def smaller_groups(around: DataFrame, length: int, classes_at_once: int) -> tuple[DataFrame, DataFrame]:
    """Deal the classes of large anchors until no group has more than ``classes_at_once``.

    around: one row per class with ``before`` (reversed) and ``after``. Returns the groups to scan (``anchor`` is the group's
    key, contents cut to its range) and the reaches of classes that are equal throughout a range.
    """
    span = length - min(GRAM, length) + 1
    kinds = {"c1": pa.int64(), "c2": pa.int64(), "low": pa.int32(), "high": pa.int32(), "part": pa.int64()}
    kinds |= {"u1": pa.int64(), "u2": pa.int64(), "before": pa.int32(), "after": pa.int32()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("c1", "c2", "before", "after", "low", "high")))
            made = [(c1, c2, *part) for c1, c2, *rest in rows for part in dealt(*rest, length)]
            if made:
                columns = [pa.array(x, t) for x, t in zip(zip(*made), kinds.values())]
                yield pa.RecordBatch.from_arrays(columns, list(kinds))

    large = around.where(F.col("m") > classes_at_once).select("c1", "c2", "before", "after")
    asked = large.withColumns({"low": F.lit(0), "high": F.lit(span - 1)})
    made = "c1 long, c2 long, low int, high int, part long, u1 long, u2 long, before int, after int"
    scanned = around.where(F.col("m") <= classes_at_once).select("anchor", "c1", "c2", "before", "after")
    reaches, width = None, span
    while True:
        width = -(-width // FANOUT)
        rows = stored(asked.mapInArrow(deal, made), "dealt")
        if rows.isEmpty():
            break
        one = F.struct("c1", "c2")
        contents = stored(
            rows.groupBy("part", "u1", "u2", "low", "high").agg(F.min(one).alias("first"), F.max(one).alias("last")), "contents"
        )
        several = contents.where("first <> last").select("part", "u1", "u2")
        equal = rows.join(several.hint("merge"), ["part", "u1", "u2"], "left_semi").select("c1", "c2", "before", "after")
        reaches = equal if reaches is None else reaches.union(equal)
        if width == 1:  # a group is one content now
            break
        sizes = contents.groupBy("part").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        open_ = contents.join(sizes.hint("merge"), "part").select("part", "size", "low", "high", "first.c1", "first.c2")
        small = open_.where(F.col("size") <= classes_at_once).join(large.hint("merge"), ["c1", "c2"])
        cut = [F.expr("substring(before, 1, high)").alias("before"), F.expr(f"substring(after, 1, {length} - low)").alias("after")]
        scanned = scanned.union(small.select(F.col("part").alias("anchor"), "c1", "c2", *cut))
        asked = open_.where(F.col("size") > classes_at_once).join(large.hint("merge"), ["c1", "c2"])
        asked = asked.select("c1", "c2", "before", "after", "low", "high")
    if reaches is None:
        reaches = rows.select("c1", "c2", "before", "after")
    return scanned, reaches


def heavy_keys(counted: DataFrame, on: list[str], number: str, rows: int) -> DataFrame:
    """The keys with more than half a task's share of ``rows``: fewer than two for every task, however many rows there are.

    counted: ``number`` rows per key, one row per key.
    """
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counted.where(F.col(number) > max(1, rows // (2 * parts))).select(*on)


def join_spread(large: DataFrame, keyed: DataFrame, on: list[str], heavy: DataFrame, how: str = "inner") -> DataFrame:
    """``large`` joined with ``keyed`` (one row per key), so that no key brings all its rows to one task.

    Rows of the few ``heavy`` keys stay where they are and meet their partners by broadcast; all others are merged.
    """
    few = F.broadcast(heavy)
    beside = large.join(F.broadcast(keyed.join(few, on, "left_semi")), on, how)
    return beside.union(large.join(few, on, "left_anti").join(keyed.hint("merge"), on, how))


def repeated_spans(
    docs: DataFrame, id_col: str, text_col: str, length: int, classes_at_once: int = CLASSES, piece_bytes: int = PIECE
) -> DataFrame:
    """Per row key the spans ``[start, stop)`` of bytes under repeated strings; spans may overlap."""
    keyed = docs.select(*row_key(id_col, text_col), body(text_col).alias("body"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["place", "left", "right", "anchor", "c1", "c2"]
        for batch in batches:
            data, offsets = flat(batch.column(2))
            for i, j in pieces(offsets, 4 * piece_bytes):
                got = occurrences(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, piece_bytes)
                if len(got["row"]):
                    keys = batch.select(["key_a", "key_b"]).take(pa.array(got["row"] + i))
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                    columns = [pa.array(got[k].astype(np.int64)).cast(t) for k, t in zip(names, kinds)]
                    yield pa.RecordBatch.from_arrays([*keys.columns, *columns], ["key_a", "key_b", *names])

    every = stored(
        keyed.mapInArrow(find, "key_a long, key_b long, place long, left int, right int, anchor long, c1 long, c2 long"),
        "anchors",
    )
    again = stored(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    heavy = heavy_keys(again, ["anchor"], "n", every.count())
    shared = stored(join_spread(every, again, ["anchor"], heavy, "left_semi"), "shared")
    classes = stored(
        shared.groupBy("anchor", "c1", "c2", "left", "right").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("key_a", "key_b", "place")).alias("at")
        ),
        "classes",
    )
    whole = classes.where("n > 1").select("c1", "c2", F.col("left").alias("before"), F.col("right").alias("after"))
    apart = stored(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "apart")
    heavy = heavy_keys(apart, ["anchor"], "m", classes.count())
    # One occurrence of every class that shares its anchor with another class, with its surroundings.
    wanted = (
        join_spread(classes, apart, ["anchor"], heavy)
        .select("at.key_a", "at.key_b", F.struct("at.place", "left", "right", "anchor", "c1", "c2", "m").alias("one"))
        .groupBy("key_a", "key_b")
        .agg(F.collect_set("one").alias("ones"))  # as many as a text has anchors at most
    )
    fields = ["place", "left", "right", "anchor", "c1", "c2", "m"]
    # The wanted occurrences grow with the corpus, so they are never broadcast.
    texts = keyed.join(wanted.hint("merge"), ["key_a", "key_b"]).select(
        "body", *[F.col("ones").getField(k).alias(k) for k in fields]
    )

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                text = batch.column("body")[r].as_py()
                one = {k: batch.column(k)[r].as_py() for k in fields}
                before = [text[p - n : p][::-1] for p, n in zip(one["place"], one["left"])]
                after = [text[p : p + n] for p, n in zip(one["place"], one["right"])]
                columns = [pa.array(one[k], pa.int64()) for k in names]
                columns += [pa.array(before, pa.binary()), pa.array(after, pa.binary())]
                for i in range(0, len(after), 2000):
                    yield pa.RecordBatch.from_arrays([c.slice(i, 2000) for c in columns], [*names, "before", "after"])

    names = ["anchor", "c1", "c2", "m"]
    made = "anchor long, c1 long, c2 long, m long, before binary, after binary"
    around = stored(texts.mapInArrow(surround, made), "around")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cover = "c1 long, c2 long, before int, after int"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["anchor"]):
            c1, c2 = table.column("c1").to_numpy(), table.column("c2").to_numpy()
            before, after = table.column("before").to_pylist(), table.column("after").to_pylist()
            found = []
            for p, q in zip(at[:-1].tolist(), at[1:].tolist()):
                # A repeated row gives its class twice; neighbours in the order, since their contents agree.
                mine = [k for k in range(p, q) if k == p or (c1[k], c2[k]) != (c1[k - 1], c2[k - 1])]
                if len(mine) > 1:
                    found += [(mine[m], x, y) for m, x, y in covers([before[k] for k in mine], [after[k] for k in mine], length)]
            if found:
                m, x, y = np.array(found).T
                columns = [pa.array(c1[m]), pa.array(c2[m]), pa.array(x, pa.int32()), pa.array(y, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["c1", "c2", "before", "after"])

    groups, equal = smaller_groups(around, length, classes_at_once)
    found = groups.repartition(parts, "anchor").sortWithinPartitions("anchor", "after", "c1", "c2").mapInArrow(scan, cover)
    # One row per class, so the join below makes no more rows than there are occurrences.
    every_reach = whole.union(found).union(equal).groupBy("c1", "c2")
    reached = stored(every_reach.agg(F.max("before").alias("before"), F.max("after").alias("after")), "reached")
    heavy = heavy_keys(classes, ["c1", "c2"], "n", shared.count())
    spans = join_spread(shared, reached, ["c1", "c2"], heavy).select(
        "key_a", "key_b", (F.col("place") - F.col("before")).alias("start"), (F.col("place") + F.col("after")).alias("stop")
    )
    return spans


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 400,
    classes_at_once: int = CLASSES,
    piece_bytes: int = PIECE,
) -> DataFrame:
    """Remove every byte under a string of ``length`` bytes that also starts elsewhere, in any text.

    One row per row of ``docs``: id, ``n_bytes``, ``spans`` (maximal removed runs, ascending), ``n_removed`` and ``kept``, the
    remaining bytes (binary, since a cut may part a character). Strings are taken from the input; matches never cross texts, but may
    overlap within one. Null and empty texts, and texts shorter than ``length``, lose nothing. A repeated row is an
    occurrence like any other, so both lose all their strings. An empty table gives an empty table; further columns are not
    read.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    spans = repeated_spans(docs, id_col, text_col, length, classes_at_once, piece_bytes)
    spans = spans.groupBy("key_a", "key_b").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    keyed = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), body(text_col).alias("body"))
    joined = keyed.join(spans.hint("merge"), ["key_a", "key_b"], "left").select("id", "body", "spans.start", "spans.stop")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sizes, merged, removed, kept = [], [], [], []
                for text, start, stop in zip(*(part.column(k).to_pylist() for k in (1, 2, 3))):
                    runs: list[list[int]] = []
                    for a, b in zip(start or (), stop or ()):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                    ends = [0, *[x for r in runs for x in r], len(text)]
                    sizes.append(len(text))
                    merged.append([{"start": a, "stop": b} for a, b in runs])
                    removed.append(sum(b - a for a, b in runs))
                    kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])))
                columns = [pa.array(sizes, pa.int64()), pa.array(merged, span), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "n_bytes", "spans", "n_removed", "kept"])

    schema = f"id {kind}, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, n_removed long, kept binary"
    return joined.mapInArrow(cut, schema).withColumnRenamed("id", id_col)
