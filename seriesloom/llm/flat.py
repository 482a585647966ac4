"""Texts of an Arrow batch as one flat byte array, and what the operators compute on it.

Everything here works on pieces of a few megabytes, so memory does not grow with a batch. A
single longer text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2_000_000

#: ASCII white space of the word rule: space and the characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: A-Z to a-z; every other byte stays, so multi-byte characters are not touched.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20_240_611)
#: Fixed random 64-bit values per byte and an odd base, for position-weighted sums modulo 2^64.
BYTE_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the n + 1 offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; at least one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class SpanHash:
    """64-bit hashes of any spans of one byte array, from one cumulated sum.

    The sum of value(byte) * base^position over a span, moved to position 0 and scrambled with the
    span's length: equal bytes give equal hashes wherever they stand.
    """

    def __init__(self, data: np.ndarray, seed: int = 0) -> None:
        values = BYTE_VALUE if not seed else mix(BYTE_VALUE + np.uint64(seed)) | np.uint64(1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * powers(len(data)), out=self.sums[1:])
        self.back = powers(len(data) + 1, INVERSE)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        length = (stop - start).astype(np.uint64)
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] ^ mix(length + np.uint64(1)))


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words (runs without a byte of ``apart``: ASCII white space) and each row's first word.

    ``first`` has n + 1 entries: the words of row i are ``first[i]:first[i + 1]``. Words never
    cross rows.
    """
    inside = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, stop, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every word of every row, and each row's first word (n + 1 entries)."""
    if lower:
        data = LOWER[data]
    start, stop, first = words(data, offsets)
    return SpanHash(data)(start, stop), first


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on (zeros behind the end) as one number each; a view, not a copy."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def same_bytes(data: np.ndarray, start: np.ndarray, other: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``data[start:start + length]`` equals ``other[at:at + length]``, span by span."""
    mine, theirs = eights(data), eights(other)
    same = np.ones(len(start), bool)
    for k in range(0, int(length.max(initial=0)), 8):
        todo = np.flatnonzero(same & (length > k))
        left = np.minimum(length[todo] - k, 8).astype(np.uint64)
        unlike = (mine[start[todo] + k] ^ theirs[at[todo] + k]) << (np.uint64(64) - np.uint64(8) * left)
        same[todo] = unlike == 0
    return same


def grams(word: np.ndarray, first: np.ndarray, size: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every run of ``size`` words within a row.

    whole: a row with fewer words has one run, all its words; otherwise it has none.
    """
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(word)) - first[row]
    begins = np.flatnonzero((place + size <= count[row]) | ((place == 0) & whole))
    mine = np.minimum(size, count[row[begins]])
    value = np.zeros(len(begins), np.uint64)
    for k in range(size):
        step = mix(value * BASE + word[np.minimum(begins + k, max(0, len(word) - 1))] + np.uint64(k + 1)) if len(begins) else value
        value = np.where(k < mine, step, value)
    return value, row[begins], begins


def shingles(
    data: np.ndarray, offsets: np.ndarray, size: int = 5, lower: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of every row, ascending, and n + 1 offsets into them.

    A row with fewer words has one shingle, its whole sequence; a row without words has none.
    """
    word, first = word_hashes(data, offsets, lower)
    value, owner, _ = grams(word, first, size)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[keep], value[keep]
    return value, np.searchsorted(owner, np.arange(len(first)))


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``keys`` (integers), cut where a key changes, with the first row of every group.

    Each table holds complete groups, so memory is that of a batch or of the largest group.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            value = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= value[1:] != value[:-1]
            if rest:
                new[0] |= value[0] != rest[-1].column(k)[-1].as_py()
        at = np.flatnonzero(new)
        if len(at):
            if at[-1]:
                rest.append(batch.slice(0, at[-1]))
            if rest:
                yield _grouped(rest, keys)
            rest = [batch.slice(at[-1])]
        else:
            rest.append(batch)
    if rest:
        yield _grouped(rest, keys)


def _grouped(batches: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        value = table.column(k).to_numpy()
        new[1:] |= value[1:] != value[:-1]
    return table, np.append(np.flatnonzero(new), table.num_rows)
