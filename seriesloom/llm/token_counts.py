"""Token counts of a byte-level BPE vocabulary, by merging batches of words rank by rank.

A batch of texts is one flat byte array. Character classes give the borders of its pre-tokens;
the distinct ones become ragged arrays of symbols, and in every round each sequence applies its
own lowest-ranked pair, all sequences at once. What survives when no sequence has a known pair
left is its number of tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.flat import flat, pieces, mix
from seriesloom.llm.session import body, prepare

LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
NONE = np.int64(2**31)
#: Fixed values of the pre-token rule: what may follow an apostrophe and be cut off with it.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_letters() -> dict[str, int]:
    """The printable characters by which vocabulary files write bytes.

    Printable Latin-1 bytes stand for themselves, the others for the characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, everything):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return out


def read_vocabulary(path: str) -> dict:
    """What the counting needs of a tokenizer file: base ids, ranked pairs, special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids, letters = spec["model"]["vocab"], byte_letters()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    base = np.zeros(256, np.int64)
    for letter, b in letters.items():
        base[b] = ids[letter]
    return {
        "base": base,
        "left": np.array([ids[a] for a, _ in pairs], np.int64),
        "right": np.array([ids[b] for _, b in pairs], np.int64),
        "made": np.array([ids[a + b] for a, b in pairs], np.int64),
        "special": [t["content"] for t in spec["added_tokens"]],
    }


class PairTable:
    """Rank of a pair of symbols, looked up for whole arrays: open addressing, fixed size."""

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        bits = max(12, int(np.ceil(np.log2(8 * max(1, len(left))))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int64)
        key = left << 32 | right
        todo, at = np.arange(len(key)), self._slot(key)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[at] < 0
            _, first = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[at[placed]], self.ranks[at[placed]] = key[todo[placed]], todo[placed]
            rest = np.ones(len(todo), bool)
            rest[placed] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            slot = (at[open_] + step) & self.mask
            hit = self.keys[slot]
            same = hit == key[open_]
            out[open_[same]] = self.ranks[slot[same]]
            open_ = open_[~same & (hit >= 0)]
        return out


def merged_counts(symbols: np.ndarray, starts: np.ndarray, table: PairTable, made: np.ndarray) -> np.ndarray:
    """Symbols left in every sequence. ``starts`` are the sequences' first places; none is empty."""
    length = np.diff(np.append(starts, len(symbols)))
    counts = length.copy()
    owner = np.repeat(np.arange(len(starts)), length)
    alive = np.arange(len(starts))
    while len(symbols):
        last = np.empty(len(symbols), bool)
        last[-1], last[:-1] = True, owner[1:] != owner[:-1]
        inner = np.flatnonzero(~last)
        rank = np.full(len(symbols), NONE)
        rank[inner] = table(symbols[inner], symbols[inner + 1])
        first = np.flatnonzero(np.append(True, last[:-1]))
        lowest = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, len(symbols)))
        done = lowest == NONE
        counts[alive[done]] = size[done]
        hit = (rank == np.repeat(lowest, size)) & (rank < NONE)
        at = np.flatnonzero(hit)
        # A pair of twice the same symbol overlaps itself in a run: every second place merges.
        fresh = np.append(True, np.diff(at) > 1) if len(at) else np.zeros(0, bool)
        run = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(at) else at
        at = at[(at - run) % 2 == 0]
        symbols = symbols.copy()
        symbols[at] = made[rank[at]]
        keep = np.repeat(~done, size)
        keep[at + 1] = False
        symbols, owner = symbols[keep], owner[keep]
        alive = alive[~done]
        if len(owner):
            owner = np.cumsum(np.append(False, owner[1:] != owner[:-1]))
    return counts


class Counter:
    """Counts tokens of flat texts. Built once per Python worker from the broadcast vocabulary."""

    def __init__(self, vocabulary: dict) -> None:
        self.base, self.made = vocabulary["base"], vocabulary["made"]
        self.table = PairTable(vocabulary["left"], vocabulary["right"])
        self.kinds = character_classes()
        self.special = [s.encode() for s in vocabulary["special"]]
        pattern = "|".join(regex.escape(s) for s in sorted(vocabulary["special"], key=len, reverse=True))
        self.pattern = regex.compile(pattern.encode()) if pattern else None

    def borders(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """First bytes of the pre-tokens. ``cuts``: where a text (or part of one) begins, ascending."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first = data[lead].astype(np.int64)
        code = first.copy()
        for least, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
            some = np.flatnonzero(first >= least)
            value = first[some] & mask
            for k in range(1, more + 1):
                value = value << 6 | (data[np.minimum(lead[some] + k, len(data) - 1)] & 0x3F)
            code[some] = value
        kind = self.kinds[np.minimum(code, 0x10FFFF)]
        n = len(lead)
        opens = np.zeros(n + 1, bool)
        opens[np.searchsorted(lead, cuts)] = True
        opens[n] = True
        opens_here, ends_here = opens[:-1], opens[1:]
        before = np.append(np.uint8(OTHER), kind[:-1])
        after = np.append(kind[1:], np.uint8(BLANK))
        space_before = np.append(False, code[:-1] == 32) & ~opens_here
        changed = (kind != before) | opens_here
        blank = kind == BLANK
        # A run of blanks keeps all but its last character together when something follows it.
        last_of_run = blank & ~ends_here & (after != BLANK)
        start = np.where(blank, changed | last_of_run, changed & ~space_before)
        # Contractions, where an apostrophe opens a pre-token.
        quote = np.flatnonzero((code == 39) & start)
        if len(quote):
            ends = np.append(np.flatnonzero(opens_here), n)
            room = ends[np.searchsorted(ends, quote, "right")] - quote
            at = lambda k: code[np.minimum(quote + k, n - 1)]
            taken = np.zeros(len(quote), np.int64)
            for tail in CONTRACTIONS:
                fits = room > len(tail)
                for k, letter in enumerate(tail):
                    fits &= at(k + 1) == ord(letter)
                taken[fits & (taken == 0)] = len(tail)
            hit = taken > 0
            quote, taken = quote[hit], taken[hit]
            for k in (1, 2):
                start[quote[taken >= k] + k] = False
            follow = quote + taken + 1
            start[follow[follow < n]] = True
        return lead[start]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of every text."""
        extra = np.zeros(len(offsets) - 1, np.int64)
        if not len(data):
            return extra
        cuts, gone = offsets[:-1][np.diff(offsets) > 0], None
        if self.pattern and any(s[:2] in (raw := data.tobytes()) for s in self.special):
            spans = [m.span() for m in self.pattern.finditer(raw)]
            inside = [(a, b) for a, b in spans if offsets[np.searchsorted(offsets, a, "right")] >= b]
            if len(inside) < len(spans):  # a string across two texts hid one: look text by text
                inside = [
                    (a + m.start(), a + m.end())
                    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())
                    for m in self.pattern.finditer(raw[a:b])
                ]
            if inside:
                gone = np.array(inside, np.int64)
                np.add.at(extra, np.searchsorted(offsets, gone[:, 0], "right") - 1, 1)
                cuts = np.union1d(cuts, gone.ravel())
                cuts = cuts[cuts < len(data)]
        start = self.borders(data, cuts)
        stop = np.append(start[1:], len(data))
        if gone is not None:
            out = np.isin(start, gone[:, 0])
            # What a special string covers is one token, whatever pre-tokens it would give.
            inner = np.searchsorted(gone[:, 0], start, "right") - 1
            out |= (inner >= 0) & (start < gone[np.maximum(inner, 0), 1])
            start, stop = start[~out], stop[~out]
        counts = self.pretokens(data, start, stop)
        total = np.append(0, np.cumsum(counts))
        return extra + np.diff(total[np.searchsorted(start, offsets)])

    def pretokens(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Tokens of every pre-token; equal ones of up to 15 bytes are merged once."""
        length = stop - start
        if not len(start):
            return length
        packed = np.zeros((len(start), 16), np.uint8)
        packed[:, 15] = np.minimum(length, 255)
        for k in range(15):
            has = np.flatnonzero(length > k)
            packed[has, k] = data[start[has] + k]
        two = packed.view(np.uint64)
        value = mix(mix(two[:, 0]) + two[:, 1])
        order = np.argsort(value, kind="stable")
        new = np.ones(len(order), bool)
        # Compared byte by byte, so a hash collision can only cost a repeated merge.
        new[1:] = (two[order[1:]] != two[order[:-1]]).any(axis=1) | (length[order[1:]] > 15)
        group = np.cumsum(new) - 1
        chosen = order[new]
        size = length[chosen]
        starts = np.append(0, np.cumsum(size)[:-1])
        place = np.arange(size.sum()) - np.repeat(starts, size) + np.repeat(start[chosen], size)
        left = merged_counts(self.base[data[place]], starts, self.table, self.made)
        counts = np.empty(len(start), np.int64)
        counts[order] = left[group]
        return counts


_counters: dict[int, Counter] = {}


def _counter(shared) -> Counter:
    if id(shared) not in _counters:
        _counters.clear()
        _counters[id(shared)] = Counter(shared.value)
    return _counters[id(shared)]


def token_counts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    vocabulary: path of the tokenizer file, read on the driver and broadcast (its size is that of
    the vocabulary, whatever the corpus). Null and empty texts have no bytes and no tokens. A null id
    stays null, repeated rows come back as often as they came, further columns are not read, and an
    empty table gives an empty table. Texts of any length are counted whole.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            tokens = [
                counter.texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for i, j in pieces(offsets)
            ]
            tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            columns = [batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "n_tokens"])

    counted = docs.select(id_col, body(text_col).alias("body")).mapInArrow(
        count, f"`{id_col}` {kind}, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
