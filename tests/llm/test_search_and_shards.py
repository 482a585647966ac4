"""Lexical search, collocations and shards against brute-force versions, on odd rows and on empty tables."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from odd_rows import nothing, odd, odd_rows  # noqa: F401  (fixtures)
from seriesloom.llm import collocations as C
from seriesloom.llm import flat, lexical, sharding
from seriesloom.llm.session import discard, leading, stored

LOW = str.maketrans({c: c + 32 for c in range(65, 91)})


def counted(items):
    return Counter(map(tuple, items))


def test_same_bytes():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(97, 99, 400).astype(np.uint8) for _ in range(2))
    start, at = rng.integers(0, 370, (2, 3000))
    length = rng.integers(0, 30, 3000)
    got = flat.same_bytes(a, start, b, at, length)
    assert got.tolist() == [a[i : i + n].tobytes() == b[j : j + n].tobytes() for i, j, n in zip(start, at, length)] and got.any()


def test_leading_and_discard(spark):
    df = stored(spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("v")).repartition(5))
    got = {(r.g, r.rank): (r.v, r.id) for r in leading(df, ["g"], [F.desc("v"), F.asc("id")], 4).collect()}
    for g in range(3):
        want = sorted(((-(i % 7), i) for i in range(g, 1000, 3)))[:4]
        assert [got[g, k + 1] for k in range(4)] == [(-v, i) for v, i in want]
    files = df.inputFiles()
    discard(df)
    assert files and not any(spark.sparkContext._jvm.java.io.File(f.removeprefix("file:")).exists() for f in files)


# -- 11: lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k):
    held = [Counter(TERM.findall((t or "").translate(LOW))) for _, t in docs]
    size = [sum(h.values()) for h in held]
    n, total = sum(s > 0 for s in size), sum(size)
    df = Counter(x for h in held for x in h)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall((t or "").translate(LOW)))
    out = []
    for item, terms in asked.items():
        found = []
        for (i, _), h, s in zip(docs, held, size):
            if not s:
                continue
            m = 50 + 50 * s * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * h[x] // (1000 * h[x] + 20 * m)) for x in terms if x in h
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i, score))
        out += [(item, r + 1, f[3], f[4]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return counted(out)


@pytest.mark.parametrize("k,block", [(50, 200_000), (3, 6000)])
def test_search(spark, odd, odd_rows, nothing, k, block):
    """One block of items, and several."""
    rng = random.Random(1)
    vocabulary = sorted({w for _, t, *_ in odd_rows for w in (t or "").split()})
    items = [(n, " ".join(rng.sample(vocabulary, 9)), "x") for n in range(12)]
    items += [(20, None, "x"), (21, "", "x"), (22, "... !", "x"), (None, "line one É", "x"), (3, "line a c", "x"), (23, "don't 中文 nowhere", "x")]
    items += [items[0], (24, odd_rows[10][1], "x")]
    df = spark.createDataFrame(items, "item_id long, text string, score string").repartition(3)
    got = lexical.ranked(odd, df, k=k, block_terms=block).collect()
    want = brute_search([(r[0], r[1]) for r in odd_rows], [i[:2] for i in items], k)
    assert counted((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == want
    assert lexical.ranked(nothing, df).count() == 0 and lexical.ranked(odd, df.where("false")).count() == 0


def test_search_by_text_ids_in_small_tiles(spark, monkeypatch):
    """Ids of another type; products of few items, terms and documents add up to the same."""
    rng = random.Random(2)
    docs = [(f"d{k:03}", " ".join(rng.choices("abcdefgh", k=rng.randint(1, 12)))) for k in range(120)]
    items = [(f"i{k}", " ".join(rng.sample("abcdefgh", 5))) for k in range(7)]
    tiles = lexical.item_tiles
    monkeypatch.setattr(lexical, "item_tiles", lambda owned, weights: tiles(owned, weights, items=2, terms=3))
    df = spark.createDataFrame(docs, "doc_id string, text string").repartition(4)
    got = lexical.ranked(df, spark.createDataFrame(items, "item_id string, text string"), k=10).collect()
    held = brute_search([(k, t) for k, (_, t) in enumerate(docs)], items, 10)
    assert counted((r.item_id, r["rank"], int(r.doc_id[1:]), r.score) for r in got) == held


def test_products_stay_below_the_exact_bound():
    weights = np.array([2**32, 5, 2**32, 7], np.int64)
    (_, parts), = lexical.item_tiles([np.arange(4)], weights)
    assert all(matrix.sum() * lexical.IMPACT < 2**53 for _, matrix in parts) and len(parts) > 1
    assert sorted(t for terms, _ in parts for t in terms.tolist()) == [0, 1, 2, 3]


def test_terms_with_equal_hashes_are_told_apart():
    """A document's term is taken for an item's only if the bytes agree."""
    vocabulary = lexical.Vocabulary([b"alpha", b"beta"])
    vocabulary.value = np.sort(flat.SpanHash(np.frombuffer(b"alphagamma", np.uint8), vocabulary.seed)(np.array([0, 5]), np.array([5, 10])))
    first = vocabulary.value[0] == flat.SpanHash(np.frombuffer(b"alpha", np.uint8), vocabulary.seed)(np.array([0]), np.array([5]))[0]
    vocabulary.number = vocabulary.start = np.zeros(2, np.int64)  # both places claim to be alpha
    vocabulary.length = np.array([5, 5])
    data = np.frombuffer(b"alpha gamma alpha", np.uint8)
    n, row, term, count = vocabulary.counts(data, np.array([0, len(data)]))
    assert n.tolist() == [3] and row.tolist() == [0] and count.tolist() == [2] and first in (True, False)


# -- 12: collocations


def brute_collocations(docs, longest, least, inside, top):
    occurrences, total = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                for k in range(len(words) - n + 1):
                    occurrences[lang or "und", tuple(words[k : k + n])] += 1
    candidates = {p: a for p, a in occurrences.items() if len(p[1]) > 1 and a >= least}
    out, around = defaultdict(list), Counter()  # the most that a candidate around a phrase occurs
    for (lang, q), f in candidates.items():
        for n in range(2, len(q)):
            for k in range(len(q) - n + 1):
                around[lang, q[k : k + n]] = max(f, around[lang, q[k : k + n]])
    for (lang, p), a in candidates.items():
        if around[lang, p] and 100 * around[lang, p] >= inside * a:
            continue
        cuts = []
        for k in range(1, len(p)):
            l, r = occurrences[lang, p[:k]], occurrences[lang, p[k:]]
            cuts.append((math.floor(Fraction(10**6 * a * a, l * r)), k, l, r))
        score, _, l, r = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return counted(rows)


FIELDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("longest,least,top,block", [(3, 10, 2000, 4_000_000), (4, 2, 30, 64), (2, 3, 2000, 500)])
def test_collocations(spark, longest, least, top, block):
    """One block, and blocks so small that pieces fill one each; phrases of two to four words."""
    rng = random.Random(longest)
    words = ["New", "york", "é", "city", "The", "of", "a", "'s", "中", "\x0b"]
    docs = []
    for k in range(150):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 9), weights=[9, 9, 3, 6, 5, 5, 5, 2, 2, 1])) for _ in range(4)]
        docs.append((k % 90, rng.choice([". ", "\n", "\t", "!?", " "]).join(parts), rng.choice(["en", "en", "de", None, "und"]), "clash", 3))
    docs += [(1, None, "en", "clash", 3), (2, "", None, "clash", 3), (None, " \t..", "fr", "clash", 3), docs[0], docs[0]]
    docs += [(9, "new york city " * 400, "en", "clash", 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, block string, n int").repartition(3)
    got = C.collocations(df, longest=longest, least=least, top=top, block_bytes=block).collect()
    want = brute_collocations([(lang, t) for _, t, lang, *_ in docs], longest, least, 50, top)
    assert counted(tuple(r[f] for f in FIELDS) for r in got) == want and len(got) > 10


def test_collocations_of_odd_rows(odd, odd_rows, nothing):
    got = C.collocations(odd, least=2).collect()
    assert counted(tuple(r[f] for f in FIELDS) for r in got) == brute_collocations([(r[2], r[1]) for r in odd_rows], 3, 2, 50, 2000)
    assert C.collocations(nothing).count() == 0


def test_collocations_hold_one_block_at_a_time(spark, monkeypatch):
    """Every block of a written relation is a row group, so neither writer nor reader hold all blocks of a task."""
    files = []
    monkeypatch.setattr(C, "discard", lambda table: files.append([f.removeprefix("file:") for f in table.inputFiles()]))
    df = spark.createDataFrame([(k, "new york city " * 30, "en") for k in range(40)], "doc_id long, text string, lang string")
    assert C.collocations(df.coalesce(1), block_bytes=500).count() > 0
    assert len(files) == 3  # words, pairs, triples
    for found in files:
        read = [pq.ParquetFile(f).metadata for f in found]
        assert sum(m.num_row_groups for m in read) == sum(m.num_rows for m in read) > 20


def test_words_of_a_block_need_little_memory(spark, monkeypatch):
    """A block of 4 MB, cut from a batch of 16 MB as Spark sends it, is looked up and hashed in stretches."""

    class Caught:
        select = lambda self, *columns: self
        mapInArrow = lambda self, split, schema: split

    rng = np.random.default_rng(0)
    words = np.array([bytes(rng.integers(97, 123, rng.integers(3, 11)).astype(np.uint8)) for _ in range(20_000)])
    texts = [b" ".join(rng.choice(words, 1000).tolist()) + b"." for _ in range(2200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(["en"] * len(texts))], ["body", "lang"])
    assert 15e6 < batch.nbytes < 18e6
    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    split = C.word_relation(Caught(), "text", "lang", C.BLOCK_BYTES)
    tracemalloc.start()
    try:
        said = [np.frombuffer(r.column("item")[0].as_py(), "<i4").size for r in split(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(said) == 2_200_000 and len(said) == 5
    assert peak < 130e6


def test_words_over_stretches(monkeypatch):
    """Words, hashes and strings of a block do not depend on where its stretches are cut."""
    texts = ["New York, é中 city. ", "", "a" * 90 + " b\x0bc", " ..", "中中 é"] * 20
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    edges = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    whole = C.block_words(data, edges)
    monkeypatch.setattr(C, "STRETCH_BYTES", 7)
    for x, y in zip(whole, C.block_words(data, edges)):
        assert x.tolist() == y.tolist()
    start, stop, value = whole
    said = [data[a:b].tobytes().decode() for a, b in zip(start, stop)]
    assert C.strings(data, start, stop).to_pylist() == said and len(set(value.tolist())) == len(set(said))
    with pytest.raises(pa.ArrowInvalid):
        C.strings(np.frombuffer(b"\xff", np.uint8), np.array([0]), np.array([1]))


@pytest.mark.parametrize("most,how", [(0, "merge"), (10**6, "shuffle_hash")])
def test_many_frequent_phrases_are_merged(spark, monkeypatch, most, how):
    """A hash table of frequent phrases cannot spill, so beyond a number for each partition they are merged."""
    monkeypatch.setattr(C, "HASHED_ROWS", most, raising=False)
    entry = "array<struct<a:bigint,b:bigint,n:bigint>>"
    relation = spark.createDataFrame([], f"block long, place binary, item binary, entries {entry}")
    kept = spark.createDataFrame([(1, 2, 3, 0)], "a long, b long, n long, id long")
    plan = C.extended(relation, kept)._jdf.queryExecution().optimizedPlan().toString()
    assert f"strategy={how}" in plan


def test_counts_beyond_64_bits(spark):
    big = 900_000_000_000_001
    df = spark.createDataFrame([(big, [big + 3], [big + 5])], "n long, heads array<long>, tails array<long>")
    assert df.select(C.weakest_cut().alias("c")).first().c.score == 10**6 * big * big // ((big + 3) * (big + 5))


def test_spans_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(C, "SpanHash", lambda data: lambda start, stop: np.zeros(len(start), np.uint64))
    data = np.frombuffer(b"ab cd ab ef ab", np.uint8)
    start = np.array([0, 3, 6, 9, 12])
    one, item = C.distinct_spans(data, start, start + 2, np.array([0, 0, 0, 0, 1]))
    assert item[0] == item[2] and len({*item.tolist()}) == 4 and one[item].tolist() == [0, 1, 0, 3, 4]


# -- 13: sharding


def checked(got, docs, count, slack):
    assert counted((r.doc_id, r.size, r.text_crc32) for r in got) == counted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs
    )
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < count for r in got)
    held = defaultdict(list)
    for r in got:
        held[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in held.values())
    due = sum(r.size for r in got) / count
    most = max(slack * due, max((r.size for r in got), default=0))
    for k in range(count):
        assert abs(sum(r.size for r in got if r.shard == k) - due) <= most + 1
    groups = defaultdict(list)
    for r in got:
        groups[r.size, r.text_crc32].append(r)
    for rows in groups.values():
        if sum(r.size for r in rows) <= slack * due:
            assert len({r.shard for r in rows}) == 1


@pytest.mark.parametrize("ranges", [1, 8, 60])
def test_shards(spark, odd, odd_rows, nothing, ranges):
    checked(sharding.shards(odd, ranges=ranges).collect(), [(r[0], r[1]) for r in odd_rows], 8, 0.02)
    assert sharding.shards(nothing).count() == 0


@pytest.mark.parametrize("ranges", [4, 50])
def test_shards_of_hot_groups(spark, ranges):
    """Copies under different ids, rows that agree in everything, and one long text; any number of ranges gives the same shards."""
    rng = random.Random(3)
    docs = [(k, "".join(rng.choices("abc ", k=rng.randint(0, 400)))) for k in range(2000)]
    docs += [(5000 + k, "the same text " * 20) for k in range(1500)] + [(None, "repeated " * 9)] * 1500 + [(9000, "x" * 60_000)]
    docs += [(6000 + k // 3, f"small group {k // 3}") for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = sharding.shards(df, ranges=ranges, slack=0.05).collect()
    checked(got, docs, 8, 0.05)
    assert len({r.shard for r in got if r.doc_id is None}) > 1
    once = sharding.shards(df, ranges=9, slack=0.05).collect()
    assert counted((r.doc_id, r.size, r.shard) for r in got) == counted((r.doc_id, r.size, r.shard) for r in once)


def test_ranges_are_not_overfull(spark):
    rng = random.Random(4)
    docs = [(k, "hot" if k % 3 == 0 else f"{rng.random()}" * rng.randint(1, 30)) for k in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    records = stored(sharding.keyed(df, "doc_id", "text", F.monotonically_increasing_id()))
    splitters, held = sharding.splitters_for(records, 40, points=2)  # a poor sample, so that some ranges are subdivided
    due = sum(r["bytes"] for r in held) / 40
    assert splitters == sorted(splitters) and sum(r["rows"] for r in held) == 3000
    assert all(r["rows"] == 1 or r["bytes"] <= sharding.OVERFULL * due for r in held)


def test_written_shards(spark, odd, odd_rows, tmp_path):
    back = sharding.write_shards(odd, str(tmp_path / "shards"), count=3, files=2)
    names = [c for c in odd.columns]
    assert counted(tuple(r[c] for c in names) for r in back.collect()) == counted(odd_rows)
    told = counted((r.doc_id, r.shard) for r in sharding.shards(odd, 3).collect())
    assert counted((r.doc_id, r.shard) for r in back.collect()) == told
    slots = defaultdict(list)
    for r in back.collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
