"""Every operator against a brute-force version, on odd rows and on an empty table."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from odd_rows import nothing, odd, odd_rows  # noqa: F401  (fixtures)
from seriesloom.llm import exact_dedup, near_dedup, quality, repeats
from seriesloom.llm.chat import perspectives
from seriesloom.llm.components import components
from seriesloom.llm.decontaminate import leaks, tiles
from seriesloom.llm.exact_dedup import exact_groups
from seriesloom.llm.language import language_of
from seriesloom.llm.line_dedup import LineRuns, dedup_batch, drop_common_lines, run_of
from seriesloom.llm.near_dedup import near_groups
from seriesloom.llm.quality import quality_scores
from seriesloom.llm.repeats import repeated_spans, smaller_groups, without_repeats
from seriesloom.llm.sentencepiece_codec import encoded
from seriesloom.llm.session import prepare, stored
from seriesloom.llm.token_counts import token_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD, LOW = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans({c: c + 32 for c in range(65, 91)})


def rows(odd_rows):
    return [(r[0], r[1] or "") for r in odd_rows]


def counted(items):
    return Counter(map(tuple, items))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- 1: token counts


def test_token_counts(odd, odd_rows, nothing):
    library = Tokenizer.from_file(BPE)
    got = counted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(odd, BPE).collect())
    want = []
    for i, t in rows(odd_rows):
        n = len(library.encode(t, add_special_tokens=False).ids)
        want.append((i, len(t.encode()), n, n > 1024))
    assert got == counted(want)
    assert token_counts(nothing, BPE).count() == 0


def test_token_counts_of_odd_strings():
    from seriesloom.llm.token_counts import Counter as Tokens
    from seriesloom.llm.token_counts import read_vocabulary
    import numpy as np

    library, mine, rng = Tokenizer.from_file(BPE), Tokens(read_vocabulary(BPE)), random.Random(3)
    parts = ["'s", "'re", "'ll", "'", " ", "  ", "\n", "\t", "a", "th", "1", "!", "é", "中", "🙂", "<|endoftext|>", "<|", " ", "aaaa", "'S"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(20_000)]
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(b) for b in raw])).astype(np.int64)
    got = mine.texts(np.frombuffer(b"".join(raw), np.uint8), offsets)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert got.tolist() == want


# -- 2: exact dedup


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_dedup(odd, odd_rows, nothing, digest_bytes):
    """With identifiers of one byte nearly all collide; the verification keeps the result exact."""
    small = {"average": 64, "least": 32, "most": 512}
    groups = defaultdict(list)
    for i, t in rows(odd_rows):
        groups[t].append(i)
    want = []
    for i, t in rows(odd_rows):
        keep = max((x for x in groups[t] if x is not None), default=None)
        want.append((i, keep, len(groups[t]), i == keep, sha(t)))
    got = exact_groups(odd, digest_bytes=digest_bytes, sizes=small).collect()
    assert counted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == counted(want)
    assert exact_groups(nothing).count() == 0


def test_chunks_depend_on_content_only():
    import numpy as np

    rng = random.Random(5)
    body = "".join(rng.choices("abcdefgh ", k=60_000)).encode()
    sizes = {"average": 256, "least": 64, "most": 1024}

    def cut(text):
        data = np.frombuffer(text, np.uint8)
        ends = exact_dedup.cuts(data, np.array([0, len(data)]), **sizes)[0]
        return [text[a:b] for a, b in zip([0, *ends], ends)]

    plain, moved = cut(body), cut(b"some words in front " + body)
    assert b"".join(plain) == body and max(map(len, plain)) <= 1024
    assert len(set(plain) & set(moved)) > 0.8 * len(plain)


# -- 3: decontamination


def test_tiles_longest_first_and_any_order():
    item = list(range(40))
    text = [99, *range(20, 40), 98, *range(0, 20), 97]
    found = tiles(item, text, 5)
    assert sorted(found) == [(20, 0, 22), (20, 20, 1)]
    assert tiles(item, [1, 2, 3, 4, 90, 5, 6, 7, 8], 5) == []
    assert tiles([1] * 10, [1] * 25, 5) == [(10, 0, 0)]


def brute_tiles(item, text, least):
    """Greedy string tiling by looking at all pairs of places."""
    im, tm, out = [False] * len(item), [False] * len(text), 0
    while True:
        best, at = 0, None
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and not im[p + n] and not tm[t + n]:
                    n += 1
                if n > best:
                    best, at = n, (p, t)
        if best < least:
            return out
        im[at[0] : at[0] + best] = tm[at[1] : at[1] + best] = [True] * best
        out += best


def test_tiles_against_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        item = rng.choices(range(5), k=rng.randint(0, 25))
        text = rng.choices(range(5), k=rng.randint(0, 40))
        assert sum(n for n, _, _ in tiles(item, text, 3)) == brute_tiles(item, text, 3)


def test_leaks(spark, nothing):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    item = rng.sample(words, 40)
    other = rng.sample(words, 30)
    swapped = item[20:] + ["zz"] + item[:20]
    filler = [f"f{k}" for k in range(3000)]
    docs = [
        (1, " ".join(filler + item + filler), "x"), (2, " ".join(swapped).upper(), "x"), (3, " ".join(item[:10] + filler), "x"),
        (4, None, "x"), (5, "", "x"), (None, " ".join(other), "x"), (6, "short one", "x"), (1, " ".join(filler + item + filler), "x"),
    ]
    bench = [(10, " ".join(item), "y"), (11, " ".join(other), "y"), (12, None, "y"), (13, "", "y"), (14, "short one", "y"), (10, " ".join(item), "y")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(bench, "item_id long, text string, doc_id string")
    for block in (8_000_000, 100):  # one block, and several
        got = leaks(docs.drop("item_id"), bench.drop("doc_id"), block_bytes=block).collect()
        assert counted((r.doc_id, r.item_id, r.coverage) for r in got) == counted(
            [(1, 10, 1.0), (1, 10, 1.0), (2, 10, 1.0), (None, 11, 1.0), (6, 14, 1.0)]
        )
    empty = spark.createDataFrame([], "item_id long, text string")
    assert leaks(docs, empty).count() == 0 and leaks(nothing, bench).count() == 0


# -- 4: SentencePiece


def test_encoding(odd, odd_rows, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = counted((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in encoded(odd, PIECES).collect())
    want = []
    for i, t in rows(odd_rows):
        ids = library.encode(t)
        want.append((i, len(ids), ",".join(map(str, ids)), library.decode(ids)))
    assert got == counted(want)
    assert encoded(nothing, PIECES).count() == 0


def test_encoding_of_odd_strings():
    from seriesloom.llm.sentencepiece_codec import Codec, read_pieces

    library, mine, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), Codec(read_pieces(PIECES)), random.Random(8)
    pieces = [p for p, k in zip(mine.pieces, mine.kinds) if k == "text"]
    parts = ["a", " ", "  ", "\n", "▁", "é", "中", "🙂", "<s>", "<0x41>", "==", "----", "aaaa", "\x00", "ing", "tion"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(5000)]
    texts += ["".join(rng.choices(pieces, k=rng.randint(1, 6))).replace("▁", " ") for _ in range(5000)]
    texts += [" " * k for k in range(40)] + ["-" * k + "=" * (40 - k) for k in range(40)]
    for text, ids in zip(texts, library.encode(texts)):
        assert mine.text(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids)), text


# -- 5: line dedup

STRIP = " \t\n\x0b\x0c\r"


def brute_lines(docs, least):
    keys = [[line.strip(STRIP).translate(LOW) for line in t.split("\n")] for _, t in docs]
    seen = Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for (i, t), ks in zip(docs, keys):
        lines = t.split("\n")
        kept = [line for line, k in zip(lines, ks) if not k or seen[k] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return counted(out)


@pytest.mark.parametrize("batches,fanout", [(8, 4), (5, 2), (1, 4)])
def test_line_dedup(odd, odd_rows, nothing, batches, fanout):
    got = drop_common_lines(odd, batches=batches, fanout=fanout).collect()
    assert counted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == brute_lines(rows(odd_rows), 10)
    assert drop_common_lines(nothing).count() == 0


def test_arriving_batches(spark):
    runs = LineRuns(spark, fanout=2)
    seen, kept = set(), []
    for n in range(5):
        docs = [(10 * n + k, f"line {n + k}\nagain {k}\nonly {n} {k}") for k in range(3)]
        got = dedup_batch(runs, spark.createDataFrame(docs, "doc_id long, text string"))
        kept += [(r.doc_id, r.kept_text) for r in got.collect()]
        want = [(i, "\n".join(x for x in t.split("\n") if x not in seen)) for i, t in docs]
        assert sorted(kept[-3:]) == want
        seen |= {x for _, t in docs for x in t.split("\n")}
        assert all(len(level) < 2 for level in runs.levels)
    assert len(runs.runs()) == 2  # five runs: one of level 2 (four batches), one of level 0


def test_settled_lines_are_not_carried_on(spark):
    """A compaction settles the lines that are common by then; later batches merge-anti-join them, and counts stay whole."""
    prepare(spark)
    runs, docs = LineRuns(spark, fanout=2, settle=4), []
    for n in range(5):
        batch = [(10 * n + k, f"hot\nslow {n % 2}\nonly {n} {k}") for k in range(2)]
        docs += batch
        runs.add_new(run_of(spark.createDataFrame(batch, "doc_id long, text string")))
        if n == 4:
            hot = hashlib.md5(b"hot").hexdigest()
            assert hot not in {r.line for run in runs.runs() for r in run.collect()}
    seen = Counter(line for _, t in docs for line in t.split("\n"))
    want = {hashlib.md5(line.encode()).hexdigest() for line, n in seen.items() if n >= 4}
    assert {r.line for r in runs.common(4).collect()} == want
    with pytest.raises(ValueError):
        runs.common(5)


# -- 6: near dedup


def shingle_set(text):
    w = WORD.findall(text.translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_near(docs):
    """Smallest id (None last) reachable from each document, over all pairs."""
    sets, up = [shingle_set(t) for _, t in docs], list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(docs)):
        for y in range(x):
            if sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                up[root(x)] = root(y)
    least = defaultdict(list)
    for x, (i, _) in enumerate(docs):
        least[root(x)].append(i)
    found = [min((i for i in least[root(x)] if i is not None), default=None) for x in range(len(docs))]
    return [(i, len(s), c if s else i) for (i, _), s, c in zip(docs, sets, found)]


def test_near_dedup(odd, odd_rows, nothing):
    got = near_groups(odd).collect()
    want = brute_near(rows(odd_rows))
    assert counted((r.doc_id, r.n_shingles, r.component_id) for r in got) == counted(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_groups(nothing).count() == 0


def test_near_dedup_split_into_blocks(spark, monkeypatch):
    """A large group of near copies, with blocks so small that every bucket and cluster is split."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    docs = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
        docs.append((k, " ".join(words)))
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "COLUMNS", 64)
    got = near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert counted((r.doc_id, r.n_shingles, r.component_id) for r in got) == counted(brute_near(docs))


def test_repeated_rows_give_one_set(spark, monkeypatch):
    """Rows that agree in id and text come to the block of their cluster once, not n times."""
    words = [f"w{k}" for k in range(60)]
    docs = [(None, " ".join(words))] * 40 + [(1, " ".join([*words[:-1], "x"]))]
    seen = []

    def only_once(made):
        seen.append(made.groupBy("a", "b").count().agg(F.max("count")).first()[0])
        return dealt(made)

    dealt = near_dedup.in_block_pairs
    df = spark.createDataFrame(docs, "doc_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(near_dedup, "in_block_pairs", lambda x: only_once(x) if "members" in x.columns else dealt(x))
        got = near_groups(df).collect()
    assert seen == [1]
    assert counted((r.doc_id, r.n_shingles, r.component_id) for r in got) == counted(brute_near(docs))


def test_components(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(3, 1), (1, 3), (5, 5), (None, 7), (9, 8), (8, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 1: 1, 3: 1, 5: 5, 7: 7, 8: 7, 9: 7}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_index_finds_all_within_the_radius():
    """Pigeonhole: signatures within the radius share a key, whatever symbols differ."""
    import numpy as np

    rng = np.random.default_rng(1)
    bands, width, radius = near_dedup.BANDS, near_dedup.WIDTH, near_dedup.RADIUS
    a = rng.integers(0, 2**16, (500, bands * width)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(bands * width, radius, replace=False)
        row[at] += rng.integers(1, 2**16, radius).astype(np.uint16)
    keys = [near_dedup.band_keys(x, bands, width, radius) for x in (a, b)]
    assert all(set(x) & set(y) for x, y in zip(*map(np.ndarray.tolist, keys)))


# -- 7: quality


def test_quality(spark, odd, nothing):
    rng = random.Random(6)
    good = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=30)) for _ in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choices(["alpha", "beta", "gamma"], k=30)) for _ in range(100)]
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(good + bad)], "doc_id long, text string, quality string")
    labels = [(k, int(k < 300), 0) for k in range(400)] + [(None, 1, 0), (5, None, 0), (9999, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and len(held) > 50
    assert all((r.predicted == 1) == (r.doc_id < 300) and 0 <= r.score <= 1 for r in held)
    odd_scores = quality_scores(odd, labels).collect()
    assert len(odd_scores) == odd.count() and all(0 <= r.score <= 1 for r in odd_scores)
    assert quality_scores(nothing, labels).count() == 0
    none = {r.score for r in quality_scores(docs, labels.where("false")).select("score").distinct().collect()}
    assert none == {0.5}


def test_dual_descent_separates():
    import numpy as np

    rng = np.random.default_rng(0)
    rows_ = [np.unique(rng.integers(0, 50, 8)) + (50 if k % 2 else 0) for k in range(200)]
    good = np.arange(200) % 2 == 1
    ratio = np.where(np.arange(100) >= 50, 1.0, -1.0)
    model = quality.dual_descent(rows_, good, ratio, 1.0, 10)
    assert all((model.margin(r) > 0) == g for r, g in zip(rows_, good))


# -- 8: repeats


def brute_repeats(docs, length):
    raw = [t.encode() for _, t in docs]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(docs, raw):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return counted(out)


@pytest.mark.parametrize("length,at_once", [(50, 4096), (33, 4096), (50, 2)])
def test_repeats(spark, length, at_once):
    """With two classes at once, almost every anchor is dealt to smaller groups."""
    rng = random.Random(length)
    some = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passages = [some(rng.randint(30, 160)) for _ in range(10)]
    docs = []
    for k in range(60):
        parts = [rng.choice([some(rng.randint(0, 60)), rng.choice(passages), "ab" * rng.randint(0, 40), "é" * rng.randint(0, 30)]) for _ in range(5)]
        docs.append((k, "".join(parts)))
    docs += [(90, docs[3][1]), (91, ""), (92, "x" * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = without_repeats(df, length=length, classes_at_once=at_once).collect()
    assert counted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == brute_repeats(docs, length)


def test_repeats_on_odd_rows(odd, odd_rows, nothing):
    got = without_repeats(odd).collect()
    assert counted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == brute_repeats(rows(odd_rows), 400)
    assert without_repeats(nothing).count() == 0


@pytest.mark.parametrize("at_once", [4096, 2])
def test_repeats_across_the_borders_of_stretches(spark, at_once):
    """The piece size goes to the workers; an anchor that two stretches share is one occurrence."""
    rng = random.Random(1)
    some = lambda n: "".join(rng.choices("abcdef", k=n))
    passage = some(120)
    text = "".join(some(rng.randint(100, 900)) + passage for _ in range(12))
    docs = [(1, text), (2, text[3000:3300]), (3, some(9000)), (4, "ab" * 4000), (5, some(9000))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = without_repeats(df, length=50, classes_at_once=at_once, piece_bytes=2000).collect()
    assert counted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == brute_repeats(docs, 50)


def near_copies(n, size, seed=3):
    rng = random.Random(seed)
    text = "".join(rng.choices("abcdefghij ", k=size))
    out = []
    for k in range(n):
        at = rng.randrange(size - 6)
        out.append((k, text[: at if k % 5 else size // 2] + "".join(rng.choices("XYZ", k=4)) + text[at + 4 :]))
    return out


@pytest.mark.parametrize("at_once", [4096, 5])
def test_repeats_of_a_large_group_of_near_copies(spark, at_once):
    """All copies differ, so every anchor has about as many classes as there are copies."""
    docs = near_copies(120, 1500)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = without_repeats(df, classes_at_once=at_once).collect()
    assert counted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == brute_repeats(docs, 400)


def test_a_common_anchor_does_not_fill_one_task(spark, monkeypatch):
    """Most occurrences are of one anchor, many of one class; no join brings them together in a task."""
    rng = random.Random(5)
    some = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    docs = [(k, "x" * 900 if k % 2 else some(500) + "x" * 430) for k in range(64)] + [(100 + k, some(1200)) for k in range(8)]
    largest = {}

    def largest_share(df):
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        return max(sizes) / sum(sizes)

    def noted(df, name="table", *more):
        if name == "shared":
            largest[name] = largest_share(df)
        return stored(df, name, *more)

    def spans(*args):
        out = repeated_spans(*args)
        largest["spans"] = largest_share(out)
        return out

    prepare(spark)
    # As with large tables: neither are joins turned into broadcasts nor partitions put together.
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    monkeypatch.setattr(repeats, "stored", noted)
    monkeypatch.setattr(repeats, "repeated_spans", spans)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(16).localCheckpoint()
        got = without_repeats(df).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert counted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == brute_repeats(docs, 400)
    assert len(largest) == 2 and max(largest.values()) < 0.3, largest


def test_large_anchors_are_dealt_to_bounded_groups(spark):
    """No group to scan is larger than asked, and a copy enters far fewer ranges than there are strings through an anchor."""
    prepare(spark)
    rows_ = [("", t[700:1100], k) for k, t in near_copies(300, 1500)]
    rows_ += [(t[332:700][::-1], t[700:1100], 1000 + k) for k, t in near_copies(300, 1500)]
    around = spark.createDataFrame([(7, c, c, len(rows_), b.encode(), a.encode()) for b, a, c in rows_],
                                   "anchor long, c1 long, c2 long, m long, before binary, after binary")
    groups, equal = smaller_groups(around, 400, 20)
    sizes = [r["count"] for r in groups.groupBy("anchor").count().collect()]
    assert sizes and max(sizes) <= 20
    assert equal.count() + sum(sizes) < 30 * len(rows_)


# -- 9: language


def test_language(spark, odd, nothing):
    rng = random.Random(7)
    stems = {"aa": ["ba", "ko", "mi", "ta"], "bb": ["zu", "xe", "qy", "wo"], "cc": ["élé", "ñor", "çat", "übe"]}
    made = lambda l: " ".join("".join(rng.choices(stems[l], k=rng.randint(1, 4))) for _ in range(20))
    docs = [(k, made(l), l) for k, l in enumerate(list(stems) * 40)]
    taught = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    asked = [(k, made(l).capitalize(), l) for k, l in enumerate(list(stems) * 20)] + [(900, None, "aa"), (901, " 12 !", "aa"), (None, made("bb"), "bb")]
    got = language_of(spark.createDataFrame(asked, "doc_id long, text string, lang string"), taught, vocabulary=20).collect()
    said = {r.doc_id: r for r in got}
    assert all(said[k].lang_pred == l for k, _, l in asked[:60]) and said[None].lang_pred == "bb"
    assert said[900].lang_pred == said[901].lang_pred == "und" and all(0 <= r.score <= 1 for r in got)
    assert language_of(nothing, taught).count() == 0
    assert {r.lang_pred for r in language_of(odd, nothing).collect()} == {"und"}
    assert language_of(odd, odd).count() == odd.count()


# -- 10: chat


def test_perspectives(spark):
    turns = [
        (1, 0, "system", "Be kind.", "x"), (1, 1, "ann", "Hi", "x"), (1, 2, "bob", None, "x"), (1, 3, "ann", "Bye", "x"),
        (2, 0, "system", "alone", "x"), (None, 1, None, "who?", "x"), (3, None, "ann", "early", "x"), (3, 1, "ann", "late", "x"), (3, 1, "ann", "late", "x"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, speaker string")
    got = perspectives(df).collect()
    assert sorted((r.conv_id or 0, r.speaker, r.block) for r in got) == [(0, "unknown", 0), (1, "ann", 0), (1, "bob", 0), (3, "ann", -1), (3, "ann", 0)]
    ann = next(r for r in got if r.conv_id == 1 and r.speaker == "ann")
    assert ann.text == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n"
        "<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\nBye<|im_end|>\n"
    )
    assert [ann.text[s.start : s.stop] for s in ann.mask] == ["Hi<|im_end|>", "Bye<|im_end|>"]
    assert perspectives(df.where("false")).count() == 0


def test_blocks_join_to_the_whole(spark):
    turns = [(1, k, "ab"[k % 2], f"text {k}") for k in range(50)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    whole = {r.speaker: r for r in perspectives(df).collect()}
    parts = perspectives(df, block_turns=7).orderBy("speaker", "block").collect()
    for who, r in whole.items():
        mine = [p for p in parts if p.speaker == who]
        assert "".join(p.text for p in mine) == r.text and [s for p in mine for s in p.mask] == r.mask
        assert [p.start for p in mine] == [sum(len(q.text) for q in mine[:k]) for k in range(len(mine))]


def test_native_chat_plan(spark):
    df = spark.createDataFrame([(1, 0, "a", "x")], "conv_id long, turn long, role string, text string")
    plan = perspectives(df.withColumn("role", F.upper("role")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_only_numbers_meet_across_the_blocks_of_a_conversation(spark):
    """No window sees a text; blocks of a null conversation and of turns without number find their start."""
    turns = [(c, t, "ab"[k % 2], f"text {k} é") for c in (None, 1) for k, t in enumerate([None, None, *range(40), 3, 3])]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = perspectives(df, block_turns=7)
    assert not {"text", "lines", "body", "end"} & set(columns_under_windows(got._jdf.queryExecution().optimizedPlan()))
    for c in (None, 1):
        for who in "ab":
            mine = sorted((r for r in got.collect() if (r.conv_id, r.speaker) == (c, who)), key=lambda r: r.block)
            assert [r.block for r in mine] == [-1, *range(6)] and sum(r.n_turns for r in mine) == 44
            assert [r.start for r in mine] == [sum(len(q.text) for q in mine[:k]) for k in range(len(mine))]
            whole = "".join(r.text for r in mine)
            assert all(whole[s.start : s.stop].endswith("é<|im_end|>") for r in mine for s in r.mask)


def columns_under_windows(plan):
    children = [plan.children().apply(k) for k in range(plan.children().size())]
    if plan.nodeName() == "Window":
        out = children[0].output()
        yield from (out.apply(k).name() for k in range(out.size()))
    for child in children:
        yield from columns_under_windows(child)
