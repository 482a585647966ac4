"""The corpus pipeline stage by stage against brute force, and the registered queries."""

import duckdb
import pytest
from conftest import SMALL
from tools.check_oracles import TABLES, canonical

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from seriesloom.llm.session import documents
from odd_rows import nothing, odd, odd_rows  # noqa: F401  (fixtures)
from test_operators import WORD, brute_near, brute_tiles, LOW, sentencepiece, PIECES, sha

NAMES = [f"op{n}_" for n in range(1, 11)]


def test_all_operators_are_registered():
    names = set(queries())
    assert all(sum(n.startswith(p) for n in names) == 1 for p in NAMES) and "pipeline" in names


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op5_line_dedup", "op10_chat_formatting"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want, got = con.execute(oracle_sql()[name]).df(), queries()[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = documents(spark, SMALL)
    good = corpus_pipeline.quality(spark, docs, SMALL)
    labels = {r.doc_id: r.quality for r in documents(spark, SMALL, "labels").collect()}
    kept = {i for i, _ in pairs(good)}
    known = [i for i, _ in pairs(docs) if i in labels]
    assert sum((i in kept) == (labels[i] == 1) for i in known) >= 0.95 * len(known)

    single = corpus_pipeline.exact(spark, docs, SMALL)
    last = {t: i for i, t in sorted(pairs(docs))}
    assert sorted(pairs(single)) == sorted((i, t) for t, i in last.items()) and single.columns == docs.columns

    apart = corpus_pipeline.near(spark, single, SMALL)
    want = [i for i, _, c in brute_near(pairs(single)) if i == c]
    assert sorted(i for i, _ in pairs(apart)) == sorted(want) and apart.columns == docs.columns

    clean = corpus_pipeline.decontamination(spark, apart, SMALL)
    items = [WORD.findall(r.text.translate(LOW)) for r in documents(spark, SMALL, "benchmark").collect()]
    want = []
    for i, t in pairs(apart):
        w = WORD.findall(t.translate(LOW))
        seeds = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        near = [x for x in items if any(tuple(x[k : k + 5]) in seeds for k in range(len(x) - 4))]
        if not any(2 * brute_tiles(x, w, 5) >= len(x) for x in near):
            want.append(i)
    assert sorted(i for i, _ in pairs(clean)) == sorted(want) and clean.columns == docs.columns

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: (r.n_tokens, r.ids, r.decoded_sha256) for r in corpus_pipeline.encoding(spark, clean, SMALL).collect()}
    assert got == {i: (len(x := library.encode(t)), x, sha(library.decode(x))) for i, t in pairs(clean)}


def test_stages_take_odd_rows(spark, odd, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SMALL).count() == 0
        out = stage(spark, odd, SMALL)
        assert out.count() > 0
        if name != "encoding":
            assert out.columns == odd.columns
