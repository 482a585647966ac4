"""Registered queries of this subpackage, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.chat import perspectives
from seriesloom.llm.collocations import collocations
from seriesloom.llm.decontaminate import leaks
from seriesloom.llm.exact_dedup import exact_groups
from seriesloom.llm.language import language_of
from seriesloom.llm.lexical import ranked
from seriesloom.llm.line_dedup import drop_common_lines
from seriesloom.llm.near_dedup import near_groups
from seriesloom.llm.quality import fold, quality_scores
from seriesloom.llm.repeats import without_repeats
from seriesloom.llm.sentencepiece_codec import encoded_digests
from seriesloom.llm.session import documents
from seriesloom.llm.sharding import shards
from seriesloom.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


@query(
    "op2_exact_dedup",
    """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
)
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal documents; the largest id stays."""
    return exact_groups(documents(spark, folder)).drop("key_a", "key_b")


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the benchmark items they give away."""
    return leaks(documents(spark, folder), documents(spark, folder, "benchmark")).drop("key_a", "key_b")


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    coded = encoded_digests(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.drop("key_a", "key_b")


@query(
    "op5_line_dedup",
    """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (c.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c ON keyed.k = c.k GROUP BY doc_id""",
)
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of at least ten documents dropped everywhere."""
    kept = drop_common_lines(documents(spark, folder))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op6_near_dedup")
def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents with similarity 0.75 or more; the smallest id stays."""
    return near_groups(documents(spark, folder)).drop("key_a", "key_b")


@query("op7_quality")
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    return quality_scores(documents(spark, folder), documents(spark, folder, "labels"))


@query("op8_repeats")
def op8_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes under repeated strings of 400 bytes removed."""
    kept = without_repeats(documents(spark, folder))
    return kept.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op9_language")
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = documents(spark, folder)
    held = fold("doc_id", 3) == 1
    named = language_of(docs, docs.where(~held))
    return named.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query(
    "op10_chat_formatting",
    """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS body,
         coalesce(CAST(floor(turn / 256.0) AS BIGINT), -1) AS block FROM conversations),
people AS (SELECT DISTINCT conv_id, name AS speaker FROM said WHERE name <> 'system'),
seen AS (
  SELECT said.*, speaker, name = speaker AS own,
         '<|im_start|>' || CASE WHEN name = speaker THEN 'assistant' WHEN name = 'system' THEN 'system'
                           ELSE 'user name=' || name END || chr(10) AS head
  FROM said JOIN people ON said.conv_id IS NOT DISTINCT FROM people.conv_id),
placed AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS piece,
         sum(length(head) + length(body) + 11) OVER w - length(body) - 11 AS a FROM seen
  WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, name, body ROWS UNBOUNDED PRECEDING)),
blocks AS (
  SELECT conv_id, speaker, block, count(*) AS n_turns,
         string_agg(piece, '' ORDER BY turn NULLS FIRST, name, body) AS text,
         min(a - length(head)) AS start,
         coalesce(string_agg(CAST(a AS BIGINT) || '-' || CAST(a + length(body) + 10 AS BIGINT), ',' ORDER BY a) FILTER (own), '') AS mask
  FROM placed GROUP BY 1, 2, 3)
SELECT conv_id, speaker, block, n_turns, text, CAST(start AS BIGINT) AS start, mask FROM blocks""",
)
def op10_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation from the perspective of each participant."""
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["stop"]))
    return perspectives(documents(spark, folder, "conversations")).withColumn("mask", F.array_join(spans, ","))


@query(
    "op11_lexical_search",
    r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS d,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sizes AS (SELECT d, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT count(*) AS dn, CAST(sum(n) AS BIGINT) AS ln FROM sizes),
held AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) AS x GROUP BY ALL),
asked AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) AS x),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * dn + 2) / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term) AS x, total),
norms AS (SELECT d, doc_id, 100 - 50 + ((50 * n * dn) // ln) AS m FROM sizes, total),
scored AS (
  SELECT item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN norms USING (d) GROUP BY ALL),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ordered WHERE rank <= 50""",
)
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return ranked(documents(spark, folder), documents(spark, folder, "benchmark"))


@query(
    "op12_collocations",
    r"""
WITH texts AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
pieces AS (SELECT d, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS p FROM texts),
parts AS (SELECT d, lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
said AS (SELECT d, lang, p, unnest(words) AS w1, generate_subscripts(words, 1) AS spot FROM parts),
seen AS (SELECT lang, w1, lead(w1) OVER g AS w2, lead(w1, 2) OVER g AS w3 FROM said WINDOW g AS (PARTITION BY d, p ORDER BY spot)),
one AS (SELECT lang, w1, count(*) AS f FROM seen GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS f FROM seen WHERE w2 IS NOT NULL GROUP BY ALL),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM seen WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(f) AS n FROM one GROUP BY lang),
around AS (
  SELECT lang, w1, w2, max(f) AS more
  FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) AS edges GROUP BY ALL),
cuts AS (
  SELECT two.lang, two.w1 || ' ' || two.w2 AS phrase, two.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM two JOIN one AS x ON x.lang = two.lang AND x.w1 = two.w1 JOIN one AS y ON y.lang = two.lang AND y.w1 = two.w2
       LEFT JOIN around AS o ON o.lang = two.lang AND o.w1 = two.w1 AND o.w2 = two.w2
  WHERE two.f >= 10 AND (o.more IS NULL OR 100 * o.more < 50 * two.f)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f
  FROM three AS t JOIN one AS x ON x.lang = t.lang AND x.w1 = t.w1 JOIN two AS y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f
  FROM three AS t JOIN two AS x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one AS y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
)
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases of two and three words whose parts belong together most, per language."""
    return collocations(documents(spark, folder))


@query(
    "op13_sharding",
    """
WITH RECURSIVE crcs AS (
  SELECT range AS i, range::UBIGINT AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM crcs WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crcs WHERE k = 8),
texts AS (SELECT DISTINCT coalesce(text, '') AS body FROM documents),
summed AS (
  SELECT body, xor(4294967295::UBIGINT, list_reduce(
      list_prepend(4294967295::UBIGINT,
                   list_transform(range(octet_length(encode(body))),
                                  lambda k: ('0x' || substr(hex(encode(body)), 2 * k + 1, 2))::UBIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) % 256)::INT + 1]))) AS crc FROM texts, crc_table),
records AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, coalesce(text, '') AS body FROM documents),
placed AS (
  SELECT *, sum(size) OVER w - size AS before, row_number() OVER w - 1 AS spot, sum(size) OVER () AS total,
         sum(size) OVER (PARTITION BY body) AS whole
  FROM records WINDOW w AS (ORDER BY md5(body), md5(CAST(doc_id AS VARCHAR)))),
started AS (SELECT *, min(before) OVER (PARTITION BY body) AS start FROM placed),
dealt AS (
  SELECT *, CAST(least(7, (8 * CASE WHEN whole * 8 <= 0.02 * total THEN 2 * start + whole ELSE 2 * before + size END) // (2 * total)) AS INTEGER) AS shard
  FROM started)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(spot - min(spot) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt JOIN summed USING (body)""",
)
def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in one of eight shards of near equal bytes."""
    return shards(documents(spark, folder))
