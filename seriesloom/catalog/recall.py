"""Embedding, similarity and the memory store."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.catalog.registry import Tables, lineitem_by, orders_by, query, r
from seriesloom.catalog.sources import frequency_sql
from seriesloom.operators import vectors as V
from seriesloom.plans.jobs import run_forecast

WORDS = ("the", "and", "que", "license", "email")

_COUNTS = ", ".join(f"((length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)})::FLOAT" for w in WORDS)


@query(
    "embed_documents",
    "SELECT doc_id, 5 AS dim, " + ", ".join(f"((length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)})::DOUBLE AS n_{w}" for w in WORDS) + " FROM documents",
)
def _(t: Tables):
    done = V.embed(t.table("documents"), "text", V.WordCountEmbedder(words=WORDS))
    return done.select("doc_id", "dim", *[F.col("embedding")[i].cast("double").alias(f"n_{w}") for i, w in enumerate(WORDS)])


@query(
    "unit_vectors",
    """SELECT vec_id, i::INT AS i, round(x / greatest(sqrt(list_dot_product(e, e)), 1e-12), 6) AS x
FROM (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)""",
)
def _(t: Tables):
    rows = t.table("embeddings").select("vec_id", F.posexplode(V.unit(F.col("embedding"))).alias("i", "x"))
    return rows.select("vec_id", "i", r("x").alias("x"))


# Mean vector of each label, and of the whole table.
_CENTRES = """SELECT label AS query_id, list(x ORDER BY i) AS q FROM (SELECT label, i, avg(x) AS x FROM
 (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1"""
_CENTRE = _CENTRES.replace("label AS query_id", "0 AS query_id").replace("(SELECT label, i, avg(x)", "(SELECT i, avg(x)").replace("GROUP BY 1, 2) GROUP BY 1", "GROUP BY 1) GROUP BY 1").replace("(SELECT label, unnest", "(SELECT unnest")


def topk_sql(queries: str, k: int) -> str:
    return f"""SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT query_id, id, score,
 row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id)::INT AS rank FROM (SELECT query_id, vec_id AS id,
 list_dot_product(embedding::DOUBLE[], q) / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)
  / greatest(sqrt(list_dot_product(q, q)), 1e-12) AS score FROM embeddings, ({queries}))) WHERE rank <= {k}"""


def centres(t: Tables, by_label: bool):
    key = F.col("label") if by_label else F.lit(0)
    cells = t.table("embeddings").select(key.alias("query_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = cells.groupBy("query_id", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c")).select(
        "query_id", F.col("c.x").alias("embedding")
    )


@query("cosine_top_k_single", topk_sql(_CENTRE, 10))
def _(t: Tables):
    return V.cosine_top_k(t.table("embeddings"), centres(t, False), 10, "vec_id").withColumn("score", r("score"))


@query("cosine_top_k_batch", topk_sql(_CENTRES, 5))
def _(t: Tables):
    return V.cosine_top_k(t.table("embeddings"), centres(t, True), 5, "vec_id").withColumn("score", r("score"))


@query("cosine_top_k_all", topk_sql("SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings", 3))
def _(t: Tables):
    vectors = t.table("embeddings")
    return V.cosine_top_k(vectors, vectors, 3, "vec_id", "vec_id").withColumn("score", r("score"))


_SPACES = "SELECT vec_id, 'space-' || label AS embedding_model, len(embedding)::INT AS dim FROM embeddings"


@query("same_space", f"SELECT * FROM ({_SPACES}) WHERE embedding_model = 'space-3' AND dim = 64")
def _(t: Tables):
    spaces = t.table("embeddings").select(
        "vec_id", F.concat(F.lit("space-"), F.col("label").cast("string")).alias("embedding_model"), F.size("embedding").alias("dim")
    )
    return V.same_space(spaces, "space-3", 64)


@query(
    "remember",
    """WITH n AS (SELECT label AS job, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS k FROM embeddings)
SELECT job::VARCHAR AS job_id, 'new' AS model_name, vec_id AS source FROM n WHERE k = 1
UNION ALL SELECT vec_id::VARCHAR, 'old', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT job FROM n)""",
)
def _(t: Tables):
    """Every vector is remembered once, then the vectors again under their label as job id."""
    rows = t.table("embeddings").select(
        F.col("vec_id").cast("string").alias("job_id"), F.col("label").cast("string").alias("label"), F.lit("text").alias("text"),
        F.lit("old").alias("model_name"), F.create_map(F.lit("source"), F.col("vec_id").cast("string")).alias("meta"),
        "embedding", F.lit("test").alias("embedding_model"), F.size("embedding").alias("dim"), F.timestamp_seconds("vec_id").alias("created_at"),
    )
    new = rows.withColumn("job_id", F.col("label")).withColumn("model_name", F.lit("new"))
    store = V.remember(rows.drop("label"), new.drop("label"))
    return store.select("job_id", "model_name", F.col("meta")["source"].cast("bigint").alias("source"))


QUERY = "The license and the email, and what the rest says"


@query(
    "recall_by_text",
    f"""WITH d AS (SELECT doc_id, source, text, [{_COUNTS}]::DOUBLE[] AS e FROM documents),
q AS (SELECT [{_COUNTS}]::DOUBLE[] AS q FROM (SELECT '{QUERY}' AS text)),
s AS (SELECT doc_id, source, text, list_dot_product(e, q) / greatest(sqrt(list_dot_product(e, e)), 1e-12) / greatest(sqrt(list_dot_product(q, q)), 1e-12) AS score FROM d, q),
k AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id)::INT AS rank FROM s)
SELECT rank, doc_id::VARCHAR AS job_id, round(score, 6) AS score, source AS model_name, text FROM k WHERE rank <= 10""",
)
def _(t: Tables):
    embedder = V.WordCountEmbedder(words=WORDS)
    memories = V.embed(
        t.table("documents").select(
            F.col("doc_id").alias("job_id"), "text", F.col("source").alias("model_name"),
            F.create_map(F.lit("lang"), F.col("lang")).alias("meta"), F.timestamp_seconds("doc_id").alias("created_at"),
        ),
        "text", embedder,
    )
    return V.recall(memories, QUERY, 10, embedder).select(
        "rank", F.col("job_id").cast("string").alias("job_id"), r("score").alias("score"), "model_name", "text"
    )


def _memories(t: Tables):
    panel = t.lineitem()
    wanted = panel.select("series_id").distinct().select(
        F.col("series_id").alias("job_id"), "series_id", F.lit("ets").alias("model_name"), F.lit(12).alias("horizon"), F.lit(True).alias("conformal")
    )
    return panel, V.memories_from_jobs(run_forecast(panel, wanted).jobs, V.WordCountEmbedder())


@query(
    "memories_from_jobs",
    f"""SELECT series_id AS job_id, 'ets' AS model_name, 'y' AS target_column, '12' AS horizon, 'true' AS conformal, 'monthly' AS frequency,
 count(*)::VARCHAR AS row_count, 'word-count' AS embedding_model, {len(V.VOCABULARY)} AS dim FROM ({lineitem_by('month')}) GROUP BY 1""",
)
def _(t: Tables):
    _, memories = _memories(t)
    fields = ("target_column", "horizon", "conformal", "frequency", "row_count")
    return memories.select("job_id", "model_name", *[F.col("meta")[f].alias(f) for f in fields], "embedding_model", "dim")


@query("recall_by_series")
def _(t: Tables):
    panel, memories = _memories(t)
    return V.recall_by_series(memories, panel, 2).drop("created_at", "meta")


_PHRASES = "[" + ", ".join(f"'{w}'" for w in V.VOCABULARY) + "]"


def _counted(text: str) -> str:
    return f"list_transform({_PHRASES}, lambda w: ((length(lower({text})) - length(replace(lower({text}), w, ''))) / length(w))::DOUBLE)"


@query(
    "recall_by_flat_series",
    f"""WITH m AS (SELECT p_partkey, {_PHRASES}[p_size % {len(V.VOCABULARY)} + 1] || ', ' || {_PHRASES}[p_partkey % {len(V.VOCABULARY)} + 1] AS text FROM part),
d AS (SELECT series_id, concat_ws(chr(10), 'Dataset: some rows, ' || frequency || ' frequency.', 'Target column: ''y''.', 'No missing values in target column.',
 'Series is stationary.', 'No clear seasonality detected.', 'No anomalies detected.') AS text FROM ({frequency_sql(orders_by('day'))})),
a AS (SELECT p_partkey, text, {_counted('text')} AS e FROM m), q AS (SELECT series_id, {_counted('text')} AS q FROM d),
s AS (SELECT series_id, p_partkey, text,
  list_dot_product(e, q) / greatest(sqrt(list_dot_product(e, e)), 1e-12) / greatest(sqrt(list_dot_product(q, q)), 1e-12) AS score FROM a, q),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(score, 12) DESC, p_partkey)::INT AS rank FROM s)
SELECT series_id AS query_id, rank, p_partkey AS job_id, round(score, 6) AS score, text FROM k WHERE rank <= 5""",
)
def _(t: Tables):
    """Memories that hold two phrases of digests each, recalled by the digests of daily series that never change."""
    phrases = F.array(*[F.lit(w) for w in V.VOCABULARY])
    word = lambda c: phrases[F.col(c) % len(V.VOCABULARY)]
    memories = V.embed(
        t.table("part").select(
            F.col("p_partkey").alias("job_id"), F.concat_ws(", ", word("p_size"), word("p_partkey")).alias("text"), F.lit("ets").alias("model_name"),
            F.create_map(F.lit("brand"), F.col("p_brand")).alias("meta"), F.timestamp_seconds("p_partkey").alias("created_at"),
        ),
        "text", V.WordCountEmbedder(),
    )
    found = V.recall_by_series(memories, t.orders().select("series_id", "ts", F.lit(1.0).alias("y")), 5)
    return found.select("query_id", "rank", "job_id", r("score").alias("score"), "text")
