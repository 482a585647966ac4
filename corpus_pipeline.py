"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's input.

1. quality: documents that the classifier rejects go.
2. exact: of equal texts the one with the largest id stays.
3. near: of near duplicates (five-word shingles, similarity 0.75) the one with the smallest id stays.
4. decontamination: documents that give away a benchmark item go.
5. encoding: SentencePiece ids of what is left, checked by decoding.

Null, empty and very long texts, null and repeated ids, empty tables and further columns are handled as the operators'
docstrings say; rows that repeat both id and text leave stage 2 once. All stages but the last return the columns they got.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.decontaminate import leaks
from seriesloom.llm.exact_dedup import exact_groups
from seriesloom.llm.near_dedup import near_groups
from seriesloom.llm.quality import fit, fold, score_column
from seriesloom.llm.sentencepiece_codec import encoded
from seriesloom.llm.session import chosen, documents, stored

#: Score from which a document stays, and the fold of ids whose labels are left for evaluation.
THRESHOLD, FOLDS, HELD = 0.7, 4, 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = documents(spark, sf_dir, "labels").where(fold("doc_id", FOLDS) != HELD)
    return docs.where(score_column(spark, fit(docs, labels), "text") >= THRESHOLD)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return chosen(docs, exact_groups(docs).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return chosen(docs, near_groups(docs).where("kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away."""
    return chosen(docs, leaks(docs, documents(spark, sf_dir, "benchmark")), "left_anti")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Id, number of tokens, token ids and the digest of the text they decode to."""
    coded = encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.when(F.col("n_tokens") > 0, F.split("ids", ",").cast("array<int>")).otherwise(F.array().cast("array<int>"))
    return coded.select("doc_id", "n_tokens", ids.alias("ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("exact", exact),
    ("near", near),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: A fitted model, components of links and a tokenizer: not SQL. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
