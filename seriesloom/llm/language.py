"""Language identification by words first, then ever shorter character n-grams.

Words the model knows score by their log frequency per language. An unseen word scores by those of its character n-grams
that the model has seen, the longest length first that has any; a space stands for its borders.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.flat import SpanHash, flat, mix, pieces, words
from seriesloom.llm.session import prepare, stored

LENGTHS = (5, 4, 3, 2, 1)
BITS = 17
PLACES = 1 << BITS
UNKNOWN = "und"


def letters(text: Column) -> Column:
    """Lower-cased letters and their marks as UTF-8, everything else as spaces; empty for null or no letter."""
    clean = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")
    return F.when(text.rlike(r"\p{L}"), clean).otherwise(F.lit("")).cast("binary")


def gram_places(code: np.ndarray, n: int) -> np.ndarray:
    """Place of the n-gram that begins at each code point (the last n - 1 have none)."""
    value = np.full(max(0, len(code) - n + 1), n, np.uint64)
    for k in range(n):
        value = mix(value ^ code[k : len(value) + k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (value >> np.uint64(64 - BITS)).astype(np.int64)


def spelled(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words with a space around each, and where each word starts and stops (without spaces)."""
    text = " " + b" ".join(found).decode("utf-8", "replace") + " "
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    gaps = np.flatnonzero(code == 32)
    return code, gaps[:-1] + 1, gaps[1:]


@dataclass
class Model:
    """Known words (sorted hashes) and hashed n-grams, each with a log frequency per language."""

    languages: list[str]
    known: np.ndarray
    word_scores: np.ndarray
    gram_scores: dict[int, np.ndarray]
    gram_seen: dict[int, np.ndarray]

    def unseen(self, found: list[bytes]) -> np.ndarray:
        """Scores of unseen words: mean log frequency of their seen n-grams of the longest length that has any."""
        out = np.zeros((len(found), len(self.languages)))
        todo = np.ones(len(found), bool)
        code, start, stop = spelled(found)
        for n in LENGTHS:
            if not todo.any():
                break
            # Bordered words have stop - start + 2 characters; single characters leave the borders out.
            first, last = (start - 1, stop + 1 - n + 1) if n > 1 else (start, stop)
            last = np.maximum(first, np.minimum(last, len(code) - n + 1))
            place = gram_places(code, n)
            seen = self.gram_seen[n][place]
            count = np.append(0, np.cumsum(seen))
            have = count[last] - count[first]
            mine = np.flatnonzero(todo & (have > 0))
            for l in range(len(self.languages)):
                total = np.append(0.0, np.cumsum(np.where(seen, self.gram_scores[n][place, l], 0.0)))
                out[mine, l] = (total[last] - total[first])[mine] / have[mine]
            todo[mine] = False
        return out

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and its share of the likelihood for every text."""
        start, stop, first = words(data, offsets)
        n = len(offsets) - 1
        if not len(start) or not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        value = SpanHash(data)(start, stop)
        distinct, at, inverse = np.unique(value, return_index=True, return_inverse=True)
        scores = np.zeros((len(distinct), len(self.languages)))
        slot = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        hit = self.known[slot] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        scores[hit] = self.word_scores[slot[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            scores[miss] = self.unseen([data[start[k] : stop[k]].tobytes() for k in at[miss]])
        total = np.zeros((n, len(self.languages)))
        full = np.flatnonzero(np.diff(first))
        total[full] = np.add.reduceat(scores[inverse], first[full], axis=0)
        best = total.argmax(axis=1)  # the first in order among equals
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        empty = np.diff(first) == 0
        named = [UNKNOWN if e else self.languages[b] for e, b in zip(empty, best)]
        return named, np.where(empty, 0.0, share)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", vocabulary: int = 100_000) -> Model:
    """Learn from the rows with a language.

    All words of all rows are counted. The model keeps the ``vocabulary`` words that are most frequent in
    some language (a parameter of the model: rarer words go by their n-grams), and counts of the n-grams of all words in
    a fixed number of hashed places per length, so its size is bounded by the vocabulary and the number of languages.
    """
    spark = prepare(docs.sparkSession)
    said = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.explode(F.split(letters(F.col(text_col)).cast("string"), " ")).alias("word")
    )
    counted = stored(said.where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0)), {}, {})
    share = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for p in totals.items() for x in p]), F.col("lang"))
    per_word = counted.groupBy("word").agg(
        F.max(share).alias("share"), *[F.sum(F.when(F.col("lang") == l, F.col("n"))).alias(f"n{k}") for k, l in enumerate(languages)]
    )
    top = per_word.orderBy(F.desc("share"), "word").limit(vocabulary).toPandas()
    raw = [w.encode() for w in top["word"]]
    offsets = np.append(0, np.cumsum([len(w) for w in raw])).astype(np.int64)
    value = SpanHash(np.frombuffer(b"".join(raw), np.uint8))(offsets[:-1], offsets[1:])
    order = np.argsort(value)
    n = top[[f"n{k}" for k in range(len(languages))]].fillna(0).to_numpy(float)[order]
    all_words = np.array([totals[l] for l in languages], float)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros((PLACES, len(languages))) for k in LENGTHS}
        for batch in batches:
            if not batch.num_rows:
                continue
            which = np.searchsorted(languages, batch.column(0).to_pylist())
            weight = batch.column(2).to_numpy().astype(float)
            code, start, stop = spelled(batch.column(1).cast(pa.binary()).to_pylist())
            for k in LENGTHS:
                first, last = (start - 1, stop + 1 - k + 1) if k > 1 else (start, stop)
                last = np.minimum(last, len(code) - k + 1)
                size = np.maximum(0, last - first)
                owner = np.repeat(np.arange(len(size)), size)
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[owner]
                flat_place = gram_places(code, k)[at] * len(languages) + which[owner]
                held[k] += np.bincount(flat_place, weight[owner], PLACES * len(languages)).reshape(PLACES, -1)
        for k in LENGTHS:
            place, lang = np.nonzero(held[k])
            columns = [pa.array(np.full(len(place), k, np.int32)), pa.array(place), pa.array(lang), pa.array(held[k][place, lang].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["length", "place", "lang", "n"])

    spread = counted.select("lang", "word", "n").mapInArrow(grams, "length int, place long, lang long, n long")
    sums = spread.groupBy("length", "place", "lang").agg(F.sum("n").alias("n")).toPandas()
    scores, seen = {}, {}
    for k in LENGTHS:
        mine = sums[sums["length"] == k]
        table = np.zeros((PLACES, len(languages)))
        table[mine["place"], mine["lang"]] = mine["n"]
        seen[k] = table.any(axis=1)
        scores[k] = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * PLACES)).astype(np.float32)
    known_scores = np.log((n + 0.5) / (all_words + 0.5 * max(1, len(n))))
    return Model(languages, value[order], known_scores, scores, seen)


def language_column(spark: SparkSession, model: Model, text_col: str = "text") -> Column:
    """``struct<lang_pred, score>`` of a text column, computed in Arrow batches.

    A null text, or one without a letter, is ``und`` with score 0.
    """
    shared = prepare(spark).sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(column: pa.Array) -> pa.Array:
        data, offsets = flat(column)
        named, shares = [], [np.zeros(0)]
        for i, j in pieces(offsets):
            lang, share = shared.value.texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            named += lang
            shares.append(share)
        return pa.StructArray.from_arrays([pa.array(named, pa.string()), pa.array(np.concatenate(shares))], ["lang_pred", "score"])

    return predict(letters(F.col(text_col)))


def language_of(
    docs: DataFrame, taught: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: int = 100_000
) -> DataFrame:
    """Learn from ``taught`` and name the language of every row of ``docs``: id, ``lang_pred``, ``score``.

    The score is the language's share of the likelihood over all languages. Only texts enter a prediction. Without anything to learn
    from all rows are ``und``. Repeated rows come back as often as they came, null ids stay null, an empty table
    gives an empty table; further columns are not read.
    """
    model = fit(taught, text_col, lang_col, vocabulary)
    said = docs.select(F.col(id_col), language_column(docs.sparkSession, model, text_col).alias("said"))
    return said.select(id_col, "said.lang_pred", "said.score")
