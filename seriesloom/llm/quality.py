"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: of bytes (1 to 3) and of word shapes (1 to 3; capitals, final sign, repetition of the
word before), hashed to a fixed number of places. Each is scaled by the log ratio of its share in good and in bad
documents, counted over all labelled rows; a linear hinge-loss model on the scaled, unit-length vectors is
fitted by dual coordinate descent, and a logistic curve turns its margin into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.flat import SpanHash, flat, pieces, words
from seriesloom.llm.session import body, prepare

BITS = 17
PLACES = 1 << BITS
#: Odd multipliers of the feature hashes, one per kind and length of n-gram.
SPREAD = np.array([3266489917, 2654435761, 2246822519, 668265263, 374761393, 1181783497], np.uint32)

_upper, _lower, _letterless = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_upper[65:91] = True
_lower[97:123] = True
_letterless[33:127] = True
_letterless[65:91] = _letterless[97:123] = _letterless[48:58] = False
#: Byte classes at a word's end: other, sentence end, comma, further signs.
ENDING = np.zeros(256, np.uint32)
ENDING[_letterless] = 3
ENDING[[33, 46, 63]] = 1
ENDING[[44, 58, 59]] = 2


def _place(code: np.ndarray, kind: int) -> np.ndarray:
    return (code.astype(np.uint32) * np.uint32(8) + np.uint32(kind)) * SPREAD[kind] >> np.uint32(32 - BITS)


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Places of the n-grams that occur in each text, ascending and distinct."""
    b = data.astype(np.uint32)
    byte_grams = [_place(b, 0)]
    if len(b) > 1:
        two = b[:-1] << np.uint32(8) | b[1:]
        byte_grams.append(_place(two, 1))
    if len(b) > 2:
        byte_grams.append(_place(two[:-1] << np.uint32(8) | b[2:], 2))
    start, stop, first = words(data, offsets)
    shape = np.zeros(0, np.uint32)
    if len(start):
        value = SpanHash(data)(start, stop)
        second = data[np.minimum(start + 1, stop - 1)]
        same = np.append(False, value[1:] == value[:-1])
        same[first[:-1][first[:-1] < len(start)]] = False
        shape = (
            _upper[data[start]].astype(np.uint32)
            | (_upper[second] & (stop - start > 1)).astype(np.uint32) << np.uint32(1)
            | same.astype(np.uint32) << np.uint32(2)
            | ENDING[data[stop - 1]] << np.uint32(3)
            | (stop - start == 1).astype(np.uint32) << np.uint32(5)
        )
    shapes = [_place(shape, 3)]
    if len(shape) > 1:
        pair = shape[:-1] << np.uint32(6) | shape[1:]
        shapes.append(_place(pair, 4))
    if len(shape) > 2:
        shapes.append(_place(pair[:-1] << np.uint32(6) | shape[2:], 5))
    out, seen = [], np.zeros(PLACES, bool)
    for i in range(len(offsets) - 1):
        parts = [g[offsets[i] : max(offsets[i], offsets[i + 1] - n)] for n, g in enumerate(byte_grams)]
        parts += [g[first[i] : max(first[i], first[i + 1] - n)] for n, g in enumerate(shapes)]
        if offsets[i + 1] - offsets[i] < 2000:
            out.append(np.unique(np.concatenate(parts)))
            continue
        for p in parts:
            seen[p] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        out.append(found)
    return out


@dataclass
class Model:
    """Log ratios, weights on the scaled features, bias, and the logistic curve of the margin."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, places: np.ndarray) -> float:
        x = self.ratio[places]
        size = np.sqrt(x @ x)
        return float(self.weights[places] @ x / size + self.bias) if size > 0 else self.bias

    def score(self, places: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(places) + self.shift, -30, 30))))


def dual_descent(rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray, cost: float, rounds: int, seed: int = 1) -> Model:
    """Minimise |w|^2 / 2 + cost * sum(hinge) over unit-length rows, one dual variable at a time."""
    sign = np.where(good, 1.0, -1.0)
    weights, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    scaled = [ratio[r] / max(1e-9, np.sqrt(ratio[r] @ ratio[r])) for r in rows]
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in random.permutation(len(rows)):
            gradient = sign[k] * (weights[rows[k]] @ scaled[k] + bias) - 1
            # A row's squared length is 1, and 1 more for the constant that carries the bias.
            new = min(max(alpha[k] - gradient / 2, 0.0), cost)
            step = (new - alpha[k]) * sign[k]
            if step:
                weights[rows[k]] += step * scaled[k]
                bias += step
                alpha[k] = new
    return Model(ratio, weights, bias)


def logistic(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of largest likelihood (Newton steps, smoothed targets)."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = 8000,
    cost: float = 1.0,
    rounds: int = 10,
) -> Model:
    """Learn from the labelled documents (label 1: good, 0: bad).

    The n-gram counts cover all labelled rows. The hinge-loss model is fitted on at most ``sample_rows`` of them, those
    with the smallest hashed ids; a fifth of these, not fitted on, sets the logistic curve. Rows with a null id or
    label teach nothing, several labels of an id are averaged. Without rows of both
    classes every score is the share of good rows, or 0.5 without any.
    """
    prepare(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    marked = marked.groupBy("id").agg((F.avg("label") >= 0.5).alias("good"))
    texts = docs.select(F.col(id_col).alias("id"), body(text_col).alias("body"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, PLACES + 1), np.int64)  # the last place counts documents
        for batch in batches:
            data, offsets = flat(batch.column(0))
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(int)
            for i, j in pieces(offsets):
                for k, places in enumerate(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])):
                    held[good[i + k], places] += 1
                    held[good[i + k], -1] += 1
        some = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[1, some]), pa.array(held[0, some])], ["place", "n1", "n0"])

    # Labels grow with the corpus, so they are never broadcast.
    counted = texts.join(marked.hint("merge"), "id").select("body", "good").mapInArrow(count, "place long, n1 long, n0 long")
    totals = counted.groupBy("place").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).toPandas()
    n = np.zeros((2, PLACES + 1))
    n[1, totals["place"]], n[0, totals["place"]] = totals["n1"], totals["n0"]
    documents = n[:, -1]
    if not documents.all():
        share = documents[1] / documents.sum() if documents.sum() else 0.5
        logit = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return Model(np.zeros(PLACES), np.zeros(PLACES), 0.0, 0.0, logit)
    smooth = n[:, :-1] + 1
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            rows = [
                p.astype(np.int32).tobytes()
                for i, j in pieces(offsets)
                for p in features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["hash", "good", "places"])

    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(sample_rows)  # bounded, so it may be broadcast
    rows = (
        texts.join(F.broadcast(chosen), "id")
        .select(F.xxhash64("id").alias("hash"), "body", "good")
        .mapInArrow(sampled, "hash long, good boolean, places binary")
        .orderBy("hash", "places")
        .limit(2 * sample_rows)
        .toPandas()
    )
    places = [np.frombuffer(p, np.int32) for p in rows["places"]]
    good = rows["good"].to_numpy(bool)
    aside = np.arange(len(places)) % 5 == 4
    model = dual_descent([p for p, a in zip(places, aside) if not a], good[~aside], ratio, cost, rounds)
    if good[aside].any() and not good[aside].all():
        margins = np.array([model.margin(p) for p, a in zip(places, aside) if a])
        model.slope, model.shift = logistic(margins, good[aside])
    return model


def score_column(spark: SparkSession, model: Model, text_col: str = "text") -> Column:
    """The score of a text column, computed in Arrow batches; other columns stay where they are.

    A text without n-grams (null, empty) has the score of the model's bias. The model is broadcast; its size is that of
    the feature places.
    """
    shared = prepare(spark).sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        data, offsets = flat(column)
        out = [
            shared.value.score(p)
            for i, j in pieces(offsets)
            for p in features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        ]
        return pa.array(out, pa.float64())

    return score(body(text_col))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, folds: int = 4, held: int = 2
) -> DataFrame:
    """Learn from the labels outside fold ``held`` and score every row of ``docs``.

    Columns: id, ``held_out``, ``score`` (0 to 1, higher: more likely good) and ``predicted`` (1 from ``threshold``
    on). Only texts enter a score. Null and empty texts have the score of a text without n-grams; repeated rows
    come back as often as they came; an empty table gives an empty table; further columns are not read.
    """
    model = fit(docs, labels.where(fold(id_col, folds) != held), id_col, text_col)
    out = docs.select(id_col, score_column(docs.sparkSession, model, text_col).alias("score"))
    return out.select(
        id_col,
        (fold(id_col, folds) == held).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
