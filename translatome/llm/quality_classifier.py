"""Quality by naive Bayes support vectors.

Features are indicators of character n-grams and of n-grams over word shapes (case, symbols, digits, a word that
repeats the one before), hashed into a fixed number of columns. Each indicator is scaled by the log ratio of its
smoothed counts in the two classes; a linear hinge-loss model is fitted on them by dual coordinate descent, and
a logistic curve, fitted on a part of the sample that training never saw, turns margins into scores.

Defined cases: a null or empty text has no n-grams (its score is the curve at the intercept); rows that repeat are scored each;
without labels of both kinds every score is 0.5; a null doc_id counts as the empty text in its fold; very long texts are read whole, one after
the other, and take some 50 bytes a character meanwhile; a score of just the cut is predicted as good; an empty table gives an empty
result; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from translatome.llm.common import fold, slices
from translatome.llm.fitting import fitted, labelled_sample
from translatome.llm.toxicity import logistic

COLUMNS = 1 << 17
CHARS, SHAPES = 4, 4
#: Labelled documents of each class that the model is fitted on.
PER_CLASS = 2500
ROUNDS, COST, SMOOTHING = 12, 0.05, 1.0
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Shapes(dict):
    """Shape of a word: 0 to 31 by its kinds of characters; remembered."""

    def __missing__(self, word: str) -> int:
        body = word.strip(".,;:")
        shape = (
            (body[:1].isupper())
            + 2 * (len(body) > 1 and body.isupper())
            + 4 * any(c.isdigit() for c in body)
            + 8 * (not body.isalnum())
            + 16 * (len(word) > 12)
        )
        if len(self) > 500_000:
            self.clear()
        self[word] = shape
        return shape


_shapes = _Shapes()
_REPEAT = 32


def _grams(units: np.ndarray, most: int, kind: int) -> list[np.ndarray]:
    """Columns of all n-grams of up to `most` units in a row."""
    out = []
    x = units.astype(np.uint64) + np.uint64(kind * 0x51ED270B + 1)
    h = np.zeros(len(units), np.uint64)
    for n in range(1, most + 1):
        if len(units) < n:
            break
        h = (h[: len(units) - n + 1] + x[n - 1 :]) * _MIX
        h ^= h >> np.uint64(29)
        out.append((h >> np.uint64(20)).astype(np.int64) % COLUMNS)
    return out


def columns_of(text: str | None) -> np.ndarray:
    """The distinct columns of a text, in order."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    words = text.split()
    shapes = np.fromiter(map(_shapes.__getitem__, words), np.int64, len(words))
    if len(words) > 1:
        same = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), bool, len(words) - 1)
        shapes[1:][same] = _REPEAT
    flags = np.zeros(COLUMNS, bool)
    for grams in (*_grams(points, CHARS, 1), *_grams(shapes, SHAPES, 2)):
        flags[grams] = True
    return np.nonzero(flags)[0]


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights (per scaled indicator) and intercept of the linear hinge-loss model; y is -1 or 1, cost each row's bound."""
    draw = np.random.default_rng(3)
    w, b, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    norm = np.array([(scale[r] ** 2).sum() + 1.0 for r in rows])
    for _ in range(rounds):
        for i in draw.permutation(len(rows)):
            r = rows[i]
            s = scale[r]
            gradient = y[i] * (w[r] @ s + b) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * s
                b += step
                alpha[i] = new
    return w, b


def fit(texts: list[str], labels: list[int]) -> dict | None:
    """The model: one weight for each column, the intercept and the curve."""
    y = np.array([1 if x else -1 for x in labels])
    if len(set(y.tolist())) < 2:
        return None
    rows = [columns_of(t) for t in texts]
    held = np.random.default_rng(9).random(len(y)) < 0.25
    train = np.nonzero(~held)[0]
    if len(set(y[train].tolist())) < 2:
        train = np.arange(len(y))
    good, bad = np.full(COLUMNS, SMOOTHING), np.full(COLUMNS, SMOOTHING)
    for i in train:
        (good if y[i] > 0 else bad)[rows[i]] += 1
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    share = {k: (y[train] == k).mean() for k in (-1, 1)}
    cost = np.array([COST * 0.5 / share[k] for k in y[train]])
    w, b = dual_coordinate_descent([rows[i] for i in train], ratio, y[train], cost)
    worth = w * ratio
    margins = np.array([worth[r].sum() + b for r in rows])
    seen = held if len(set(y[held].tolist())) == 2 else np.ones(len(y), bool)
    slope, intercept = logistic(np.clip(margins[seen], -20, 20), (y[seen] > 0).astype(float))
    return {"worth": worth, "b": b, "slope": slope, "intercept": intercept}


def scored(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            if m is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                margins = np.array([m["worth"][columns_of(t)].sum() + m["b"] for t in batch.column("text").to_pylist()])
                scores = 1 / (1 + np.exp(-(m["slope"] * np.clip(margins, -20, 20) + m["intercept"])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(score, "doc_id bigint, score double")


def classified(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the held-out fold are never seen."""
    learn = labels.filter(fold(F.col("doc_id"), folds) != held).select("doc_id", F.col("quality").alias("label"))
    model = fitted(labelled_sample(docs, learn, PER_CLASS), fit)
    return scored(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == held).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
