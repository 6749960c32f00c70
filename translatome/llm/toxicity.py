"""Toxicity by subword-bag embeddings, averaged into a linear softmax and trained jointly in numpy.

A word's vector is the mean of the embeddings of its character n-grams (and of itself), hashed into a fixed number
of rows, so that unseen spellings share vectors with those seen. The softmax reads the average over a span of words;
a text is as toxic as its worst span, so that long texts don't dilute a few words. For toxic texts training takes
the span that the model finds worst, for others the worst and a random one; before the first epoch the log ratio of
subwords' document frequencies stands in for the model. A logistic curve, fitted on a part of the
sample that training never saw, turns the worst span's margin into a score.

Defined cases: a null, blank or letterless text scores as one of ordinary words, and so do subwords that were never learned; rows that repeat are scored
each; without labels of both kinds every score is 0.5; a null doc_id counts as the empty text in its fold; very long texts are read whole, one
after the other; of spans that tie the first is the worst, which leaves the score the same; an empty table gives an empty result; further
columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from translatome.llm.common import fold, slices
from translatome.llm.fitting import fitted, labelled_sample

BUCKETS, SIZE, SPAN = 1 << 16, 8, 4
EPOCHS, RATE, DECAY, BATCH = 10, 0.3, 1e-3, 64
#: Documents of the sample that a subword must occur in; others keep the vector 0.
LEAST = 3
#: Labelled documents of each class that the model is fitted on.
PER_CLASS = 3000
REMEMBERED = 500_000
_WORD = re.compile(r"[^\W_]+")


def subwords(word: str) -> list[int]:
    """Rows of a word: itself and its n-grams of 3 to 5 characters, with marks at its ends."""
    marked = f"<{word}>"
    grams = {marked, *(marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1))}
    return [zlib.crc32(g.encode()) % BUCKETS for g in sorted(grams)]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class _Bags:
    """Distinct words of the sample and their subwords in one array."""

    def __init__(self, texts: list[str]) -> None:
        ids: dict[str, int] = {}
        self.docs = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t)], dtype=np.int64) for t in texts]
        rows = [subwords(w) for w in ids]
        self.counts = np.array([len(r) for r in rows], dtype=np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.rows = np.array([x for r in rows for x in r], dtype=np.int64)

    def margins(self, worth: np.ndarray) -> np.ndarray:
        """Each word's mean of worth over its subwords."""
        if not len(self.counts):
            return np.zeros(0)
        return np.add.reduceat(worth[self.rows], self.starts) / self.counts

    def log_ratios(self, docs: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log ratio of each row's smoothed document frequencies in the two classes, and which rows have LEAST documents."""
        seen = np.zeros((2, BUCKETS))
        for i in docs:
            words = np.unique(self.docs[i])
            flags = np.zeros(BUCKETS, bool)
            flags[self.spans([words])[0]] = True
            seen[y[i]] += flags
        n = np.bincount(y[docs], minlength=2)
        ratios = np.log((seen[1] + 1) / (n[1] + 2)) - np.log((seen[0] + 1) / (n[0] + 2))
        often = seen.sum(axis=0) >= LEAST
        return np.where(often, ratios, 0.0), often

    def spans(self, chosen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Subword rows, their weights and their span for spans of word numbers."""
        words = np.concatenate(chosen)
        span = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
        counts = self.counts[words]
        at = np.repeat(self.starts[words] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        per_word = 1.0 / (counts * np.array([len(c) for c in chosen])[span])
        return self.rows[at], np.repeat(per_word, counts), np.repeat(span, counts)


def worst_span(margins: np.ndarray) -> tuple[float, int]:
    """The largest mean over SPAN words in a row (or over all, if there are fewer), and its start."""
    if not len(margins):
        return 0.0, 0
    if len(margins) <= SPAN:
        return float(margins.mean()), 0
    sums = np.concatenate([[0.0], np.cumsum(margins)])
    means = (sums[SPAN:] - sums[:-SPAN]) / SPAN
    at = int(means.argmax())
    return float(means[at]), at


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton's method with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([((p - y) * x).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(texts: list[str], labels: list[int]) -> dict | None:
    """The model: one number for each subword row (its embedding times the softmax's weights), and the curve."""
    if len(set(labels)) < 2:
        return None
    draw = np.random.default_rng(5)
    bags = _Bags(texts)
    y = np.array(labels)
    filled = np.array([len(d) > 0 for d in bags.docs])
    held = draw.random(len(y)) < 0.25
    train = np.nonzero(filled & ~held)[0]
    if len(set(y[train].tolist())) < 2:
        return None
    vectors = draw.normal(0, 0.05, (BUCKETS, SIZE))
    weights = draw.normal(0, 0.5, (SIZE, 2))
    bias, grown, grown_w = np.zeros(2), np.full(BUCKETS, 1e-8), 1e-8
    ratios, often = bags.log_ratios(train, y)
    vectors[~often] = 0
    for epoch in range(EPOCHS):
        worth = vectors @ (weights[:, 1] - weights[:, 0]) if epoch else ratios
        words = bags.margins(worth)
        chosen, marks = [], []
        for i in train:
            doc = bags.docs[i]
            starts = [worst_span(words[doc])[1]]
            if not y[i]:
                starts.append(int(draw.integers(0, max(1, len(doc) - SPAN + 1))))
            chosen += [doc[s : s + SPAN] for s in starts]
            marks += [y[i]] * len(starts)
        marks = np.array(marks)
        for part in np.array_split(draw.permutation(len(chosen)), max(1, len(chosen) // BATCH)):
            rows, share, span = bags.spans([chosen[k] for k in part])
            n = len(part)
            mean = np.stack([np.bincount(span, share * vectors[rows, d], n) for d in range(SIZE)], axis=1)
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), marks[part]] -= 1
            back = p @ weights.T  # of the mean
            used, where = np.unique(rows, return_inverse=True)
            step = np.stack([np.bincount(where, share * back[span, d], len(used)) for d in range(SIZE)], axis=1)
            step = np.where(often[used][:, None], step + DECAY * vectors[used], 0.0)
            grown[used] += (step**2).mean(axis=1)
            vectors[used] -= RATE * step / np.sqrt(grown[used])[:, None]
            step_w = mean.T @ p / n
            grown_w += float((step_w**2).mean())
            weights -= 0.1 * step_w / np.sqrt(grown_w)
            bias -= 0.05 * p.mean(axis=0)
    worth = vectors @ (weights[:, 1] - weights[:, 0])
    calm = [d for d, mark in zip(bags.docs, y, strict=True) if not mark and len(d)]
    neutral = float(np.median(bags.margins(worth)[np.unique(np.concatenate(calm))])) if calm else 0.0
    worth = np.where(often, worth, neutral)  # what was never learned is as an ordinary word
    words = bags.margins(worth)
    margins = np.array([worst_span(words[d])[0] if len(d) else neutral for d in bags.docs])
    seen = held if len(set(y[held])) == 2 else np.ones(len(y), bool)
    spread = float(np.abs(margins).max()) or 1.0
    a, b = logistic(margins[seen] / spread * 10, y[seen])
    return {"worth": worth.astype(np.float32), "slope": a * 10 / spread, "intercept": b, "neutral": neutral}


def scored(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    known: dict[str, float] = {}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            if m is None:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([0.5] * batch.num_rows)], ["doc_id", "score"])
                continue
            texts = [words_of(t) for t in batch.column("text").to_pylist()]
            if len(known) > REMEMBERED:
                known.clear()
            new = list({w for ws in texts for w in ws if w not in known})
            rows = [subwords(w) for w in new]
            counts = np.array([len(r) for r in rows], dtype=np.int64)
            if new:
                flat = m["worth"][np.fromiter((x for r in rows for x in r), np.int64, int(counts.sum()))]
                known.update(zip(new, (np.add.reduceat(flat, np.cumsum(counts) - counts) / counts).tolist(), strict=True))
            get = known.__getitem__
            worst = np.array([worst_span(np.fromiter(map(get, ws), np.float64, len(ws)))[0] if ws else m["neutral"] for ws in texts])
            margin = np.clip(m["slope"] * worst + m["intercept"], -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-margin)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(score, "doc_id bigint, score double")


def classified(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the held-out fold are never seen."""
    learn = labels.filter(fold(F.col("doc_id"), folds) != held).select("doc_id", F.col("toxic").alias("label"))
    model = fitted(labelled_sample(docs, learn, PER_CLASS), fit)
    return scored(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id"), folds) == held).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
