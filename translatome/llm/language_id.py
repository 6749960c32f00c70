"""Language of a text by words first, backing off to character n-grams.

Known words give their log frequency in each language. An unseen word is scored by its n-grams of 5 characters, if
any of them is known, else by those of 4, and so on down to single characters; words none of whose characters
are known count for nothing. The text's score in a language is the sum over its words.

Defined cases: a null text or one without a letter is `und` with score 0; a text of unknown letters only gets the language with
most sampled texts, at the score of a guess; ties go to the language that is first in order; very long texts are read whole, 4 MB
at a time; without any labelled text all are `und`; rows that repeat are predicted each; an empty table gives an empty result;
further columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from translatome.llm.common import fold, slices
from translatome.llm.fitting import fitted, labelled_sample

UNKNOWN = "und"
LONGEST = 5
#: Documents of each language that are learned from. All their words and n-grams are in the model.
PER_LANGUAGE, SMOOTHING = 2500, 0.5
#: New words of a task are looked up by so many at a time, and kept until there are more than REMEMBERED.
LOOKED_UP, REMEMBERED = 50_000, 500_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def has_letter(words: list[str]) -> bool:
    return any(w.isalpha() for w in words) or any(c.isalpha() for w in words for c in w)


class Frequencies:
    """Log frequencies by language of all that was counted, however rare; a language without a count has the smoothed one of zero.

    Only counts above zero are kept, so the size is that of the sample's words and not of words times languages.
    """

    def __init__(self, counts: list[Counter]) -> None:
        self.row: dict[str, int] = {}
        rows = [np.fromiter((self.row.setdefault(k, len(self.row)) for k in own), np.int64, len(own)) for own in counts]
        seen = [np.fromiter(own.values(), np.float64, len(own)) for own in counts]
        every = np.concatenate([*rows, np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.end = np.concatenate([[0], np.cumsum(np.bincount(every, minlength=len(self.row)))])
        self.language = np.repeat(np.arange(len(counts)), [len(r) for r in rows])[order].astype(np.int32)
        self.gain = np.log1p(np.concatenate([*seen, np.zeros(0)])[order] / SMOOTHING)
        self.base = np.log(SMOOTHING / np.array([max(SMOOTHING, n.sum() + SMOOTHING * len(self.row)) for n in seen]))

    def at(self, rows: list[int]) -> np.ndarray:
        """By row and language, the likeliest at 0."""
        first = self.end[rows]
        n = self.end[np.asarray(rows, np.int64) + 1] - first
        own = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        value = np.tile(self.base, (len(rows), 1))
        value[np.repeat(np.arange(len(rows)), n), self.language[own]] += self.gain[own]
        return value - value.max(axis=1, keepdims=True)

    def __getitem__(self, entry: str) -> np.ndarray:
        return self.at([self.row[entry]])[0]

    def __contains__(self, entry: str) -> bool:
        return entry in self.row

    def __len__(self) -> int:
        return len(self.row)


def fit(texts: list[str], labels: list[str]) -> dict | None:
    """Languages, word table and n-gram tables from longest to shortest."""
    languages = sorted(set(labels))
    if not languages:
        return None
    by_word = {name: Counter() for name in languages}
    for t, own in zip(texts, labels, strict=True):
        by_word[own].update(words_of(t))
    tables = []
    for n in range(LONGEST, 0, -1):
        grams = []
        for name in languages:
            own: Counter = Counter()
            for w, c in by_word[name].items():
                for g in _grams(w, n):
                    own[g] += c
            grams.append(own)
        tables.append(Frequencies(grams))
    sampled = Counter(labels)
    commonest = min(range(len(languages)), key=lambda k: (-sampled[languages[k]], k))
    return {"languages": languages, "words": Frequencies(list(by_word.values())), "grams": tables, "commonest": commonest}


def word_scores(words: list[str], model: dict) -> np.ndarray:
    """Scores by word and language: of known words their own, of others the mean over the known n-grams of the longest order that has any."""
    scores = np.zeros((len(words), len(model["languages"])))
    rows = [model["words"].row.get(w) for w in words]
    seen = [i for i, r in enumerate(rows) if r is not None]
    if seen:
        scores[seen] = model["words"].at([rows[i] for i in seen])
    rest = [i for i, r in enumerate(rows) if r is None]
    for n, table in zip(range(LONGEST, 0, -1), model["grams"], strict=True):
        done, found, starts, left = [], [], [], []
        for i in rest:
            own = [r for r in map(table.row.get, _grams(words[i], n)) if r is not None]
            if own:
                done.append(i)
                starts.append(len(found))
                found += own
            else:
                left.append(i)
        if done:
            sums = np.add.reduceat(table.at(found), starts, axis=0)
            scores[done] = sums / np.diff([*starts, len(found)])[:, None]
        rest = left
    return scores


def predicted(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[str, int] = {}
        table = np.zeros((1 << 16, len(m["languages"]))) if m else None  # grows by doubling
        for batch in slices(batches):
            names, scores = [], []
            texts = [words_of(t) for t in batch.column("text").to_pylist()] if m else [[]] * batch.num_rows
            if m:
                if len(known) > REMEMBERED:
                    known.clear()
                new = sorted({w for ws in texts for w in ws if w not in known})
                first = len(known)
                known.update(zip(new, range(first, first + len(new)), strict=True))
                while len(known) > len(table):
                    table = np.concatenate([table, np.zeros_like(table)])
                for k in range(0, len(new), LOOKED_UP):
                    some = new[k : k + LOOKED_UP]
                    table[first + k : first + k + len(some)] = word_scores(some, m)
            get = known.__getitem__
            for ws in texts:
                if not has_letter(ws):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = table[np.fromiter(map(get, ws), np.int64, len(ws))].sum(axis=0)
                best = int(total.argmax()) if total.any() else m["commonest"]
                names.append(m["languages"][best])
                scores.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(predict, "doc_id bigint, lang_pred string, score double")


def identified(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score; languages of the held-out fold are never seen."""
    learn = docs.filter(fold(F.col("doc_id"), folds) != held).select("doc_id", F.col("lang").alias("label"))
    model = fitted(labelled_sample(docs, learn, PER_LANGUAGE), fit)
    return predicted(docs, model).select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")
