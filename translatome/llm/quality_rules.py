"""Quality rules with risk-controlled thresholds.

Each rule is a ratio that grows as a text gets worse. PATH is a fixed sequence of joint cutoffs from lax to strict: every step lowers the
cutoff of one rule, so that what is rejected only grows. In each stratum (language) the steps are tested in turn on labelled good documents,
which took no part in choosing the path: a step holds if a binomial with the permitted rate of false rejection would show as few
documents rejected by all rules together as were seen with a probability of at most CONFIDENCE / number of strata (the exact
Clopper-Pearson bound). The first step that doesn't hold ends the sequence and the one before it is used. Testing a fixed sequence up to the
first failure needs no correction for its length, so the correction (Bonferroni's) is for the strata only, and some 90 good labels
certify a step that rejects none of them. A stratum without a certified step has the base rules only. But for a chance of CONFIDENCE, the rules
together reject at most STRATUM_RATE of the good documents in every stratum.

Defined cases: a null or empty text has no words (it fails the base rules); very long texts are counted whole, one at a time; a ratio
equal to its cutoff passes; a null language is a stratum; labels without a document, with null or with contradicting quality are
left out; without labels only the base rules count; rows that repeat are judged each; an empty table gives an empty result;
further columns are carried by `filtered` and never read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from translatome.llm.common import written
from translatome.llm.substring_dedup import hashed_words, mixed, rolled

_BLANKS, _SYMBOLS, _CAPITALS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91))
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims")

#: Bytes of text whose words a task holds at a time.
PART_BYTES = 1_000_000
#: Permitted rate of false rejection by all rules together in each stratum, and the chance that it is exceeded in any.
STRATUM_RATE, CONFIDENCE = 0.05, 0.05
GRID = (0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)
#: Numerator and denominator of each rule.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "exclaims": ("n_exclaims", "n_words"),
}
#: Steps (rule, cutoff), a parameter fixed before labels are seen. What plain prose has least of is tightened first; the last notches, which
#: prose itself comes near, are at the end.
PATH = (
    *(("exclaims", c) for c in GRID), *(("symbols", c) for c in GRID), *(("capitals", c) for c in GRID[:-1]),
    *(("repeats", c) for c in GRID[:-1]), *(("dup_lines", c) for c in GRID[:-1]),
    ("capitals", GRID[-1]), ("dup_lines", GRID[-1]), ("repeats", GRID[-1]),
)


def text_statistics(texts: list[bytes | None]) -> pd.DataFrame:
    """The counts of _FIELDS for each text."""
    words = [t.split() if t else [] for t in texts]
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(n) - n
    rows = np.zeros((len(texts), len(_FIELDS)), np.int64)
    rows[:, 0] = n
    for i, text in enumerate(texts):
        if not text:
            continue
        lines = [x for x in text.split(b"\n") if x.strip()]
        rows[i, 1] = len(text.translate(None, _BLANKS).decode("utf-8", "replace"))
        rows[i, 2] = len(text) - len(text.translate(None, _SYMBOLS))
        rows[i, 3] = len(lines) - len(set(lines))
        rows[i, 5] = len(lines)
        rows[i, 6] = len(text) - len(text.translate(None, _CAPITALS))
        rows[i, 7] = text.count(b"!")
    hashes = hashed_words([w for ws in words for w in ws])
    threes = rolled(hashes, 3, np.uint64(0x9E3779B97F4A7C15))
    doc = np.repeat(np.arange(len(n)), n)
    whole = np.nonzero((np.arange(len(doc)) - np.repeat(starts, n) + 3 <= np.repeat(n, n))[: len(threes)])[0]
    if len(whole):
        keys = mixed(threes[whole] + doc[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again = whole[counts[inverse] > 1]
        covered = np.zeros(len(doc), bool)
        for step in range(3):
            covered[again + step] = True
        rows[:, 4] = np.bincount(doc[covered], minlength=len(n))
    return pd.DataFrame(rows, columns=_FIELDS)


def statistics(text: Column) -> Column:
    """A struct of the counts of a text.

    It is declared as not deterministic, or a filter on a count would be pushed below the others and run the function once more.
    """

    def of(texts: pd.Series) -> pd.DataFrame:
        sizes = np.cumsum([len(t) if t else 0 for t in texts]) // PART_BYTES
        cuts = [0, *(np.nonzero(np.diff(sizes))[0] + 1).tolist(), len(texts)]
        return pd.concat([text_statistics(texts.iloc[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)], ignore_index=True)

    return F.pandas_udf(of, ", ".join(f"{f} bigint" for f in _FIELDS)).asNondeterministic()(text.cast("binary"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(rule: str) -> Column:
    top, bottom = (F.col(c) for c in RULES[rule])
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for part in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + part * d
            c = 1.0 + part / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial with n trials, as a regularized incomplete beta function."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _false_rejection(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([at_most(int(x), int(y), STRATUM_RATE) if y else 1.0 for x, y in zip(k, n, strict=True)])


def cutoffs_after(steps: int) -> dict[str, float | None]:
    """The cutoff of each rule after so many steps of the path; null where the rule isn't applied yet."""
    return {r: min((c for rule, c in PATH[:steps] if rule == r), default=None) for r in RULES}


def cutoffs(good: DataFrame) -> DataFrame:
    """lang and one cutoff for each rule (null: not applied), from the statistics of good documents."""
    first = F.array_min(F.array(*[F.when(ratio(r) > c, k) for k, (r, c) in enumerate(PATH)]))  # the step that rejects a document first
    counts = good.select("lang", first.alias("step")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(F.col("step") <= k) for k in range(len(PATH))]).alias("rejected")
    )
    strata = counts.agg(F.count(F.lit(1)).alias("strata"))
    long = counts.crossJoin(F.broadcast(strata)).select("lang", "n", "strata", F.posexplode("rejected").alias("at", "k"))
    chance = F.pandas_udf(_false_rejection, "double")(F.col("k"), F.col("n"))
    held = long.withColumn("fails", chance > CONFIDENCE / F.col("strata"))
    steps = held.groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("fails"), F.col("at"))), F.lit(len(PATH))).alias("steps"))
    of = lambda r: F.get(F.array(*[F.lit(cutoffs_after(k)[r]).cast("double") for k in range(len(PATH) + 1)]), F.col("steps"))
    return steps.select("lang", *(of(r).alias(r) for r in RULES))


def _verdict() -> Column:
    passed = F.lit(True)
    for r in RULES:
        passed &= F.coalesce(ratio(r) <= F.col(f"_{r}"), F.lit(True))
    return ~F.col("base_failed") & passed


#: Up to this many strata the cutoffs are broadcast (under 2 MB).
BROADCAST_STRATA = 20_000


def _judged(stats: DataFrame, limits: DataFrame) -> DataFrame:
    limits = limits.select(F.col("lang").alias("_lang"), *[F.col(r).alias(f"_{r}") for r in RULES])
    if limits.count() <= BROADCAST_STRATA:
        limits = F.broadcast(limits)
    joined = stats.withColumn("base_failed", base_failed()).join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    return joined.withColumn("kept", _verdict()).drop("_lang", *[f"_{r}" for r in RULES])


def good_labels(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that all their labels call good."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("least")).filter("least = 1").select("doc_id")


def judged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statistics with base_failed and kept for each row of docs (no text), and the cutoffs."""
    stats = docs.select("doc_id", "lang", statistics(F.col("text")).alias("s")).select("doc_id", "lang", "s.*")
    stats = written(stats, "statistics")
    limits = written(cutoffs(stats.join(good_labels(labels), "doc_id", "left_semi")), "cutoffs")
    return _judged(stats, limits), limits


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs; texts are read twice and never shuffled."""
    _, limits = judged(docs, labels)
    rows = docs.select("lang", statistics(F.col("text")).alias("s"), F.struct("*").alias("row"))
    return _judged(rows.select("row", "lang", "s.*"), limits).filter("kept").select("row.*")
