"""Fitting a model on a bounded sample in one task, and scoring all documents with it."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from translatome.llm.common import written


#: Most bytes of text that one task fits a model on.
MOST_BYTES = 200_000_000


def labelled_sample(docs: DataFrame, labelled: DataFrame, per_label: int, most_labels: int = 1000, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, text and label of about per_label documents of each label, chosen by a hash of doc_id.

    labelled: doc_id, label. Ids are chosen before any text is read; their number is bounded by per_label * most_labels, so they
    can be broadcast. If their texts are more than most_bytes, fewer are chosen, of each label in the same proportion. Of several texts
    of one id, the one with the least hash is taken. More than most_labels labels are an error; none is left out.
    """
    one = labelled.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    one = one.filter("label = other").select("doc_id", "label")
    counts = one.groupBy("label").count()
    if counts.limit(most_labels + 1).count() > most_labels:
        raise ValueError(f"there are more than {most_labels} labels")
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(97)), 11) / F.lit(float(1 << 53))
    ids = one.join(F.broadcast(counts), "label").select("doc_id", "label", (uniform * F.greatest(F.col("count") / per_label, F.lit(1.0))).alias("place")).filter("place < 1")
    ids = F.broadcast(written(ids, "sample"))
    own = F.struct(F.xxhash64("text").alias("hash"), "text")
    texts = docs.select("doc_id", "text").filter("text is not null").join(ids, "doc_id")
    texts = written(texts.groupBy("doc_id", "label", "place").agg(F.min(own).alias("own")).select("doc_id", "label", "place", "own.text"), "sample-texts")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return texts.filter(F.col("place") < min(1.0, most_bytes / max(size, 1))).select("doc_id", "text", "label")


def fitted(sample: DataFrame, fit: Callable[[list[str], list], Any]) -> Any:
    """What fit(texts, labels) returns, called in one task on the whole (bounded) sample, ordered by doc_id."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        return pd.DataFrame({"model": [pickle.dumps(fit(part["text"].tolist(), part["label"].tolist()))]})

    rows = sample.withColumn("whole", F.lit(True)).groupBy("whole").applyInPandas(run, "model binary").collect()
    return pickle.loads(bytes(rows[0]["model"])) if rows else fit([], [])
