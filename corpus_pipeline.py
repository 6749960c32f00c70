"""A corpus pipeline over documents: rules, exact and near deduplication, mixing and packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the
columns of documents. It belongs to the subpackage translatome.llm and goes with it.

Defined cases, in every stage: an empty table gives an empty one with the same columns; rows that repeat, null ids and further columns, whatever
their names, are carried as the stage's operator says, which the docstrings below sum up; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from translatome.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from translatome.llm.common import documents, labels, small_batches, written
from translatome.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled rules.

    Null and empty texts have no words and go; rows that repeat are judged each; a null language is a stratum.
    """
    small_batches(spark)
    return quality_rules.filtered(docs, labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts.

    Null and empty texts are equal; of rows that repeat one stays; a null id loses against others.
    """
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, at a Jaccard similarity of 0.8.

    Texts without words are linked with nothing and stay; rows that repeat are one document; a null id stays only where no other is.
    """
    small_batches(spark)
    return near_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and blank texts have size 0 and are taken 0 times; a null source is one of its own; rows that repeat draw alike.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as pieces in sequences of 1024 tokens.

    Each row is packed, copies too; an empty text is the end mark alone; ids may be null or repeat; further columns are left out.
    """
    small_batches(spark)
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: MinHash candidates, learned cutoffs and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
