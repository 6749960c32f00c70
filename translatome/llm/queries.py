"""The numbered queries, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from translatome.llm import (
    exact_dedup, filter_audit, language_id, mixing, near_dedup, packing, prefix_trie, quality_classifier, quality_rules, sharding, simhash, substring_dedup, toxicity,
)
from translatome.llm.common import conversations, documents, labels


def tokenizer_path() -> str:
    """The public byte-level vocabulary of the box."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of any 35-word passage that starts elsewhere too."""
    return substring_dedup.repeated_passages_removed(documents(spark, sf_dir)).drop("kept_text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of each document; documents with crc32(doc_id) mod 3 = 1 are held out."""
    return toxicity.classified(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of 1024 tokens."""
    return packing.packed(documents(spark, sf_dir), tokenizer_path())


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at 150 % of all words, as words taken of each document."""
    return mixing.planned_sizes(documents(spark, sf_dir)).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_times")).alias("taken"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document; documents with crc32(doc_id) mod 3 = 1 are held out."""
    return language_id.identified(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of equal texts stays, for all documents against a new index."""
    return exact_dedup.decided(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each document; documents with crc32(doc_id) mod 4 = 2 are held out."""
    return quality_classifier.classified(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    return sharding.sharded(documents(spark, sf_dir), 24)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near-duplicates of each document, at a Jaccard similarity of 0.85."""
    return near_dedup.near_duplicates(documents(spark, sf_dir), 85)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics of each document and the verdict of the risk-controlled rules."""
    return quality_rules.judged(documents(spark, sf_dir), labels(spark, sf_dir))[0].select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of each document and its component of fingerprints within 4 bits."""
    return simhash.near_duplicates(documents(spark, sf_dir), 4, 4)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of all documents, in every order, for each language."""
    return filter_audit.audited(documents(spark, sf_dir), labels(spark, sf_dir))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node of the trie of all rebuilt conversations."""
    return prefix_trie.trie(conversations(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_substring_dedup, op2_toxicity, op3_best_fit_packing, op4_mix_sources, op5_language_id,
        op6_exact_dedup, op7_quality_classifier, op8_sharding, op9_minhash_near_dedup, op10_quality_rules, op11_simhash_near_dedup,
        op12_filter_audit, op13_conversation_trie,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
       text_sha256
FROM d""",
        "op12_filter_audit": filter_audit.SQL,
        "op13_conversation_trie": prefix_trie.SQL,
    }
