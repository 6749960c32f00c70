"""How five filters of documents interact: what each removes alone, after others, in every order.

A document fails A with fewer than LEAST_WORDS words [^\\x20\\x09-\\x0D]+, B if its distinct words are under LEAST_DISTINCT % of its
words, C if over MOST_CAPITALS % of its code points are [A-Z], D if it holds any of [#$%&*|], E if a smaller doc_id has the same text.

Words are a relation: texts are dealt out by document once, words are exploded and aggregated by (document, word), then by document for
totals and distincts. Both aggregations keep that partitioning, so words are never shuffled. The other flags are outer-joined, and one aggregation
for each part gives 32 conditional counts, one for each set of filters that a document may fail (and as many of good and toxic ones). All orders
are sums of these: a document is removed in a step if it fails that filter and none before it.

Shapley values add a filter's removals over all 120 orders: a document that fails k filters is removed by each of them in 120 / k orders.

Defined cases: null texts are empty, a null `part` column is the empty string; very long texts are whole rows, their words are exploded row by row;
rows that repeat (same doc_id and text) count as documents each, though their words are counted together, and are no copies of each other,
as none has the smaller id; a row without doc_id has no smaller one and no label; of several labels of one id any 1 counts; an empty table has no
part and gives no row; further columns are never read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from translatome.llm.common import BLANKS, written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = "#$%&*|"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text whose words one task aggregates, and most such tasks.
PART_BYTES, MOST_PARTS = 4_000_000, 100_000


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _flags(keyed: DataFrame) -> DataFrame:
    text, n = F.col("text"), F.length("text")
    return keyed.select(
        "id", "key", "part",
        (100 * (n - _without(text, CAPITALS)) > MOST_CAPITALS * n).alias("C"),
        (_without(text, SYMBOLS) < n).alias("D"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length("text").cast("bigint").alias("bytes"),
    )


def word_counts(keyed: DataFrame, parts: int) -> DataFrame:
    """id, key, words, distincts of each (id, key): one row, however many rows have both.

    A blank, which is no word, is added to each row's words, so that its count is the number of rows.
    """
    spaced = F.translate("text", BLANKS[1:], " " * (len(BLANKS) - 1))
    words = (
        keyed.select("id", "key", "text")
        .repartition(parts, "id", "key")
        .select("id", "key", F.explode(F.concat(F.split(spaced, " "), F.array(F.lit(" ")))).alias("word"))
        .filter("word != ''")
    )
    each = words.groupBy("id", "key", "word").agg(F.count(F.lit(1)).alias("n"))
    rows = F.sum(F.when(F.col("word") == " ", F.col("n")))
    totals = each.groupBy("id", "key").agg(F.sum("n").alias("all"), rows.alias("rows"), F.count(F.lit(1)).alias("different"))
    return totals.select("id", "key", F.expr("(all - rows) div rows").alias("words"), (F.col("different") - 1).alias("distincts"))


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, fails (bit k is set for the filter FILTERS[k]), good, toxic: one row per row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(text).alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text"))
    flags = written(_flags(keyed), "audit-flags")
    size = flags.agg(F.sum("bytes")).first()[0] or 0
    counted = written(word_counts(keyed, min(MOST_PARTS, 1 + size // PART_BYTES)), "audit-words")

    copies = flags.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "least")
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    no = lambda c: F.coalesce(c, F.lit(False))
    of = {
        "A": F.col("words") < LEAST_WORDS,
        "B": 100 * F.col("distincts") < LEAST_DISTINCT * F.col("words"),
        "C": F.col("C"),
        "D": F.col("D"),
        "E": no(F.col("id") > F.col("least")),
    }
    fails = sum((F.when(of[f], 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    none = F.lit(0).cast("bigint")
    counted = counted.select(F.col("id").alias("of_id"), F.col("key").alias("of_key"), "words", "distincts")
    return (
        flags.join(counted, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left")
        .withColumns({c: F.coalesce(c, none) for c in ("words", "distincts")})
        .join(copies, "digest", "left")
        .join(marks, "id", "left")
        .select("part", fails.alias("fails"), no(F.col("good")).alias("good"), no(F.col("toxic")).alias("toxic"))
    )


def _total(counts: str, where) -> Column:
    """Sum of the counts of the sets of failed filters that `where` accepts."""
    return F.aggregate(F.filter(counts, lambda _, fails: where(fails)), F.lit(0).cast("bigint"), lambda a, b: a + b)


def audited(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step and the counts of each step of each order."""
    rows = failures(docs, labels, part)
    sets = range(1 << len(FILTERS))
    counts = rows.groupBy("part").agg(
        *(F.count_if(F.col("fails") == s).alias(f"n{s}") for s in sets),
        *(F.count_if((F.col("fails") == s) & F.col("good")).alias(f"good{s}") for s in sets),
        *(F.count_if((F.col("fails") == s) & F.col("toxic")).alias(f"toxic{s}") for s in sets),
    )
    counts = written(counts.select("part", *(F.array(*(f"{c}{s}" for s in sets)).alias(c) for c in ("n", "good", "toxic"))), "audit-counts")

    letter, earlier = F.substring("filter_order", F.col("step"), F.lit(1)), F.substring("filter_order", F.lit(1), F.col("step") - 1)
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(f)), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))
    own, before = F.col("own"), F.col("before")
    removed = lambda s: (s.bitwiseAND(own) != 0) & (s.bitwiseAND(before) == 0)
    orders = len(list(permutations(FILTERS)))
    shares = F.transform("n", lambda n, s: F.when(s.bitwiseAND(own) == 0, 0).otherwise((n * (orders / F.bit_count(s))).cast("bigint")))
    return (
        counts.withColumn("filter_order", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumns({"own": bits(letter), "before": bits(earlier)})
        .select(
            "part", "filter_order", "step",
            _total("n", lambda s: s.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
            _total("n", removed).alias("removed"),
            _total("n", lambda s: (s.bitwiseAND(own) != 0) & (s.bitwiseAND(before) != 0)).alias("redundant"),
            _total("n", lambda s: s == own).alias("unique_fails"),
            _total("good", removed).alias("good_lost"),
            _total("toxic", removed).alias("toxic_lost"),
            F.aggregate(shares, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("shapley"),
        )
    )


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
f AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS fails
  FROM d),
m AS (SELECT part, fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM f LEFT JOIN labels USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, b)),
walks AS (
  SELECT '' AS filter_order, 0 AS step, 0 AS own, 0 AS before
  UNION ALL
  SELECT filter_order || letter, step + 1, b, own | before FROM walks, letters WHERE (own | before) & b = 0),
steps AS (
  SELECT whole.filter_order, walks.step, walks.own, walks.before
  FROM walks JOIN walks whole ON whole.step = 5 AND walks.step > 0 AND starts_with(whole.filter_order, walks.filter_order)),
counted AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (fails & (own | before) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fails & own <> 0 AND fails & before = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails & own <> 0 AND fails & before <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (fails & own <> 0 AND fails & before = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (fails & own <> 0 AND fails & before = 0), 0)::BIGINT AS toxic_lost
  FROM g, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted"""
