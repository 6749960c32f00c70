"""The filter audit against brute force and SQL."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures
from tests.oracle import connect, same
from translatome.llm import filter_audit, queries

LABELS = [(1, 1, 0), (1, 0, 1), (4, 1, 1), (8, 1, 0), (9, 0, 1), (None, 1, 1), (10, 1, 0), (12, 1, 1), (13, None, 1), (14, 1, None)]


def more():
    long = " ".join(f"w{i}" for i in range(100))
    texts = ["A" * 11 + "b" * 89, "A" * 10 + "b" * 90, long, long + " w0", long.rsplit(" ", 1)[0], " ".join([long] * 2), long + " #", "a|b", None, "", long]
    return [(10 + k, t, "en" if k % 3 else None, "s", 1) for k, t in enumerate(texts)]


def plain(rows, labels):
    """The contract, order by order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        w = fixtures.words(t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == t for r in rows),
        }
        docs.append((lang or "", doc_id in good, doc_id in toxic, fails))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[3][f]]
                left = [d for d in left if not d[3][f]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(d[3][f] for d in own) - len(gone), sum(d[3][f] and sum(d[3].values()) == 1 for d in own),
                    sum(d[1] for d in gone), sum(d[2] for d in gone),
                ]
    for (part, order, step), counts in out.items():
        f = order[step - 1]
        counts.append(sum(c[1] for (p, o, s), c in out.items() if p == part and o[s - 1] == f))
    return sorted((*k, *v) for k, v in out.items())


@pytest.mark.parametrize("rows", [fixtures.corpus(60), fixtures.awkward() + more(), []], ids=["corpus", "awkward", "empty"])
def test_like_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, fixtures.SCHEMA)
    for name in ("id", "key", "part", "word", "words", "digest", "least", "good", "toxic", "A", "C", "n", "bytes"):
        docs = docs.withColumn(name, F.lit("x"))
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").withColumn("id", F.lit(1)).withColumn("good", F.lit(1))
    assert sorted(map(tuple, filter_audit.audited(docs, labels).collect())) == plain(rows, LABELS)


def test_words_are_shuffled_as_texts_only(spark):
    keyed = spark.createDataFrame([(1, 2, "a b")], "id bigint, key bigint, text string")
    plan = filter_audit.word_counts(keyed, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_like_sql(spark):
    sf = "/root/testdata/sf0.001"
    same(queries.op12_filter_audit(spark, sf), connect(sf), queries.oracle_sql()["op12_filter_audit"])
