"""Toxicity, quality and language on held-out rows, and on awkward ones."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures
from translatome.llm import language_id, quality_classifier, toxicity
from translatome.llm.common import fold
from translatome.llm.queries import op2_toxicity, op5_language_id, op7_quality_classifier

SF = "/root/testdata/sf0.1"


def held(spark, query, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    return query(spark, SF).filter("held_out").join(labels, "doc_id").toPandas()


def auc(p):
    r, y = p.score.rank().to_numpy(), p.y.to_numpy()
    n = y.sum()
    return (r[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_toxicity_held_out(spark):
    p = held(spark, op2_toxicity, "toxic")  # some 280 toxic texts in four languages to learn from
    assert auc(p) > 0.93 and (p.predicted == p.y).mean() > 0.96 and p.predicted[p.y == 0].mean() < 0.01 and p.score.between(0, 1).all()


def test_quality_held_out(spark):
    p = held(spark, op7_quality_classifier, "quality")
    assert auc(p) > 0.99 and (p.predicted == p.y).mean() > 0.97 and p.score.between(0, 1).all()


def test_language_held_out(spark):
    langs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    p = op5_language_id(spark, SF).filter("held_out").join(langs, "doc_id").toPandas()
    assert (p.lang_pred == p.lang).mean() > 0.99 and p.score.between(0, 1).all()


def test_folds(spark):
    import zlib

    rows = spark.range(50).select("id", fold(F.col("id"), 3).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in rows)


LABELS = [(1, 1, 0), (7, 0, 1), (8, 1, 0), (8, 0, 0), (99, 1, 1), (None, 1, 1), (3, None, None)]


@pytest.mark.parametrize("rows", [fixtures.awkward(), []], ids=["awkward", "empty"])
@pytest.mark.parametrize("labels", [LABELS, []], ids=["labels", "none"])
def test_awkward(spark, rows, labels):
    docs = spark.createDataFrame(rows, fixtures.SCHEMA).withColumn("label", F.lit("x")).withColumn("score", F.lit(7))
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    for got in (toxicity.classified(docs, known).collect(), quality_classifier.classified(docs, known).collect()):
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    got = language_id.identified(docs).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    assert all(r.lang_pred == "und" for r in got if not any(c.isalpha() for c in text[r.doc_id] or ""))


def test_misspellings_share_subwords():
    draw = np.random.default_rng(1)
    plain = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "magna", "aliqua"]
    texts = [" ".join(draw.choice(plain, 30)) for _ in range(300)]
    y = [i % 3 == 0 for i in range(300)]
    texts = [t + " horrible wretch" if m else t for t, m in zip(texts, y, strict=True)]
    model = toxicity.fit(texts, [int(m) for m in y])
    worth = lambda w: model["worth"][toxicity.subwords(w)].mean()
    assert worth("horribble") > max(map(worth, plain)) and worth("wretchh") > max(map(worth, plain))


def test_dual_coordinate_descent_separates():
    draw = np.random.default_rng(0)
    rows = [np.unique(draw.integers(0, 50, 10) + 50 * (i % 2)) for i in range(80)]
    y = np.array([1 if i % 2 else -1 for i in range(80)])
    w, b = quality_classifier.dual_coordinate_descent(rows, np.ones(100), y, np.full(80, 1.0))
    assert all(np.sign(w[r].sum() + b) == k for r, k in zip(rows, y, strict=True))


def test_backoff_goes_to_shorter_grams():
    table = lambda a, b: language_id.Frequencies([Counter(a), Counter(b)])
    two, one = table({"xy": 5}, {"yz": 1}), table({"x": 1}, {"q": 7})
    model = {"languages": ["a", "b"], "words": table({"own": 2}, {}), "grams": [table({}, {}), table({}, {}), table({}, {}), two, one]}
    got = language_id.word_scores(["xy", "own", "q", "z", "xyz"], model)
    assert got[0].tolist() == two["xy"].tolist() and got[0][0] == 0 > got[0][1]
    assert got[1].tolist() == model["words"]["own"].tolist()
    assert got[2].tolist() == one["q"].tolist() and got[2][1] == 0 > got[2][0]
    assert got[3].tolist() == [0.0, 0.0]
    assert got[4].tolist() == ((two["xy"] + two["yz"]) / 2).tolist()
    assert language_id.word_scores([], model).shape == (0, 2)


def test_language_tables_hold_every_word_and_gram_of_the_sample():
    """Refit by plain counting: smoothed log frequencies by language, up to a constant for each entry."""
    texts = ["aa bb aa cc", "dd aa", "ee ff ff", "aa"]
    model = language_id.fit(texts, ["x", "x", "y", "y"])
    words = [Counter("aa bb aa cc dd aa".split()), Counter("ee ff ff aa".split())]
    for n, table in [(0, model["words"]), *zip(range(5, 0, -1), model["grams"], strict=True)]:
        counts = words
        if n:
            counts = [Counter() for _ in words]
            for own, by_word in zip(counts, words, strict=True):
                for w, c in by_word.items():
                    marked = f"<{w}>" if n > 1 else w
                    for i in range(len(marked) - n + 1):
                        own[marked[i : i + n]] += c
        every = set(counts[0]) | set(counts[1])
        assert len(table) == len(every)
        for entry in every:
            want = np.log([(c[entry] + 0.5) / (sum(c.values()) + 0.5 * len(every)) for c in counts])
            assert np.allclose(table[entry], want - want.max())


def test_language_like_plain_scoring(spark):
    """Every score from the model alone: words first, then n-grams from long to short; no letter is und, unknown letters are not."""
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    texts = [r[1] for r in rows if r[1] and r[2]]
    model = language_id.fit(texts, [r[2] for r in rows if r[1] and r[2]])
    asked = [(r[0], r[1]) for r in rows] + [(10**6 + k, t) for k, t in enumerate(["", None, "12 ½ --", "\u4e2d\u6587", "zzzqq xkw", "\u2167"])]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predicted(spark.createDataFrame(asked, "doc_id bigint, text string"), model).collect()}
    for doc_id, text in asked:
        words = language_id.words_of(text)
        if not any(c.isalpha() for c in text or ""):
            assert got[doc_id] == ("und", 0.0)
            continue
        total = np.zeros(len(model["languages"]))
        for w in words:
            if w in model["words"]:
                total += model["words"][w]
                continue
            for n, table in zip(range(5, 0, -1), model["grams"], strict=True):
                marked = f"<{w}>" if n > 1 else w
                found = [table[marked[i : i + n]] for i in range(len(marked) - n + 1) if marked[i : i + n] in table]
                if found:
                    total += sum(found) / len(found)
                    break
        shares = np.exp(total - total.max())
        assert got[doc_id][1] == pytest.approx(shares.max() / shares.sum() if total.any() else 1 / len(shares), abs=1e-6)
        name = got[doc_id][0]
        assert name in model["languages"] and total[model["languages"].index(name)] == pytest.approx(total.max(), abs=1e-6)


def test_one_language_is_never_und(spark):
    docs = spark.createDataFrame([(i, f"some words here {i}", "en", "a", 1) for i in range(20)] + [(50, "\u4e2d", None, "a", 1)], fixtures.SCHEMA)
    assert {r.lang_pred for r in language_id.identified(docs).collect()} == {"en"}


def test_too_many_labels_are_an_error(spark):
    from translatome.llm.fitting import labelled_sample

    docs = spark.createDataFrame([(i, "text", f"l{i}", "a", 1) for i in range(5)], fixtures.SCHEMA)
    with pytest.raises(ValueError, match="labels"):
        labelled_sample(docs, docs.select("doc_id", F.col("lang").alias("label")), 3, most_labels=4)


def test_toxicity_like_plain_scoring(spark):
    """A text's score is a logistic curve of its worst span's mean worth."""
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + [(10**6, ""), (10**6 + 1, None)]
    draw = np.random.default_rng(4)
    model = {"worth": draw.normal(0, 1, toxicity.BUCKETS).astype(np.float32), "slope": 1.7, "intercept": -0.4, "neutral": 0.2}
    got = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    for doc_id, text in rows:
        each = [float(np.mean([model["worth"][k] for k in toxicity.subwords(w)])) for w in toxicity.words_of(text)]
        spans = [each[i : i + toxicity.SPAN] for i in range(max(1, len(each) - toxicity.SPAN + 1))]
        worst = max(sum(s) / len(s) for s in spans) if each else 0.2
        assert got[doc_id] == pytest.approx(1 / (1 + np.exp(-(1.7 * worst - 0.4))), abs=1e-5)


def test_quality_like_plain_scoring(spark):
    """A text's score is a logistic curve of the sum of its n-grams' worth."""
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + [(10**6, ""), (10**6 + 1, None)]
    draw = np.random.default_rng(4)
    model = {"worth": draw.normal(0, 0.1, quality_classifier.COLUMNS), "b": 0.3, "slope": 0.8, "intercept": -0.1}
    got = {r.doc_id: r.score for r in quality_classifier.scored(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    for doc_id, text in rows:
        own = quality_classifier.columns_of(text)
        assert len(set(own.tolist())) == len(own)
        margin = min(20, max(-20, sum(model["worth"][k] for k in own) + 0.3))
        assert got[doc_id] == pytest.approx(1 / (1 + np.exp(-(0.8 * margin - 0.1))), abs=1e-9)


def test_sample_is_bounded_in_bytes_and_the_same_each_time(spark):
    """Of several texts of an id always the same one; long texts leave fewer documents, of both labels."""
    from translatome.llm import fitting

    rows = [(i, f"{k} " + "x" * 1000) for i in range(200) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labelled = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, label int")
    sample = lambda df, **k: sorted(map(tuple, fitting.labelled_sample(df, labelled, 1000, **k).collect()))
    whole = sample(docs)
    assert len(whole) == 200 and whole == sample(docs.repartition(5).orderBy(docs.text.desc()))
    few = sample(docs, most_bytes=50_000)
    assert set(few) < set(whole) and 20 < len(few) < 85 and {r[2] for r in few} == {0, 1}
