"""Packing, mixing, sharding, quality rules and the pipeline."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures
from translatome.llm import mixing, packing, quality_rules, sharding
from translatome.llm.queries import tokenizer_path


def frame(spark, rows):
    return spark.createDataFrame(rows, fixtures.SCHEMA)


CASES = pytest.mark.parametrize("rows", [fixtures.corpus(), fixtures.awkward(), []], ids=["corpus", "awkward", "empty"])


def encoded(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "  ", " a", "a ", "a\n b", "a \n", "\n", "don't  do", "x,. y. z,", "é, è. 1, 2.", "a b c", "it's 'll .a", "a\tb c\t", "\n\nfoo bar", "a, b. c", "<|endoftext|> x", "日本 語。 ok.", "x\r\ny z", ",", ".", " ,", "a\x1cb c", "a\u0085 b", "x\x00 \x00y"])
def test_word_tokens_are_text_tokens(text):
    assert np.frombuffer(packing.token_bytes([text], tokenizer_path())[0], "<u4").tolist() == encoded(text)


def test_ranks_are_merges():
    """What makes the ranks give the ids of the merges: every token, encoded alone, is itself."""
    from tokenizers import Tokenizer

    packing.token_bytes([""], tokenizer_path())
    encoder = packing._encoders[tokenizer_path()]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    assert encoder.ranked is not None
    alone = {t: [x.id for x in tokenizer.model.tokenize(t)] for t in tokenizer.get_vocab(with_added_tokens=False) if t not in encoder.special}
    assert all(ids == [tokenizer.token_to_id(t)] for t, ids in alone.items())
    texts = [p % chr(c) for c in range(0x250) for p in ("a%sb", " %s1", "1 %s", ".%s.", "x%s", " %s %s" % ("%s", "y"))]
    draw = np.random.default_rng(1)
    texts += ["".join(draw.choice(list("etaoin   \n\t.,'sdm12é\u0085\x1c"), 30)) for _ in range(2000)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert packing.token_bytes(texts, tokenizer_path()) == want


@CASES
def test_packing(spark, rows):
    got = packing.packed(frame(spark, rows).withColumn("part", F.lit(1)), tokenizer_path(), part_items=20).toPandas()
    texts = {}
    for r in rows:
        texts[r[0]] = encoded(r[1] or "") + [2]
    copies = {k: sum(r[0] == k for r in rows) for k in texts}
    for doc_id, ids in texts.items():
        own = got[got.doc_id.isna() if doc_id is None else got.doc_id == doc_id].sort_values("piece")
        n = len(ids)
        ends = [n] if n <= 1024 else list(range(n % 1024 or 1024, n + 1, 1024))
        want = [(k, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip([0, *ends], ends))]
        have = sorted(map(tuple, own[["piece", "start", "length", "ids_crc32"]].astype(int).to_numpy().tolist()))
        assert have == sorted(want * copies[doc_id])
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.length.sum() <= 1024 and (own.offset.to_numpy() == np.concatenate([[0], np.cumsum(own.length)[:-1]])).all()
    if rows:
        assert got.sequence_id.nunique() <= 1.05 * got.length.sum() / 1024 + 2


def test_packing_parts_stay_bounded(spark, monkeypatch):
    """Articles that don't fit together: no part gets what all others leave, and bins are as few as packed in one part."""
    tables, write = [], packing.written
    monkeypatch.setattr(packing, "written", lambda df, what: tables.append((what, write(df, what))) or tables[-1][1])
    sizes = np.random.default_rng(2).integers(600, 1001, 400).tolist() + [5, 30, 300, 400, 500, 500]
    rows = [(i, " ".join(["a"] * (n - 1)), "en", "a", 1) for i, n in enumerate(sizes)]
    got = packing.packed(frame(spark, rows), tokenizer_path(), part_items=40).toPandas()
    assert sorted(got.length) == sorted(sizes) and got.groupby("sequence_id").length.sum().max() <= 1024
    assert got.sequence_id.nunique() == len(set(packing.best_fit(np.array(sizes)).tolist()))
    bins = [t for what, t in tables if what == "bins"]
    for t in bins:
        assert t.groupBy("part").agg(F.sum(F.size("members")).alias("n")).agg(F.max("n")).first()[0] <= 80


def test_best_fit():
    sizes = np.random.default_rng(0).integers(1, 1025, 3000)
    bins = packing.best_fit(sizes)
    loads = np.bincount(bins, sizes)
    assert loads.max() <= 1024 and len(loads) <= 1.03 * sizes.sum() / 1024 + 1


def targets(sizes, weights, share=1.5, ceiling=2.0):
    """By passing on, again and again, what exceeds a ceiling."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, budget = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        left = budget - sum(fixed.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > ceiling * sizes[s]]
        if not over:
            return fixed | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        fixed |= {s: ceiling * sizes[s] for s in over}


@CASES
@pytest.mark.parametrize("few", [True, False])
def test_mixing(spark, rows, few, monkeypatch):
    if not few:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    got = mixing.planned(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(fixtures.words(r[1]))
    want = targets(sizes, (5, 2, 1)) if rows else {}
    for r in got:
        assert r._size == len(fixtures.words(r.text)) and r._source_size == sizes[r.source]
        assert r._target == pytest.approx(want[r.source]) and 0 <= r._times <= 2
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r._size == 0 or r._times in (int(rate + 1e-9), int(rate + 1e-9) + 1)
    again = {(r.doc_id, r.text): r._times for r in mixing.planned(frame(spark, rows)).collect()}
    assert again == {(r.doc_id, r.text): r._times for r in got}
    columns = ["doc_id", "_size", "_source_size", "_target", "_times"]
    same = mixing.planned_sizes(frame(spark, rows).withColumn("_size", F.lit("x"))).select(columns).collect()
    assert sorted(map(str, same)) == sorted(str(r) for r in mixing.planned(frame(spark, rows)).select(columns).collect())
    mixed = mixing.mix(frame(spark, rows).withColumn("_size", F.lit("x")))
    assert mixed.columns[-1] == "_size" and mixed.count() == sum(r._times for r in got)


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 90), "en", f"s{i % 5}", 1) for i in range(2000)]
    sums = mixing.planned(frame(spark, rows)).groupBy("source").agg(F.first("_target").alias("t"), F.sum(F.col("_size") * F.col("_times")).alias("n"))
    assert all(abs(r.n - r.t) < 0.02 * r.t for r in sums.collect())


def least_largest(sizes, k):
    """The smallest possible largest shard, by dynamic programming."""
    sums = [0, *np.cumsum(sizes).tolist()]
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(k):
        best = [0] + [min(max(best[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(1, len(sums))]
    return best[-1]


def test_contiguous_shards_are_minimax():
    draw = np.random.default_rng(2)
    for n, k in ((1, 3), (10, 3), (40, 7), (60, 24)):
        sizes = draw.integers(1, 500, n)
        sizes[0] *= draw.integers(1, 30)
        got = sharding.contiguous_shards(sizes, k)
        assert (np.diff(got) >= 0).all() and got.max() < k
        assert np.bincount(got, sizes).max() == least_largest(sizes, k) == sharding.smallest_capacity(sizes, k)


@CASES
def test_sharding(spark, rows, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_TASK", 2)
    got = sharding.sharded(frame(spark, rows), 5).collect()
    assert len(got) == len(rows)
    want = sorted((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows if r[0] is not None)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == want
    by_shard, by_text = {}, {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and all(len(s) == 1 for s in by_text.values())


def test_binomial_bound():
    from math import comb

    for n, p in ((10, 0.3), (200, 0.01), (60, 0.5)):
        for k in range(n + 1):
            exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert quality_rules.at_most(k, n, p) == pytest.approx(exact, rel=1e-9, abs=1e-14)
    assert 0.4 < quality_rules.at_most(10_000, 1_000_000, 0.01) < 0.6


@CASES
def test_quality_statistics(spark, rows):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (8, 1, 0), (8, 0, 0), (99, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_rules.judged(frame(spark, rows), labels)[0].collect()
    want = sorted(((r[0], *fixtures.statistics(r[1])) for r in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = quality_rules.filtered(frame(spark, rows).withColumn("s", F.lit(1)).withColumn("n_words", F.lit(2)), labels)
    assert kept.count() == sum(r.kept for r in got) and kept.columns[-2:] == ["s", "n_words"]


def test_rules_reject_the_bad_and_spare_the_good(spark):
    rows = [(i, " ".join(f"word{(i * 37 + j) % 997}" + ("###" if i % 4 == 0 else "") for j in range(60)), "en", "a", 1) for i in range(6000)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(6000)], "doc_id bigint, quality int, toxic int")
    judged, limits = quality_rules.judged(frame(spark, rows), labels)
    bad = judged.filter("doc_id % 4 = 0")
    assert bad.filter("kept").count() == 0 and judged.filter("doc_id % 4 != 0 and not kept").count() <= 0.05 * 4500
    assert limits.collect()[0]["symbols"] is not None


def test_cutoffs_like_brute_force(spark):
    """Cutoffs and verdicts from the definition, with a stratum of too few labels and one without any."""
    from math import comb

    draw = np.random.default_rng(6)
    rows, good = [], []
    for i in range(2600):
        lang = "en" if i < 2300 else ["few", "none", None][i % 3]
        words = [f"w{draw.integers(0, 9999)}" + ("#" * int(draw.integers(1, 9)) if draw.random() < 0.02 * (i % 7) else "") for _ in range(55)]
        rows.append((i, " ".join(w.upper() if i % 50 == 0 else w for w in words), lang, "a", 1))
        if lang != "none" and i % 7 < 3:
            good.append(i)
    labels = spark.createDataFrame([(i, 1, 0) for i in sorted(set(good))], "doc_id bigint, quality int, toxic int")
    judged, limits = quality_rules.judged(frame(spark, rows), labels)
    stats = {r.doc_id: r for r in judged.collect()}
    ratios = lambda r: {k: getattr(r, a) / getattr(r, b) if getattr(r, b) else 0.0 for k, (a, b) in quality_rules.RULES.items()}
    strata = {}
    for i in set(good):
        strata.setdefault(stats[i].lang, []).append(ratios(stats[i]))
    rate, want = 0.05, {}
    for lang, own in strata.items():
        limit = dict.fromkeys(quality_rules.RULES)
        for rule, cut in quality_rules.PATH:
            tried = limit | {rule: cut}
            k = sum(any(c is not None and r[x] > c for x, c in tried.items()) for r in own)
            if sum(comb(len(own), x) * rate**x * (1 - rate) ** (len(own) - x) for x in range(k + 1)) > 0.05 / len(strata):
                break
            limit = tried
        want |= {(lang, rule): c for rule, c in limit.items()}
    got = {(r.lang, rule): r[rule] for r in limits.collect() for rule in quality_rules.RULES}
    assert got == want and set(want.values()) > {None} and all(want["few", rule] is None for rule in quality_rules.RULES)
    for r in stats.values():
        passed = all(want.get((r.lang, rule)) is None or x <= want[r.lang, rule] for rule, x in ratios(r).items())
        assert r.kept == (passed and not r.base_failed)
    assert any(not r.kept for r in stats.values())


def test_path_is_nested():
    """Each step lowers one rule's cutoff; every rule gets to the end of the grid."""
    for k, (rule, cut) in enumerate(quality_rules.PATH):
        before = quality_rules.cutoffs_after(k)
        assert before[rule] is None or before[rule] > cut
    assert quality_rules.cutoffs_after(len(quality_rules.PATH)) == dict.fromkeys(quality_rules.RULES, 0.05)


def test_small_strata_are_certified(spark):
    """90 good documents of which none is rejected certify the strictest step for what they lack; 70 don't."""
    good = lambda lang, n: [(lang, 0, 60, 300, 0, 5, 0, 0, 0)] * n
    schema = "lang string, n_symbols int, n_words int, word_chars int, n_dup_lines int, n_lines int, n_repeat_words int, n_capitals int, n_exclaims int"
    rows = good("a", 90) + good("b", 70) + good("c", 200) + [("c", 90, 60, 300, 0, 5, 0, 0, 0)] * 30
    got = {r.lang: r for r in quality_rules.cutoffs(spark.createDataFrame(rows, schema)).collect()}
    assert got["a"].symbols == got["a"].repeats == 0.05 and got["b"].symbols is None
    assert got["c"].exclaims == 0.05 and got["c"].symbols == 0.3  # the next step would reject 30 of 230


def test_rate_of_false_rejection_is_held():
    """Over many draws of labels, the rate of the chosen step exceeds the permitted one no more often than it may."""
    draw, exceeded = np.random.default_rng(3), 0
    rates = np.linspace(0.01, 0.09, 17)  # of a nested path
    for _ in range(400):
        worst = draw.random(300)
        steps = 0
        for rate in rates:
            if quality_rules.at_most(int((worst < rate).sum()), 300, 0.05) > 0.05:
                break
            steps += 1
        exceeded += steps > 0 and rates[steps - 1] > 0.05 + 1e-9
    assert exceeded <= 0.05 * 400 + 2 * (0.05 * 0.95 * 400) ** 0.5


def test_pipeline(spark):
    """Each stage on its own input, against the brute-force versions."""
    import corpus_pipeline as p

    from tests.llm.test_dedup import keepers

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in p.STAGES] == ["quality_rules", "exact_dedup", "minhash_near_dedup", "mix_sources", "best_fit_packing"]
    good = p.keep_good(spark, docs, sf).persist()
    rows = [tuple(r) for r in good.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert good.columns == columns and rows
    assert all(fixtures.statistics(r[1])[0] >= 50 for r in rows)
    unique = p.drop_copies(spark, good, sf).persist()
    assert unique.columns == columns
    assert sorted(r.doc_id for r in unique.collect()) == sorted(k[0] for k in keepers(rows) if k[3])
    left = [tuple(r) for r in unique.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    near = p.drop_near_copies(spark, unique, sf).persist()
    assert near.columns == columns
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, c in fixtures.components(left).values()})
    mixed = p.mix_sources(spark, near, sf).persist()
    assert mixed.columns == columns
    packed = p.pack(spark, mixed, sf)
    assert packed.filter("piece = 0").count() == mixed.count()
    sizes = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert sizes.filter("n > 1024").count() == 0
    run = p.run(spark, sf)
    assert run.count() == packed.count() and run.columns == packed.columns


@pytest.mark.parametrize("rows", [fixtures.awkward(), [], fixtures.corpus(40)], ids=["awkward", "empty", "corpus"])
def test_stages_on_defined_cases(spark, rows):
    """Nulls, empty and very long texts, repeated rows, empty tables and clashing columns go through every stage as its docstring says."""
    import corpus_pipeline as p

    docs = frame(spark, rows)
    for name in ("id", "size", "digest", "hash", "row", "_size", "s", "keep_id", "source_size"):
        docs = docs.withColumn(name, F.lit("x"))
    got = {name: stage(spark, docs, "/root/testdata/sf0.001") for name, stage in p.STAGES}
    for name, df in got.items():
        assert name == "best_fit_packing" or df.columns == docs.columns
    count = {name: df.count() for name, df in got.items()}
    texts = [r[1] or "" for r in rows]
    plain = ["".join(fixtures.words(t)) for t in texts]
    assert count["exact_dedup"] == len(set(plain))
    assert count["quality_rules"] <= sum(len(fixtures.words(t)) >= 50 for t in texts)
    wordless = len({(r[0], t) for r, t in zip(rows, texts, strict=True) if not fixtures.words(t)})
    assert wordless <= count["minhash_near_dedup"] <= len(rows)
    assert {r.doc_id for r in got["mix_sources"].collect()} <= {r[0] for r in rows if fixtures.words(r[1])}
    assert {r.doc_id for r in got["best_fit_packing"].collect()} == {r[0] for r in rows}


@pytest.mark.parametrize("n_shards", [2, 3, 5])
@pytest.mark.parametrize("bits", [1, 2, 16])
def test_sharding_like_brute_force(spark, monkeypatch, n_shards, bits):
    """The largest shard is the least that any contiguous partition of the ordered groups has, however coarse the first cells are."""
    monkeypatch.setattr(sharding, "BITS", bits)
    monkeypatch.setattr(sharding, "MORE_BITS", 2)
    monkeypatch.setattr(sharding, "REFINED", 3)
    rows = fixtures.corpus(11, 5) + fixtures.corpus(3, 5)
    docs = frame(spark, rows)
    got = sharding.sharded(docs, n_shards).collect()
    sizes = {}
    for r in docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), (F.octet_length(F.coalesce("text", F.lit(""))) + 8).alias("size")).collect():
        sizes[r.key] = sizes.get(r.key, 0) + r["size"]
    best = least_largest([sizes[u] for u in sorted(sizes)], n_shards)
    bytes_of, slots = {}, {}
    for r in got:
        bytes_of[r.shard] = bytes_of.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(bytes_of.values()) == best and len(got) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(r["size"] for r in got) == sorted(len(r[1].encode()) + 8 for r in rows)
    assert all(r.text_crc32 in {zlib.crc32(t[1].encode()) for t in rows if t[0] == r.doc_id} for r in got)


@pytest.mark.parametrize("hot", [1, 400, 30_000])
def test_cells_are_refined_until_the_capacity_is_known(spark, monkeypatch, hot):
    """Groups in few cells, one of them with many rows: the capacity is that of all groups, most of which stay in coarse cells."""
    monkeypatch.setattr(sharding, "BITS", 4)
    monkeypatch.setattr(sharding, "MORE_BITS", 3)
    draw = np.random.default_rng(hot)
    keys = np.unique(draw.integers(-(1 << 63), 1 << 63, 3000))
    sizes = draw.integers(8, 400, len(keys))
    sizes[700] *= hot
    groups = spark.createDataFrame(pd.DataFrame({"key": keys, "bytes": sizes, "n": 1}))
    cells = sharding.balanced_cells(groups, 6)
    assert sharding.smallest_capacity(cells["bytes"].to_numpy(), 6) == sharding.smallest_capacity(sizes, 6)
    assert cells["bytes"].sum() == sizes.sum() and cells["n"].sum() == len(keys) and len(cells) < len(keys) / 2


@pytest.mark.parametrize("capacity", [16, 100])
def test_packing_like_plain_best_fit(spark, capacity):
    """In one part, as many sequences as best fit over the sorted pieces gives, piece by piece from the tokenizer's own ids."""
    rows = fixtures.corpus(50, 2)
    got = packing.packed(frame(spark, rows), tokenizer_path(), capacity).collect()
    want = {}
    for doc_id, text, *_ in rows:
        ids = [*encoded(text), 2]
        head = len(ids) % capacity if len(ids) > capacity else len(ids)
        cuts = [0, *range(head or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc_id, piece] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    bins = []
    for _, n, _ in sorted(want.values(), key=lambda x: -x[1]):
        room = [b for b in bins if b[0] >= n]
        if room:
            min(room)[0] -= n
        else:
            bins.append([capacity - n])
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(places) == len(bins)
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= capacity
