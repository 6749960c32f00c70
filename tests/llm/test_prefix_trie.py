"""The conversation trie against brute force and SQL."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures
from tests.oracle import connect, same
from translatome.llm import prefix_trie, queries

SCHEMA = "conv_id bigint, turn int, role string, text string"


def plain(rows):
    """The contract on lists."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    remainder = lambda c: c % 20 if c >= 0 else -(-c % 20)
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - remainder(c), [])[:h] + turns[h:])
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for path, own_members in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in own_members if full[c] == path)
        out.append((
            min(own_members), len(path), min(members[path[:-1]]) if path else None, len(own_members),
            sum(len(p) == len(path) + 1 for p in below),
            sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below),
            sum((len(members[p]) - 1) * len(fixtures.words(p[-1][1])) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def conversations(n=130, seed=4, span=60):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        c = draw.randrange(span)
        rows += [(c, draw.choice([None, *range(6)]), draw.choice(["user", "tool", None]), draw.choice(["a b", "c", "", None, " d\te "])) for _ in range(draw.randint(0, 5))]
    return rows


def awkward():
    same_talk = [(c, t, "u", f"hello {t}") for c in (100, 101, 140, 70_000, 200_000, 2**40) for t in range(5)]
    return [
        *same_talk, (None, 1, "u", "nobody"), (5, 0, "u", "no base"), (-5, 0, "u", "below"), (-5, 1, None, None), (0, None, "u", "null first"), (0, 0, "u", "x"),
        (0, 0, "u", "x"), (0, 0, "a", "x"), (19, 3, "u", fixtures.BIG), (19, 3, "u", fixtures.BIG), (7, 1, "u", "one"), (-40, 2, "u", "t"),
    ]


CASES = {"random": conversations(), "few": conversations(40, 9, 300), "awkward": awkward(), "empty": [], "unnamed": [(None, 0, "a", "b")]}


@pytest.mark.parametrize("rows", CASES.values(), ids=CASES.keys())
def test_like_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("depth", "one", "words", "slot", "range", "at", "base", "n", "code", "salt"):
        df = df.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, prefix_trie.trie(df).collect()), key=str) == plain(rows)


def test_long_and_common_conversations(spark, monkeypatch):
    """One conversation over many stretches and ranges, one that many repeat."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 7)
    rows = [(c, t, "u", f"t{t % 11}") for c in (3, 20, 44) for t in range(40)] + [(c, t, "a", "same here") for c in range(60, 90) for t in range(3)]
    assert sorted(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str) == plain(rows)


def test_like_sql(spark):
    sf = "/root/testdata/sf0.001"
    same(queries.op13_conversation_trie(spark, sf), connect(sf), queries.oracle_sql()["op13_conversation_trie"])
