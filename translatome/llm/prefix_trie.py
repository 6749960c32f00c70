"""The trie of conversation prefixes: who shares each prefix, and what is saved by storing or computing it once.

Conversations are ordered by turn (null first, ties by role, then text) and rebuilt: conversation c takes the first h = crc32(c) mod 4 turns of
conversation c - c % BLOCK, then its own after its first h. A node is a distinct sequence of first turns (role, text).

1. A node is known by its depth and the exclusive or of 128-bit hashes of (position, role, text) over its turns. That is a running sum along a
   conversation, taken within stretches of STRETCH turns and carried from one to the next, so that one conversation may have any length.
2. Partial tries: conversations are dealt to SLOTS slots by block; each slot combines its nodes locally (members, smallest member, ends).
3. Tree merges: FAN slots at a time become one, hash-keyed by (slot, node), until one trie is left: members are summed, ends appended.
   Ends are held in lists of ids of one range of 65,536 each, so that no list grows with the data; a node's lists are digested in order, one by one.
4. Rollup from the bottom: where only one conversation is a member, the subtree is a path with one leaf and nothing saved, so only shared nodes are
   rolled up. Subtree sums over distances below 2^k give those below 2^(k+1) by the sums of the descendants at distance 2^k, so that
   the rounds grow with the logarithm of the depth.

Defined cases: null roles and texts are empty; turns without conv_id belong to no conversation and are left out; repeated rows and ties are
turns each, in the order above; very long texts are hashed and counted whole; an empty table has no root and gives no row;
further columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from translatome.llm.common import word_count, written

BLOCK, HEADS = 20, 4
#: Turns of one stretch of a conversation, and rows that one task orders.
STRETCH = 50_000
SLOTS, FAN = 256, 16
_KEY = ["depth", "one", "two"]


def _placed(conversations: DataFrame) -> DataFrame:
    """conv_id, at (1, 2, ...), role, text, words of each turn.

    Turns are dealt by ranges of their order first; the rank in a range and the turns in earlier ranges make the place, so
    that one conversation may fill many ranges.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", empty("role"), empty("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "salt"]
    dealt = turns.withColumn("salt", F.rand(11)).repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    dealt = written(dealt.select("conv_id", "turn", "role", "text", "salt", "range", word_count(F.col("text")).alias("words")), "turn-ranges")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(before))
    sizes = sizes.filter("before IS NOT NULL").select("conv_id", "range", "before")  # a conversation's first range needs none
    own = Window.partitionBy("conv_id", "range").orderBy(*order[1:])
    ranked = dealt.withColumn("rank", F.row_number().over(own))
    return ranked.join(sizes, ["conv_id", "range"], "left").select(
        "conv_id", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("at"), "role", "text", "words"
    )


def rebuilt(conversations: DataFrame, block: int = BLOCK, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, at, code, words; code is what the node's hashes are made of) and conversations (conv_id, turns) after rebuilding."""
    placed = _placed(conversations)
    code = F.struct(F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("t"), "text", "role").alias("b"))
    placed = written(placed.select("conv_id", "at", code.alias("code"), "words"), "placed-turns")
    group = F.col("conv_id") - F.col("conv_id") % block
    convs = placed.groupBy("conv_id").agg(F.max("at").alias("n"))
    convs = convs.withColumns({"base": group, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads})
    have = convs.filter(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("of_base"))
    convs = convs.join(have, "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "n", "h", "taken"), "conversation-heads")
    first = placed.filter((F.col("at") < heads) & (F.col("conv_id") == group)).withColumnRenamed("conv_id", "base")
    shared = first.join(convs.select("conv_id", "base", "taken"), "base").filter(F.col("at") <= F.col("taken"))
    later = placed.join(convs.select("conv_id", "h", "taken"), "conv_id").filter(F.col("at") > F.col("h"))
    turns = shared.select("conv_id", "at", "code", "words").union(
        later.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "code", "words")
    )
    left = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return turns, convs.select("conv_id", (F.col("taken") + left).alias("turns"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, one, two, above_one, above_two, words: the node that each turn leads to and the one above it."""
    hashes = turns.select(
        "conv_id", F.col("at").alias("depth"), "words",
        F.floor((F.col("at") - 1) / STRETCH).alias("stretch"),
        F.xxhash64("at", "code").alias("x"),
        F.xxhash64(F.lit("second"), "code", "at").alias("y"),
    )
    hashes = written(hashes, "turn-hashes")
    whole = hashes.groupBy("conv_id", "stretch").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("conv_id", "stretch", F.bit_xor("x").over(before).alias("bx"), F.bit_xor("y").over(before).alias("by")).filter("stretch > 0")
    own = Window.partitionBy("conv_id", "stretch").orderBy("depth")
    runs = hashes.withColumns({"rx": F.bit_xor("x").over(own), "ry": F.bit_xor("y").over(own)})
    carry = lambda run, before: run.bitwiseXOR(F.coalesce(before, F.lit(0)))
    return (
        runs.join(carried, ["conv_id", "stretch"], "left")
        .withColumns({"one": carry(F.col("rx"), F.col("bx")), "two": carry(F.col("ry"), F.col("by"))})
        .select("conv_id", *_KEY, F.col("one").bitwiseXOR(F.col("x")).alias("above_one"), F.col("two").bitwiseXOR(F.col("y")).alias("above_two"), "words")
    )


def _slot(conv_id: Column) -> Column:
    """The partial trie that a conversation belongs to; conversations of a block share most."""
    return F.pmod(F.xxhash64(conv_id - conv_id % BLOCK), F.lit(SLOTS))


def _merged(tables: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Tables of one row for each slot and key, merged FAN slots at a time until one is left; `sums` merge columns of their names."""
    slots = SLOTS
    tables = tables.groupBy("slot", *keys).agg(*(c.alias(n) for n, c in sums.items()))
    while slots > 1:
        slots = -(-slots // FAN)
        tables = tables.withColumn("slot", F.col("slot").bitwiseAND(slots - 1)) if slots > 1 else tables.withColumn("slot", F.lit(0).cast("bigint"))
        tables = tables.groupBy("slot", *keys).agg(*(c.alias(n) for n, c in sums.items()))
    return tables.drop("slot")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of a node's ids in order in; the hash of all of them out, list by list."""
    key, digest = None, None

    def batch_of(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*_KEY, "ends_sha256"])

    for batch in batches:
        out = []
        for *k, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids")), strict=True):
            if k != key:
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield batch_of(out)
    if key:
        yield batch_of([(*key, digest.hexdigest())])


def _ends(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """depth, one, two, ends_sha256 of the nodes where conversations end."""
    zero = F.lit(0).cast("bigint")
    last = prefixes.join(convs.filter("turns > 0"), (prefixes.conv_id == convs.conv_id) & (prefixes.depth == convs.turns)).select(prefixes.conv_id, *_KEY)
    last = last.union(convs.filter("turns = 0").select("conv_id", zero, zero, zero))
    lists = last.select(_slot(F.col("conv_id")).alias("slot"), *_KEY, F.shiftright("conv_id", 16).alias("range"), F.array("conv_id").alias("ids"))
    lists = _merged(lists, [*_KEY, "range"], {"ids": F.flatten(F.collect_list("ids"))})
    text = F.array_join(F.transform(F.array_sort("ids"), lambda i: i.cast("string")), ",")
    lists = lists.select(*_KEY, "range", text.alias("ids")).repartition(*_KEY).sortWithinPartitions(*_KEY, "range")
    return lists.select(*_KEY, "ids").mapInArrow(_digests, "depth bigint, one bigint, two bigint, ends_sha256 string")


def _rolled_up(shared: DataFrame) -> DataFrame:
    """depth, one, two, leaves, saved: sums over subtrees of (depth, one, two, above_one, above_two, leaves, saved)."""
    up = F.struct((F.col("depth") - 1).alias("depth"), F.col("above_one").alias("one"), F.col("above_two").alias("two"))
    now = written(shared.select(F.struct(*_KEY).alias("node"), F.when(F.col("depth") > 0, up).alias("up"), "leaves", "saved"), "rollup")
    while not now.filter("up IS NOT NULL").isEmpty():
        gained = now.filter("up IS NOT NULL").groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = now.select(F.col("node").alias("up"), F.col("up").alias("further"))
        plus = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        now = written(
            now.join(gained.withColumnRenamed("up", "node"), "node", "left")
            .join(above, "up", "left")
            .select("node", F.col("further").alias("up"), plus("leaves"), plus("saved")),
            "rollup",
        )
    return now.select("node.*", "leaves", "saved")


def trie(conversations: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node."""
    turns, convs = rebuilt(conversations, block, heads)
    convs = written(convs, "rebuilt-conversations")
    prefixes = written(_prefixes(turns), "prefixes")
    zero = F.lit(0).cast("bigint")
    above = ["above_one", "above_two"]
    rows = prefixes.select("conv_id", *_KEY, *above, "words").union(convs.select("conv_id", *[zero] * 6))
    members = rows.select(_slot(F.col("conv_id")).alias("slot"), *_KEY, *above, "words", "conv_id", F.lit(1).cast("bigint").alias("n_convs"))
    nodes = written(_merged(members, [*_KEY, *above], {"words": F.min("words"), "conv_id": F.min("conv_id"), "n_convs": F.sum("n_convs")}), "trie-nodes")

    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above_one").alias("one"), F.col("above_two").alias("two"))
    below = below.agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("n_alone"))
    nodes = nodes.join(below, _KEY, "left").withColumns({c: F.coalesce(c, zero) for c in ("n_children", "n_alone")})
    nodes = written(nodes, "trie-nodes-with-children")
    shared = nodes.filter((F.col("n_convs") > 1) | (F.col("depth") == 0))
    leaves = F.col("n_alone") + (F.col("n_children") == 0).cast("bigint")
    sums = _rolled_up(shared.select(*_KEY, *above, leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))

    parents = nodes.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("one").alias("above_one"), F.col("two").alias("above_two"), F.col("conv_id").alias("parent_conv_id")
    )
    return (
        nodes.join(sums, _KEY, "left")
        .join(_ends(prefixes, convs), _KEY, "left")
        .join(parents, ["depth", *above], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
            F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            F.coalesce("saved", zero).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )


SQL = """
WITH RECURSIVE bits AS (
  SELECT range AS byte, range AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
entries AS (SELECT byte, c AS entry FROM bits WHERE k = 8),
crc AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS rest, 4294967295::BIGINT AS c FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT conv_id, rest[2:], xor(c >> 8, entry) FROM crc JOIN entries ON byte = xor(c & 255, ascii(rest)::BIGINT) WHERE rest <> ''),
heads AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(c, 4294967295) % 4 AS h FROM crc WHERE rest = ''),
placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
both_parts AS (
  SELECT heads.conv_id, 0 AS part, place, role, text FROM heads JOIN placed ON placed.conv_id = base AND place <= h
  UNION ALL
  SELECT heads.conv_id, 1, place, role, text FROM heads JOIN placed ON placed.conv_id = heads.conv_id AND place > h),
rebuilt AS (SELECT conv_id, {'role': role, 'text': text} AS said, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM both_parts),
prefixes AS (
  SELECT conv_id, depth, list(said) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, [] FROM heads),
lengths AS (SELECT conv_id, max(depth) AS turns FROM prefixes GROUP BY conv_id),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = turns), '')) AS ends_sha256,
         (count(*) - 1) * coalesce(len(regexp_extract_all(path[-1].text, '[^\\x20\\x09-\\x0D]+')), 0) AS saved
  FROM prefixes JOIN lengths USING (conv_id) GROUP BY depth, path),
children AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, path)),
above AS (SELECT unnest(range(0, depth + 1)) AS top, path, saved, n_children FROM full_nodes),
subtrees AS (
  SELECT top AS depth, path[1:top] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN subtrees s ON s.depth = n.depth AND s.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]"""
