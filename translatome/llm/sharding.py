"""Sharding by minimax contiguous partition, law `bytes`.

Equal texts are one atomic group. Groups are ordered by a 64-bit hash of the text. The driver never sees them all: it starts from the
sums of at most 65,536 ranges of the hash (cells) and walks over them twice for a capacity, once as if cells could be cut anywhere and once as if
none could be cut. The smallest shard capacity lies between those two; the cells in which a cut could fall, `REFINED` a round at most, are
dealt to 256 ranges each until both walks agree. That capacity is the smallest for any contiguous partition of the groups themselves,
found by binary search with greedy walks. The cuts keep every shard within it, each as near as it can to an even share of what is left.

Texts are read once: sizes, checksums and hashes are written as a table, from which all else comes.

Defined cases: a null text counts as empty (size 8); rows that repeat are rows; shards beyond the number of
groups are empty; an empty table gives an empty result; a null doc_id sorts first, rows that tie in id and text in any order; a text longer than
an even share is a shard of its own, as it can't be cut; further columns are never read. Different texts that share a hash (of n texts about
n * n / 2**65 pairs) are one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from translatome.llm.common import written

#: Bits of the hash that tell the first cells apart, and bits that each further round adds.
BITS, MORE_BITS = 16, 8
#: Cells that are dealt to smaller ones in a round.
REFINED = 512
#: A unit of more rows than this is numbered in several tasks.
ROWS_A_TASK = 200_000


def _walk(sums: np.ndarray, capacity: int, n_shards: int) -> list[int]:
    """Greedy cuts (end of each shard), each shard as full as capacity lets it be."""
    cuts, at = [], 0
    for _ in range(n_shards):
        at = int(np.searchsorted(sums, sums[at] + capacity, side="right")) - 1
        cuts.append(at)
    return cuts


def smallest_capacity(sizes: np.ndarray, n_shards: int) -> int:
    """The smallest capacity with which n_shards contiguous shards hold all sizes."""
    sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    low, high = max(int(sizes.max(initial=0)), -(-int(sums[-1]) // n_shards)), int(sums[-1])
    while low < high:
        mid = (low + high) // 2
        if _walk(sums, mid, n_shards)[-1] == len(sizes):
            high = mid
        else:
            low = mid + 1
    return low


def contiguous_shards(sizes: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard of each size, in order; the largest shard is as small as it can be."""
    n = len(sizes)
    sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    capacity = smallest_capacity(sizes, n_shards)
    back = _walk(np.concatenate([[0], np.cumsum(sizes[::-1], dtype=np.int64)]), capacity, n_shards)
    shards, at = np.zeros(n, dtype=np.int32), 0
    for k in range(n_shards):
        left = n_shards - k
        first = n - back[left - 2] if left > 1 else n  # the shards after this one can't hold more
        last = int(np.searchsorted(sums, sums[at] + capacity, side="right")) - 1
        rest, share = sizes[at:], 0.0
        even, large = int(sums[-1] - sums[at]), 0
        for _ in range(left):  # units above an even share are shards of their own
            share = even / max(1, left - large)
            above = rest > share
            if int(above.sum()) == large:
                break
            large = min(int(above.sum()), left - 1)
            even = int(rest[~above].sum())
        goal = sums[at] + share
        near = int(np.searchsorted(sums, goal))
        if near > at + 1 and goal - sums[near - 1] < sums[min(near, n)] - goal:
            near -= 1
        end = min(max(near, first, at), last)
        shards[at:end] = k
        at = end
    return shards


def _walk_anywhere(sums: np.ndarray, whole: np.ndarray, capacity: int, n_shards: int) -> list[int]:
    """Greedy cuts in bytes, if cells that aren't whole groups could be cut anywhere."""
    cuts, at = [], 0
    for _ in range(n_shards):
        cell = int(np.searchsorted(sums, at + capacity, side="right")) - 1
        if cell >= len(whole):
            at = int(sums[-1])
        else:
            at = int(sums[cell]) if whole[cell] else at + capacity
        cuts.append(at)
    return cuts


def to_refine(cells: pd.DataFrame, n_shards: int) -> pd.DataFrame:
    """The cells that the smallest capacity still depends on, the largest first; none if it is known."""
    sizes, whole = cells["bytes"].to_numpy(np.int64), (cells["first"] == cells["last"]).to_numpy()
    if not len(sizes):
        return cells
    sums = np.concatenate([[0], np.cumsum(sizes)])
    total = int(sums[-1])
    high = smallest_capacity(sizes, n_shards)
    low, top = max(int(cells["largest"].max()), -(-total // n_shards)), high
    while low < top:
        mid = (low + top) // 2
        if _walk_anywhere(sums, whole, mid, n_shards)[-1] == total:
            top = mid
        else:
            low = mid + 1
    if low == high:
        return cells[:0]
    chosen = ~whole & (sizes > low)
    if not chosen.any():
        least, most = sums[_walk(sums, low, n_shards)], _walk_anywhere(sums, whole, high, n_shards)
        for a, b in zip(least, most, strict=True):
            chosen |= ~whole & (sums[:-1] < b) & (sums[1:] > a)
    return cells[chosen].sort_values("bytes", ascending=False, kind="stable")[:REFINED]


def _cells(groups: DataFrame, shift: int) -> pd.DataFrame:
    """Sums of the groups whose keys agree above `shift` bits, and the first and last of these keys."""
    found = groups.groupBy(F.shiftright("key", shift).alias("prefix")).agg(
        F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.max("bytes").alias("largest"), F.min("key").alias("first"), F.max("key").alias("last")
    )
    return found.toPandas().astype("int64").assign(shift=shift)


def balanced_cells(groups: DataFrame, n_shards: int) -> pd.DataFrame:
    """Cells in order of their keys, fine enough that their best partition is that of the groups (key, bytes, n)."""
    cells = _cells(groups, 64 - BITS)
    while True:
        cells = cells.sort_values("first", ignore_index=True)
        coarse = to_refine(cells, n_shards)
        if not len(coarse):
            return cells
        parts = [cells.drop(coarse.index)]
        for shift, own in coarse.groupby("shift"):
            within = groups.filter(F.shiftright("key", int(shift)).isin(own["prefix"].tolist()))
            parts.append(_cells(within, max(0, int(shift) - MORE_BITS)))
        cells = pd.concat(parts)


def _shard_of(key: Column, starts: list[tuple[int, int]]) -> Column:
    """Shard whose first key is the last that isn't above `key`, by halving (first key, shard)."""
    if len(starts) < 2:
        return F.lit(starts[0][1] if starts else 0)
    half = len(starts) // 2
    return F.when(key < starts[half][0], _shard_of(key, starts[:half])).otherwise(_shard_of(key, starts[half:]))


def sharded(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "sizes",
    )
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    cells = balanced_cells(groups, n_shards)
    cells["shard"] = contiguous_shards(cells["bytes"].to_numpy(np.int64), n_shards)
    starts = cells.groupby("shard")["first"].min()
    # a unit numbers its rows by itself: the cells of one of the first ranges that are in one shard
    units = cells.assign(unit=cells["first"].to_numpy(np.int64) >> (64 - BITS)).groupby(["shard", "unit"], as_index=False)["n"].sum()
    units["base"] = units.groupby("shard")["n"].cumsum() - units["n"]
    units["parts"] = -(-units["n"] // ROWS_A_TASK)
    plan = spark.createDataFrame(
        list(units[["shard", "unit", "base", "parts"]].itertuples(index=False, name=None)), "shard int, unit bigint, base bigint, parts bigint"
    )
    placed = rows.select(
        "doc_id", "size", "text_crc32", F.shiftright("key", 64 - BITS).alias("unit"),
        _shard_of(F.col("key"), [(int(k), int(s)) for s, k in starts.items()]).alias("shard"),
    )
    placed = placed.join(F.broadcast(plan), ["shard", "unit"]).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts")))
    cells_of = ["shard", "unit", "part"]
    counts = placed.groupBy(cells_of).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard", "unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*cells_of, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_base"))
    within = F.row_number().over(Window.partitionBy(cells_of).orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        placed.withColumn("within", within)
        .join(counts, cells_of)
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.col("cell_base") + F.col("within")).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
