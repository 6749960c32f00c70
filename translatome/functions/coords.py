"""Coordinate expressions. Positions are 0-based; blocks are array<struct<start,len>> in genomic order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def codon_of(offset: Column) -> Column:
    """Codon of an offset from the CDS start; the frame-0 base is the middle of -1, 0, +1."""
    return F.floor((offset + 1) / 3).cast("bigint")


def frame_of(offset: Column) -> Column:
    return (F.pmod(offset + 1, F.lit(3)) - 1).cast("bigint")


def codon_length(length: Column) -> Column:
    return F.floor((length + 1) / 3).cast("bigint")


def blocks_length(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0).cast("bigint"), lambda n, b: n + b["len"])


def blocks_start(blocks: Column) -> Column:
    return F.get(blocks, F.lit(0))["start"]


def blocks_end(blocks: Column) -> Column:
    """First position after the last block."""
    last = F.element_at(blocks, -1)
    return last["start"] + last["len"]


def extended(blocks: Column, margin: int) -> Column:
    """The outer blocks lengthened by margin at both ends."""
    if not margin:
        return blocks
    last = F.size(blocks) - 1
    return F.transform(
        blocks,
        lambda b, i: F.struct(
            (b["start"] - F.when(i == 0, margin).otherwise(0)).alias("start"),
            (b["len"] + F.when(i == 0, margin).otherwise(0) + F.when(i == last, margin).otherwise(0)).alias("len"),
        ),
    )


def bases_before(blocks: Column, position: Column) -> Column:
    """Bases of the blocks that lie left of a genomic position."""
    return F.aggregate(
        blocks,
        F.lit(0).cast("bigint"),
        lambda n, b: n + F.greatest(F.lit(0).cast("bigint"), F.least(position - b["start"], b["len"])),
    )


def compatible(inner: Column, outer: Column) -> Column:
    """Whether spliced blocks lie in outer blocks with the same junctions."""
    first = F.get(inner, F.lit(0))
    at = F.array_position(
        F.transform(outer, lambda e: (e["start"] <= first["start"]) & (first["start"] < e["start"] + e["len"])), F.lit(True)
    ).cast("int")
    last = F.size(inner) - 1

    def fits(b: Column, i: Column) -> Column:
        e = F.get(outer, at - 1 + i)
        left = F.when(i > 0, b["start"] == e["start"]).otherwise(b["start"] >= e["start"])
        ends = (b["start"] + b["len"], e["start"] + e["len"])
        right = F.when(i < last, ends[0] == ends[1]).otherwise(ends[0] <= ends[1])
        return F.coalesce(left & right, F.lit(False))

    return (at > 0) & F.forall(F.transform(inner, fits), lambda x: x)


def five_prime(inner: Column, outer: Column, strand: Column) -> Column:
    """Transcript coordinate of the transcript-wise first base of inner blocks (on a transcript of that strand)."""
    plus = bases_before(outer, blocks_start(inner))
    last = blocks_end(inner) - 1
    minus = blocks_length(outer) - 1 - bases_before(outer, last)
    return F.when(strand == "+", plus).otherwise(minus)


def genome_position(offset: Column, blocks: Column, strand: Column) -> Column:
    """Genomic position of a transcript offset; null outside of the transcript."""
    total = blocks_length(blocks)
    along = F.when(strand == "+", offset).otherwise(total - 1 - offset)
    walked = F.aggregate(
        blocks,
        F.struct(along.alias("left"), F.lit(None).cast("bigint").alias("at")),
        lambda s, b: F.struct(
            (s["left"] - b["len"]).alias("left"),
            F.when(s["at"].isNull() & (s["left"] >= 0) & (s["left"] < b["len"]), b["start"] + s["left"]).otherwise(s["at"]).alias("at"),
        ),
    )
    return walked["at"]


def sub_blocks(blocks: Column, strand: Column, start: Column, length: Column) -> Column:
    """Genomic blocks of the transcript interval [start, start + length)."""
    total = blocks_length(blocks)
    low = F.when(strand == "+", start).otherwise(total - start - length)
    high = low + length

    def clipped(b: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(blocks, F.lit(1), i), F.lit(0).cast("bigint"), lambda n, x: n + x["len"])
        left = F.greatest(low - before, F.lit(0).cast("bigint"))
        right = F.least(high - before, b["len"])
        return F.struct((b["start"] + left).alias("start"), (right - left).alias("len"))

    return F.filter(F.transform(blocks, clipped), lambda b: b["len"] > 0)


def introns(blocks: Column) -> Column:
    """Gaps between blocks."""
    gaps = F.transform(
        F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))),
        lambda b, i: F.struct(
            (F.get(blocks, i)["start"] + F.get(blocks, i)["len"]).alias("start"),
            (b["start"] - F.get(blocks, i)["start"] - F.get(blocks, i)["len"]).alias("len"),
        ),
    )
    return F.when(F.size(blocks) > 1, gaps).otherwise(F.filter(blocks, lambda b: F.lit(False)))


def flipped(strand: Column) -> Column:
    return F.when(strand == "+", "-").otherwise("+")
