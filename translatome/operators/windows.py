"""Coverage, position windows, runs and peaks along references."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from translatome.functions import ordered
from translatome.functions.statistics import ratio


def coverage(reads: DataFrame, keys: list[str] = ["ref"]) -> DataFrame:  # noqa: B006
    """Depth where it changes: keys, start, end (half-open) and depth > 0. Events are added up before they are ordered."""
    events = reads.select(*keys, F.explode(F.array(
        F.struct(F.col("pos").alias("at"), F.lit(1).alias("step")), F.struct((F.col("pos") + F.col("len")).alias("at"), F.lit(-1).alias("step"))
    )).alias("e"))
    steps = ordered.blocked(events.groupBy(*keys, F.col("e.at").alias("start")).agg(F.sum("e.step").alias("step")), "start")
    depths = ordered.running(steps, keys, ["start"], {"depth": ("sum", F.col("step"))}, beside={"end": ("start", False)})
    return depths.filter("depth > 0").select(*keys, "start", "end", "depth")


def start_end_cover(reads: DataFrame, length: int) -> DataFrame:
    """ref, pos, n_start, n_end, cover for positions in [0, length) with any; ends and cover are clipped."""
    counts = reads.filter("pos >= 0").groupBy("ref", "pos", "len").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    rows = counts.select("ref", F.explode(F.array(
        F.struct(F.col("pos").alias("at"), F.col("n").alias("s"), zero.alias("e"), F.col("n").alias("c")),
        F.struct((F.col("pos") + F.col("len") - 1).alias("at"), zero.alias("s"), F.col("n").alias("e"), zero.alias("c")),
        F.struct((F.col("pos") + F.col("len")).alias("at"), zero.alias("s"), zero.alias("e"), (-F.col("n")).alias("c")),
    )).alias("x"))
    sums = rows.groupBy("ref", F.col("x.at").alias("pos")).agg(F.sum("x.s").alias("n_start"), F.sum("x.e").alias("n_end"), F.sum("x.c").alias("step"))
    cover = ordered.running(ordered.blocked(sums, "pos"), ["ref"], ["pos"], {"cover": ("sum", F.col("step"))})
    return cover.filter(F.col("pos") < length).drop("step", ordered.BLOCK)


def _window_counts(weight: str | None = None) -> list[Column]:
    """weight: a column that says how many reads a row is; 1 without."""
    each = F.col(weight) if weight else F.lit(1)
    uniq = F.sum(F.when(F.coalesce(F.col("nh") == 1, F.lit(False)), each).otherwise(0))
    perf = F.sum(F.when(F.coalesce(F.col("nm") == 0, F.lit(False)), each).otherwise(0))
    raw = F.sum(F.when(F.col("pos").isNotNull(), each).otherwise(0))
    return [raw.alias("raw"), uniq.alias("uniq"), perf.alias("perf"), F.sum(F.coalesce(each / F.col("nh"), F.lit(0.0))).alias("scaled")]


def _ratios(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("scaled_ratio", ratio(F.col("scaled"), F.col("raw")))
        .withColumn("uniq_ratio", ratio(F.col("uniq"), F.col("raw")))
        .withColumn("perf_ratio", ratio(F.col("perf"), F.col("raw")))
    )


def reference_windows(reads: DataFrame, sequences: DataFrame, size: int, step: int | None = None, least: int = 0) -> DataFrame:
    """Counts of reads (by start) in windows of references: ref, win_start, raw, uniq, perf, scaled and ratios.

    sequences: ref, length. Windows start at 0, step, ... up to one beyond floor((length - size) / step); ends are clipped.
    """
    step = step or size
    last = 1 + F.floor((F.col("length") - size) / step)
    grid = sequences.filter(F.col("length") > 0).select("ref", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0)))).alias("w"))
    grid = grid.select("ref", (F.col("w") * step).alias("win_start"), F.least("length", F.col("w") * step + size).alias("win_end"))
    first = F.greatest(F.floor((F.col("pos") - size) / step) + 1, F.lit(0))
    dealt = reads.filter("pos >= 0").select("ref", "pos", "nh", "nm", F.explode(F.sequence(first, F.floor(F.col("pos") / step))).alias("w"))
    counts = (
        dealt.join(sequences, "ref")
        .filter(F.col("pos") < F.col("length"))
        .groupBy("ref", (F.col("w") * step).alias("win_start"))
        .agg(*_window_counts())
    )
    zeros = {c: 0 for c in ("raw", "uniq", "perf")} | {"scaled": 0.0}
    joined = grid.join(counts, ["ref", "win_start"], "left").na.fill(zeros).filter(F.col("raw") >= least)
    return _ratios(joined)


def transcript_windows(placed: DataFrame, transcripts: DataFrame, lengths: Column, size: int, weight: str | None = None) -> DataFrame:
    """Counts of placed reads (by lo; weight: a column of how many they are) in tumbling windows 0 .. length // size of transcripts."""
    grid = transcripts.select("trx_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(lengths / size))).alias("w"))
    counts = placed.filter("lo >= 0").withColumn("pos", F.col("lo")).groupBy("trx_id", F.floor(F.col("lo") / size).alias("w")).agg(*_window_counts(weight))
    zeros = {c: 0 for c in ("raw", "uniq", "perf")} | {"scaled": 0.0}
    joined = grid.join(counts, ["trx_id", "w"], "left").na.fill(zeros)
    return _ratios(joined.select("trx_id", (F.col("w") * size).alias("win_start"), "raw", "uniq", "perf", "scaled"))


def _runs(on: DataFrame, keys: list[str], at: str, hulls: dict[str, Column], size: int) -> DataFrame:
    """keys, first and last of each run of consecutive positions, and the least (_first) and greatest (_last) of further columns in it.

    on: distinct positions. Runs are found in stretches of `size` positions; only those that touch the edge of a stretch, two of each at
    most, are joined along the whole group.
    """
    columns = {"first": F.col(at), "last": F.col(at)} | hulls
    of = lambda name: F.min if name.endswith("first") else F.max
    stretch = F.floor(F.col(at) / size)
    place = F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy(at))
    rows = on.withColumn("_stretch", stretch).withColumn("_run", F.col(at) - place)
    parts = rows.groupBy(*keys, "_stretch", "_run").agg(*(of(n)(c).alias(n) for n, c in columns.items())).select(*keys, *columns)
    touches = (F.pmod("first", F.lit(size)) == 0) | (F.pmod(F.col("last") + 1, F.lit(size)) == 0)
    order = Window.partitionBy(*keys).orderBy("first")
    opens = F.coalesce(F.col("first") - F.lag("last").over(order) > 1, F.lit(True))
    edges = parts.filter(touches).withColumn("_opens", opens.cast("int"))
    edges = edges.withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.groupBy(*keys, "_run").agg(*(of(n)(n).alias(n) for n in columns)).drop("_run")
    return parts.filter(~touches).unionByName(joined)


def islands(track: DataFrame, keys: list[str], at: str = "nt", size: int = 1 << 16) -> DataFrame:
    """Runs of consecutive positions as inclusive intervals: keys, first, last. Null positions are left out."""
    return _runs(track.select(*keys, at).filter(F.col(at).isNotNull()).distinct(), keys, at, {}, size)


def peak_hulls(track: DataFrame, keys: list[str], at: str = "nt", size: int = 1 << 16) -> DataFrame:
    """Islands of positions where a or b holds, with the hulls of a, of b and of both inside each.

    track: keys, at, a, b (boolean), one row for a position. Null counts as false; null positions are left out.
    """
    a, b = (F.coalesce(F.col(c), F.lit(False)) for c in ("a", "b"))
    on = track.select(*keys, at, a.alias("a"), b.alias("b")).filter("a or b")
    of = {"a": F.col("a"), "b": F.col("b"), "both": F.col("a") & F.col("b")}
    return _runs(on, keys, at, {f"{n}_{e}": F.when(c, F.col(at)) for n, c in of.items() for e in ("first", "last")}, size)


def peak_type() -> Column:
    """B if both tracks meet, else H or L for the track that the peak is of."""
    return (
        F.when(F.col("both_first").isNotNull(), "B")
        .when(F.col("a_first").isNotNull() & F.col("b_first").isNull(), "H")
        .when(F.col("b_first").isNotNull() & F.col("a_first").isNull(), "L")
        .otherwise("?")
    )


def greedy_peaks(cover: DataFrame, least: float, half_width: int = 25) -> DataFrame:
    """ref, peak, height: the highest position above max(1, least), then the next outside of half_width around it, and so on.

    cover: ref, pos, cover. Picking is sequential, but positions more than half_width apart don't touch: what gaps of that width part are
    clusters of their own, each picked in a task.
    """
    threshold = max(1.0, float(np.ceil(least)))

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["cover", "pos"], ascending=[False, True])
        taken: list[int] = []
        rows = []
        for ref, pos, height in zip(part["ref"], part["pos"], part["cover"], strict=True):
            at = bisect_left(taken, pos)
            if all(abs(pos - t) > half_width for t in taken[max(0, at - 1) : at + 1]):
                taken.insert(at, pos)
                rows.append((ref, pos, height))
        return pd.DataFrame(rows, columns=["ref", "peak", "height"])

    high = ordered.blocked(cover.filter(F.col("cover") > threshold).select("ref", "pos", "cover"), "pos")
    high = ordered.running(high, ["ref"], ["pos"], {}, beside={"before": ("pos", True)})
    opens = F.coalesce(F.col("pos") - F.col("before") > half_width, F.lit(True))
    clusters = ordered.running(high, ["ref"], ["pos"], {"cluster": ("max", F.when(opens, F.col("pos")))})
    return clusters.select("ref", "cluster", "pos", "cover").groupBy("ref", "cluster").applyInPandas(pick, "ref bigint, peak bigint, height bigint")


def peak_edges(counts: DataFrame, peaks: DataFrame, share: float = 0.9, reach: int = 100) -> DataFrame:
    """Start and end edge of each peak: where reads over it reach `share` of their mass from the left or the right.

    counts: ref, pos, len, n (len at most reach); a read lies over a peak from its start up to its last base.
    """
    last = F.col("pos") + F.col("len") - 1
    binned = counts.withColumn("bin", F.explode(F.array_distinct(F.array(F.floor(F.col("pos") / reach), F.floor(last / reach)))))
    over = binned.join(peaks.withColumn("bin", F.floor(F.col("peak") / reach)), ["ref", "bin"]).filter((F.col("pos") <= F.col("peak")) & (F.col("peak") <= last))

    def edge(at: Column, ascending: bool, name: str) -> DataFrame:
        sums = over.groupBy("ref", "peak", at.alias("at")).agg(F.sum("n").alias("n"))
        group = Window.partitionBy("ref", "peak")
        order = group.orderBy(F.col("at").asc() if ascending else F.col("at").desc())
        reached = sums.withColumn("sum", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(group))
        held = reached.filter(F.col("sum") >= F.greatest(F.lit(1), F.ceil(F.round(F.col("all") * F.lit(share), 9))))
        return held.groupBy("ref", "peak").agg((F.min if ascending else F.max)("at").alias(name), F.first("all").alias(f"{name}_mass"))

    return edge(F.col("pos"), True, "start_edge").join(edge(last, False, "end_edge"), ["ref", "peak"])


def running_depletion(peaks: DataFrame) -> DataFrame:
    """Peaks by falling height with the running share of all heights, dealt out by ranges of height."""
    order = [F.col("height").desc(), F.col("ref"), F.col("peak")]
    return ordered.running(ordered.ranged(peaks, [], order), [], order, {"depleted": ("sum", F.col("height"))}).drop(ordered.BLOCK)
