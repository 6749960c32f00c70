"""Gene quantities across samples, group comparisons and confusion tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from translatome.functions import ordered
from translatome.functions.statistics import mid_ranks, normal_tail, quantiles_type8, ratio, values_at_ranks


def quant_matrix(quants: DataFrame, samples: list[str]) -> DataFrame:
    """gene and one count column for each sample; a gene without a row in some sample is an error."""
    wide = quants.groupBy("gene").pivot("sample", samples).agg(F.sum("count"))
    ok = F.lit(True)
    for s in samples:
        ok &= F.col(f"`{s}`").isNotNull()
    return wide.withColumn("_ok", F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("gene lacks a sample: "), F.col("gene").cast("string"))).cast("boolean"))).filter("_ok").drop("_ok")


def upper_quartile_norm(quants: DataFrame) -> DataFrame:
    """sample, q3, norm, factor: third quartiles over genes with any count, scaled so that they add up to all counts."""
    some = quants.groupBy("gene").agg(F.max("count").alias("most")).filter("most > 0").select("gene")
    kept = quants.join(some, "gene", "left_semi")
    q3 = quantiles_type8(kept, ["sample"], "count", {"q3": 0.75})
    scale = kept_total(quants).crossJoin(q3.agg(F.sum("q3").alias("sum_q3")))
    norm = F.col("q3") * F.col("total") / F.col("sum_q3")
    return q3.crossJoin(F.broadcast(scale)).select("sample", "q3", norm.alias("norm"), (F.lit(1e6) / norm).alias("factor"))


def kept_total(quants: DataFrame) -> DataFrame:
    return quants.agg(F.sum("count").alias("total"))


def pause_statistics(profile: DataFrame, least_median: float = 3 - 1e-6, least_pause: float = 30 - 1e-6, trim: tuple[int, int] = (15, 5)) -> DataFrame:
    """gene, class, median, iqr, pauses of dense codon profiles (gene, idx, n, len).

    Statistics are over the codons without the outer ones; classes: short (too few codons), zeros (more than half are 0), low (median
    below least_median), spread (interquartile range above 3 medians), else ok with the number of pauses.
    """
    inner = profile.filter((F.col("idx") >= trim[0]) & (F.col("idx") < F.col("len") - trim[1]))
    zeros = inner.groupBy("gene").agg(F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("zeros"), F.count(F.lit(1)).alias("size"))
    q = quantiles_type8(inner, ["gene"], "n", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    genes = profile.groupBy("gene").agg(F.max("len").alias("len"))
    stats = genes.join(zeros.join(q, "gene"), "gene", "left").withColumn("iqr", F.col("q3") - F.col("q1"))
    pauses = pause_rows(profile, stats, least_pause).groupBy("gene").agg(F.count(F.lit(1)).alias("pauses"))
    kind = (
        F.when(F.col("size").isNull(), "short")
        .when(F.col("zeros") * 2 > F.col("size"), "zeros")
        .when(F.col("median") < least_median, "low")
        .when(F.col("iqr") > 3 * F.col("median"), "spread")
        .otherwise("ok")
    )
    shown = lambda c, kinds: F.when(F.col("class").isin(*kinds), F.col(c)).alias(c)
    return stats.join(pauses, "gene", "left").withColumn("class", kind).select(
        "gene", "class", shown("median", ("low", "spread", "ok")), shown("iqr", ("spread", "ok")),
        F.when(F.col("class") == "ok", F.coalesce("pauses", F.lit(0))).alias("pauses"),
    )


def pause_rows(profile: DataFrame, stats: DataFrame, least_pause: float = 30 - 1e-6) -> DataFrame:
    """Codons with at least least_pause medians, off the ends: gene, idx, to_stop, n, over_median."""
    stop = F.col("len") - 1
    high = (F.col("idx") >= 5) & (F.col("idx") < stop - 1) & (F.col("n") >= F.lit(least_pause) * F.col("median"))
    return profile.join(stats.select("gene", "median"), "gene").filter(high).select(
        "gene", "idx", (stop - F.col("idx")).alias("to_stop"), "n", ratio(F.col("n"), F.col("median")).alias("over_median")
    )


def rank_sums(data: DataFrame, sets: DataFrame, least: int = 1) -> DataFrame:
    """set_name, n_in, n_out, u_in, u_out for each set of keys (sets: set_name, key) against all data (key, value).

    Mid-ranks are taken once over all data, so no set is crossed with the data: U follows from the ranks of its members.
    """
    data = data.filter("value IS NOT NULL")
    ranks = mid_ranks(data, [], "value").select("value", "rank")
    members = sets.dropDuplicates(["set_name", "key"]).join(data, "key").join(ranks, "value")
    n_in, sums = F.count(F.lit(1)).alias("n_in"), F.sum("rank").alias("r_in")
    total = data.agg(F.count(F.lit(1)).alias("n_all"))
    counted = members.groupBy("set_name").agg(n_in, sums).crossJoin(F.broadcast(total)).withColumn("n_out", F.col("n_all") - F.col("n_in"))
    u_in = F.col("r_in") - F.col("n_in") * (F.col("n_in") + 1) / 2
    return counted.withColumn("u_in", u_in).withColumn("u_out", F.col("n_in") * F.col("n_out") - F.col("u_in")).filter(
        F.least("n_in", "n_out") >= least
    ).select("set_name", "n_in", "n_out", "u_in", "u_out")


def subset_medians(data: DataFrame, sets: DataFrame) -> DataFrame:
    """set_name, median_in, median_out and their difference.

    All data are ranked once. The k-th value outside of a set has, among all data, the rank k plus the set's own members up to it,
    which are those that fewer than k values outside of the set are below; so a set only ever looks at its own members.
    """
    data = data.filter("value IS NOT NULL")
    ranked = mid_ranks(data, [], "value").select("value", "ties", "upto")
    own = sets.dropDuplicates(["set_name", "key"]).join(data, "key").groupBy("set_name", "value").agg(F.count(F.lit(1)).alias("c"))
    own = ordered.running(ordered.ranged(own, ["set_name"], ["value"]), ["set_name"], ["value"], {"upto_in": ("sum", F.col("c"))})
    sizes = own.groupBy("set_name").agg(F.sum("c").alias("n_in")).withColumn("n_out", data.count() - F.col("n_in")).filter("n_out > 0")
    rows = own.join(ranked, "value").join(sizes, "set_name")
    outside_below = (F.col("upto") - F.col("ties")) - (F.col("upto_in") - F.col("c"))
    middle = lambda n: [F.floor((n + k) / 2) for k in (1, 2)]
    at_in = [F.max(F.when((F.col("upto_in") - F.col("c") < k) & (k <= F.col("upto_in")), F.col("value"))) for k in middle(F.col("n_in"))]
    members = [F.sum(F.when(outside_below < k, F.col("c")).otherwise(0)) for k in middle(F.col("n_out"))]
    found = rows.groupBy("set_name", "n_out").agg(((at_in[0] + at_in[1]) / 2).alias("median_in"), *(m.alias(f"m{i}") for i, m in enumerate(members)))
    ranks = F.array(*(k + F.col(f"m{i}") for i, k in enumerate(middle(F.col("n_out")))))
    outside = values_at_ranks(ranked, found.select("set_name", F.explode(ranks).alias("rank")), "value").groupBy("set_name").agg(F.avg("value").alias("median_out"))
    return found.join(outside, "set_name").select("set_name", "median_in", "median_out", (F.col("median_in") - F.col("median_out")).alias("difference"))


#: Up to this many values in all, significance comes from the exact distribution (a table of some n^3 rows).
EXACT = 40


def two_tailed(n_in: Column, n_out: Column, u: Column, tied: Column | float = 0.0) -> Column:
    """Two-tailed probability of U by the normal approximation; `tied` is the sum of t^3 - t over groups of t equal values."""
    n = n_in + n_out
    spread = F.sqrt(n_in * n_out / 12 * (n + 1 - (tied if isinstance(tied, Column) else F.lit(tied)) / (n * (n - 1))))
    return F.when(spread > 0, F.least(F.lit(1.0), 2 * normal_tail(F.abs(u - n_in * n_out / 2) / spread))).otherwise(1.0)


def rank_sum_distribution(ties: list[int], n_in: int) -> dict[int, int]:
    """Of all choices of n_in values, how many have each 2U, given the sizes of the groups of equal values from the least on.

    Group by group: U counts the pairs of a chosen value above one that isn't, equal ones as a half.
    """
    from math import comb

    ways = {(0, 0): 1}  # chosen so far, 2U so far
    seen = 0
    for t in ties:
        new: dict[tuple[int, int], int] = {}
        for (chosen, u), w in ways.items():
            for k in range(max(0, n_in - chosen - (sum(ties) - seen - t)), min(t, n_in - chosen) + 1):
                key = chosen + k, u + k * (2 * (seen - chosen) + t - k)
                new[key] = new.get(key, 0) + w * comb(t, k)
        ways, seen = new, seen + t
    return {u: w for (_, u), w in ways.items()}


def significance(stats: DataFrame, data: DataFrame) -> DataFrame:
    """stats (set_name, n_in, n_out, u_in, ...) of rank_sums over data with pval, two-tailed.

    Exact up to EXACT values in all, whether they are tied or not: the probability, over all choices of as many members, of a U at least as far
    from its mean. Beyond, the normal approximation with the variance that ties leave.
    """
    groups = data.filter("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).cast("double").alias("t"))
    size, tied = groups.agg(F.coalesce(F.sum("t"), F.lit(0.0)), F.coalesce(F.sum(F.col("t") ** 3 - F.col("t")), F.lit(0.0))).first()
    if size > EXACT:
        return stats.withColumn("pval", two_tailed(F.col("n_in").cast("double"), F.col("n_out").cast("double"), F.col("u_in"), tied))
    ties = [int(r.t) for r in groups.orderBy("value").collect()]  # EXACT at most
    rows = []
    for n_in in range(int(size) + 1):
        ways, mean = rank_sum_distribution(ties, n_in), n_in * (int(size) - n_in)  # of 2U
        total = sum(ways.values())
        for u in ways:
            rows.append((n_in, u, sum(w for v, w in ways.items() if abs(v - mean) >= abs(u - mean)) / total))
    table = data.sparkSession.createDataFrame(rows, "n_in bigint, twice bigint, pval double")
    twice = F.round(2 * F.col("u_in")).cast("bigint")
    return stats.withColumn("twice", twice).join(F.broadcast(table), ["n_in", "twice"]).drop("twice").select(*stats.columns, "pval")


def fdr_scan(stats: DataFrame, p_max: float = 0.1, p_min: float = 1e-10, step: float = 2**0.5, most: int = 50) -> DataFrame:
    """set_name, p, q: the least cutoffs p_max, p_max / step, ... at which a set is significant, with the rate of false discoveries.

    stats: set_name, n_in, n_out, u_in, or pval of `significance`; without it, the normal approximation without ties. Cutoffs end below p_min, at the first one without any significant set, or after `most`.
    """
    grid = []
    p = p_max
    while p >= p_min and len(grid) < most:
        grid.append(p)
        p /= step
    tested = stats if "pval" in stats.columns else stats.withColumn("pval", two_tailed(F.col("n_in"), F.col("n_out"), F.col("u_in")))
    trials = tested.select(F.explode(F.array(*[F.lit(x) for x in grid])).alias("cut"), "pval").groupBy("cut").agg(
        F.count(F.lit(1)).alias("n_all"), F.sum(F.when(F.col("pval") <= F.col("cut"), 1).otherwise(0)).alias("n_sig")
    )
    # significance only shrinks with the cutoff, so cutoffs with significant sets are those before the first without
    good = trials.filter("n_sig > 0").withColumn("fdr", F.col("cut") * F.col("n_all") / F.col("n_sig"))
    hits = tested.select("set_name", "pval").crossJoin(F.broadcast(good)).filter("pval <= cut")
    least = hits.groupBy("set_name").agg(F.min("cut").alias("p"), F.min("fdr").alias("q"))
    return stats.select("set_name").join(least, "set_name", "left").select(
        "set_name", F.least(F.coalesce("p", F.lit(1.0)), F.lit(1.0)).alias("p"), F.least(F.coalesce("q", F.lit(1.0)), F.lit(1.0)).alias("q")
    )


def confusion(rows: DataFrame, actual: Column, called: Column) -> DataFrame:
    """bucket (tp, fp, tn, fn) and n."""
    bucket = F.when(actual & called, "tp").when(called, "fp").when(actual, "fn").otherwise("tn")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def sensitivity_specificity(buckets: DataFrame) -> DataFrame:
    of = lambda b: F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("n"))), F.lit(0)).alias(b)
    return buckets.agg(of("tp"), of("fp"), of("tn"), of("fn")).select(
        "tp", "fp", "tn", "fn",
        ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"),
    )
