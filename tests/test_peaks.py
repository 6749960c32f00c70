"""The fragment list over all greedy peaks against brute force."""

import math

import __spark_entry__ as entry
from translatome.plans import views

SF = "/root/testdata/sf0.01"


def test_fragments_of_all_peaks(spark):
    every = views.reads(spark, SF).select("ref", "pos", "len", "strand").collect()
    reads = [r for r in every if r.strand == "+" and r.pos >= 0]
    least, want = max(1, math.ceil(0.0001 * len(every))), []
    for ref in {r.ref for r in reads}:
        own = [r for r in reads if r.ref == ref]
        cover = {}
        for r in own:
            for at in range(r.pos, r.pos + r.len):
                cover[at] = cover.get(at, 0) + 1
        # where cover changes or a read ends
        known = {at for r in own for at in (r.pos, r.pos + r.len - 1, r.pos + r.len) if at < 60000}
        taken = []
        for height, at in sorted((-cover.get(at, 0), at) for at in known):
            if -height > least and all(abs(at - t) > 25 for t in taken):
                taken.append(at)
                over = [r for r in own if r.pos <= at < r.pos + r.len]
                need = max(1, math.ceil(round(0.9 * len(over), 9)))
                start = sorted(r.pos for r in over)[need - 1]
                end = sorted((r.pos + r.len - 1 for r in over), reverse=True)[need - 1]
                want.append((height, ref, at, start, len(over), end, len(over)))
    total, rows = 0, []
    for height, ref, at, *edges in sorted(want):
        total -= height
        rows.append((ref, at, -height, total, *edges))
    names = ("ref", "peak", "height", "depleted", "start_edge", "start_edge_mass", "end_edge", "end_edge_mass")
    got = entry.queries()["peak_fragments"](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    assert len(rows) > 2 * len({r[0] for r in rows})
