"""Duplicates of a stream against brute force, and batches that are run again."""

import random

import pytest

from translatome.streaming import duplicates

SCHEMA = "read_ord bigint, ref bigint, pos bigint, strand string, tag string"


def batches(seed):
    draw = random.Random(seed)
    out, at = [], 0
    for b in range(5):
        rows = []
        for _ in range(60):
            ref = draw.choice([1, 1, 1, 2, None])
            pos = draw.choice([b * 50 + draw.randrange(60), draw.randrange(250), None]) if draw.random() < 0.5 else b * 50 + draw.randrange(8)
            rows.append((at, ref, pos, draw.choice("+-"), draw.choice(["a", "b", "", None])))
            at += 1
        out.append(rows)
    return out


def plain(parts, reach):
    furthest, seen, out = {}, set(), {}
    for rows in parts:
        before = dict(furthest)
        for read, ref, pos, strand, tag in sorted(rows):
            key = (ref, pos, strand, tag)
            if ref is not None and pos is not None and ref in before and pos < before[ref] - reach:
                out[read] = "late"
            elif not tag or None in key:
                out[read] = "kept"
            else:
                out[read] = "duplicate" if key in seen else "kept"
                seen.add(key)
        for _, ref, pos, _, _ in rows:
            if ref is not None and pos is not None:
                furthest[ref] = max(pos, furthest.get(ref, pos))
    return out, furthest, seen


@pytest.mark.parametrize(("seed", "reach"), [(1, 30), (2, 0), (3, 1000)])
def test_suppressing(spark, tmp_path, seed, reach):
    parts, folder = batches(seed), f"file://{tmp_path}/d"
    sink = duplicates.suppressing(folder, reach)
    for k, rows in enumerate(parts):
        df = spark.createDataFrame(rows, SCHEMA)
        sink(df, k)
        if k in (0, 2):  # as after a failure
            sink(df, k)
    want, furthest, seen = plain(parts, reach)
    got = duplicates.fates(spark, folder, SCHEMA).collect()
    assert {r.read_ord: r.fate for r in got} == want and len(got) == 300
    assert {r.batch for r in got} == set(range(5)) and ("late" in want.values()) == (reach < 1000) and ("duplicate" in want.values()) == (reach > 0)
    held = {k for k in seen if k[1] >= furthest[k[0]] - reach}
    assert duplicates.state_size(spark, folder, 4) == len(held)
    assert reach == 1000 or len(held) < len(seen) / 2
