"""A small corpus with the awkward cases, and brute-force versions of the operators' contracts."""

from __future__ import annotations

import collections
import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BIG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def words(text):
    return WORD.findall(text or "")


def awkward():
    """Nulls, empty, blank and very long texts, repeated rows, ties."""
    return [
        (1, "hello world foo bar baz qux", "en", "a", 1),
        (1, "hello world foo bar baz qux", "en", "a", 1),
        (2, None, None, None, 2),
        (3, "", "en", None, 3),
        (4, BIG, "en", "b", 4),
        (None, "no id text here for all of us", "en", "a", 5),
        (6, " \n\t ", "fr", "b", 6),
        (7, "Hello world foo bar baz qux", "de", "c", None),
        (8, BIG + " more", "en", "b", 8),
        (9, "hello  world foo\nbar baz qux", None, "c", 9),
    ]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(n=120, seed=3):
    """Random texts with exact copies, near copies, shared passages and repeats inside a text."""
    draw = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "eo", "ui", "ané", "or")]
    text = lambda k: " ".join(draw.choice(vocabulary) for _ in range(k))
    passage, rows = text(60), []
    for i in range(n):
        kind = i % 6
        t = text(draw.randint(1, 160))
        if kind == 1 and rows:
            t = rows[draw.randrange(len(rows))][1]
        elif kind == 2 and rows:
            w = (rows[draw.randrange(len(rows))][1]).split()
            for _ in range(draw.randint(0, 2)):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
            t = " ".join(w)
        elif kind == 3:
            t = f"{t} {passage} {text(20)}"
        elif kind == 4:
            half = text(40)
            t = f"{half} {text(3)}\n{half}"
        rows.append((i, t, draw.choice(["en", "fr"]), f"src{draw.randint(0, 4)}", len(t)))
    return rows


def without_repeats(rows, window=35):
    """doc_id, n_words, n_removed, kept_sha256 of op1."""
    split = [(r[0], (r[1] or "").encode().split()) for r in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = []
    for doc_id, w in split:
        covered = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                covered[i : i + window] = [True] * window
        kept = [x for x, c in zip(w, covered, strict=True) if not c]
        out.append((doc_id, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def components(rows, percent=80):
    """doc_id -> (n_shingles, component_id)."""
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of op10."""
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = [False] * len(w)
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered[i : i + 3] = [True] * 3
    lines, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dups, sum(covered)
