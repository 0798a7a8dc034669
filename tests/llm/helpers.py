"""Brute-force versions and small tables for the tests of this folder."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text: str | None, k: int) -> frozenset:
    w = words(lowered(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_components(rows: list[tuple], k: int, percent: int) -> list[tuple]:
    """(doc_id, n, component) per row of (doc_id, text), over all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    holders: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for members in holders.values():
        for x, i in enumerate(members):
            for j in members[x + 1 :]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        parent[root(i)] = root(j)
    members: dict = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(i)
    out = []
    for group in members.values():
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            out.append((rows[i][0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(3000)}" for _ in range(n))


def edited(text: str, seed: int, every: int) -> str:
    """``text`` with every ``every``-th word replaced."""
    w = text.split(" ")
    for i in range(seed % every, len(w), every):
        w[i] = f"e{seed}x{i}"
    return " ".join(w)


def corpus() -> list[tuple]:
    """Rows with nulls, blanks, long texts, ties, copies, near copies and shared passages."""
    base = [prose(s, 120) for s in range(8)]
    passage = prose(99, 90)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \t\n", None, "a", 3), (4, "one two", "en", "b", 7), (5, "One TWO", "en", "b", 7),
        (6, "one two three four five six", "en", "a", 26), (7, base[0], "en", "a", 1), (8, base[0].upper(), "en", "a", 1),
        (9, base[0] + " tail", "en", None, 1), (10, base[1], "fr", "b", 1), (11, edited(base[1], 3, 60), "fr", "b", 1),
        (12, edited(base[1], 7, 12), "fr", "b", 1), (13, "École " + base[2], "fr", "a", 1), (14, "école " + base[2], "fr", "a", 1),
        (15, base[3], "de", "c", 1), (15, base[3], "de", "c", 1), (16, "x" * 3000, "de", "c", 1), (17, prose(50, 4000), "de", "c", 1),
        (18, prose(50, 4000) + " end", "de", "c", 1), (None, base[4], "de", "c", 1), (19, base[4], "de", "c", 1),
    ]
    rows += [(100 + i, edited(base[5], i, 100), "en", "hot", 1) for i in range(40)]
    rows += [(200 + i, passage + " " + prose(500 + i, 30), "en", "hot", 1) for i in range(40)]
    rows += [(300 + i, base[6], "en", "hot", 1) for i in range(60)]
    rows += [(400 + i, prose(700 + i, 20 + i), "en", f"s{i % 5}", 1) for i in range(40)]
    return rows
