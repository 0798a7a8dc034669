from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import simhash
from helpers import DOCUMENTS, SMALL, corpus, lowered, prose, words


def printed(text, k=3):
    """Fingerprint in plain Python."""
    w = words(lowered(text))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, most):
    """Smallest position reachable, over all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= most:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


def exact(rows):
    prints = [printed(r[1]) for r in rows]
    own = components(prints, 3)
    out = []
    for r, p, c in zip(rows, prints, own):
        ids = [q[0] for q, d in zip(rows, own) if d == c and q[0] is not None]
        out.append((r[0], f"{p:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def answer(df):
    return sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()], key=repr)


def test_against_all_pairs(spark):
    rows = corpus() + [(800 + i, prose(900, 3000) + f" end{i} more{i}", "en", "near", 1) for i in range(30)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumn("mark", F.lit("own")).withColumn("print", F.lit(1)).withColumn("mask", F.lit(1))
    got = answer(simhash.groups(docs))
    assert got == exact(rows) and len({c for i, _, c in got if i and 800 <= i < 830}) < 30


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert answer(simhash.groups(docs)) == exact([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_hashes_are_those_of_spark(spark):
    texts = ["one two three", "École élan Ünder", "a", "x" * 100 + " y z"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert [v % 2**64 for v in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
def test_pieces_of_a_text_do_not_show(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    for text in ["", " ", "one", "One two", "one  two\tthree", "a b c d e f g h\n", prose(1, 200), "w" * 500 + " x", " \v lead and\x0ctail\r"]:
        assert simhash.fingerprint(text.encode()) == printed(text)


def balls(seed, centres, each, bits):
    draw = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = draw.getrandbits(64)
        out |= {c ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(bits + 1))) for _ in range(each)}
    return sorted(out)


def linked(spark, prints, most):
    signed = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    at = {p: i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(signed, most).collect()]
    assert all((a ^ b).bit_count() <= most and a != b for a, b in found)
    for a, b in found:
        x, y = root(at[a]), root(at[b])
        parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))], len(found)


@pytest.mark.parametrize("most", [1, 3])
@pytest.mark.parametrize("group, rows", [(4096, 1 << 15), (8, 16)])
def test_links_of_many_close_fingerprints(spark, monkeypatch, most, group, rows):
    """With small groups every level of the cutting is used."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "ROWS", rows)
    prints = balls(3, 6, 120, 5) + [0, 1, 2**64 - 1, 7, 15]
    prints = sorted(set(prints))
    got, found = linked(spark, prints, most)
    assert got == components(prints, most) and (group < 4096 or found < (most + 1) * len(prints))


def test_a_pair_is_found_wherever_its_bits_lie(spark):
    draw = random.Random(4)
    prints, pairs = [], []
    for _ in range(150):
        a = draw.getrandbits(64)
        b = a ^ sum(1 << x for x in draw.sample(range(64), 3))
        prints += [a, b]
        pairs.append((a, b))
    prints = sorted(set(prints))
    got, _ = linked(spark, prints, 3)
    place = {p: i for i, p in enumerate(prints)}
    assert all(got[place[a]] == got[place[b]] for a, b in pairs)


def test_no_pair_of_small_distance_is_discarded():
    draw = np.random.default_rng(6)
    prints = draw.integers(0, 2**64, 300, dtype=np.uint64)
    moved = prints ^ (np.uint64(1) << draw.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 300, dtype=np.uint64))
    pivots = simhash.references(32)
    assert np.abs(simhash.distances(prints, pivots) - simhash.distances(moved, pivots)).max() <= 2
    others = np.abs(simhash.distances(prints[1:], pivots) - simhash.distances(prints[:-1], pivots)).max(axis=1)
    assert (others > 3).all()


def test_empty(spark):
    assert simhash.groups(spark.createDataFrame([], DOCUMENTS)).count() == 0
