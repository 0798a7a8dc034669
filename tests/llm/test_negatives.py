from __future__ import annotations

import math

import numpy as np
import pytest

from gleaner.llm import negatives
from gleaner.llm.negatives import Block, negatives_in, positives_in

SCHEMA = "vec_id long, embedding array<double>, label int"


def exact(rows, every=50, positives=5, count=3, low=50, high=95):
    """All anchors against all rows in plain Python."""
    good = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        good[i, label, tuple(math.floor(256 * c) for c in v)] = True
    out = []
    for a in good:
        if a[0] % every:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], b[2])), b) for b in good if b != a and len(b[2]) == len(a[2])]
        best = sorted([(-s, b[0]) for s, b in scored if b[1] == a[1]])[:positives]
        for p, i in best:
            inside = sorted([(-s, b[0]) for s, b in scored if b[1] != a[1] and low * -p <= 100 * s <= high * -p])[:count]
            out += [(a[0], i, r + 1, n, -p, -s) for r, (s, n) in enumerate(inside)]
    return sorted(out)


def answer(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert dict(df.dtypes)["rank"] == "int"
    return sorted(tuple(r) for r in df.collect())


def table(n, width, seed=1, labels=4):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(labels, width))
    return [(i, (centre[i % labels] * 0.6 + draw.normal(size=width) * 0.5).tolist(), int(i % labels)) for i in range(n)]


@pytest.mark.parametrize("block, lot", [(4096, 4096), (37, 3)])
def test_against_all_rows(spark, monkeypatch, block, lot):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "LOT_ROWS", lot)
    rows = table(700, 12)
    got = answer(negatives.mine(spark.createDataFrame(rows, SCHEMA)))
    assert got == exact(rows) and len(got) > 100


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 50)
    rows = table(300, 6)
    rows += [(400, None, 1), (401, [], 1), (402, [math.nan] * 6, 1), (403, [None] + [1.0] * 5, 1), (404, [math.inf] * 6, 1), (None, [1.0] * 6, 1), (405, [1.0] * 6, None)]
    rows += [rows[50], rows[50], (50, [0.5] * 6, 2), (550, [0.0] * 6, 1), (600, [-1.0] * 6, 9), (651, [0.25, 0.5], 3), (650, [0.25, 0.5], 3), (652, [0.2, 0.45], 4), (-50, rows[3][1], -3)]
    docs = spark.createDataFrame([(*r, "own", 1, 2, 3) for r in rows], SCHEMA + ", class string, lot int, positive int, x int")
    assert answer(negatives.mine(docs)) == exact(rows)


def test_copies_of_one_vector_and_ties(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 64)
    draw = np.random.default_rng(5)
    rows = [(i, [0.5, 0.5, 0.25, 0.0] if i % 3 == 0 else (draw.integers(-2, 3, 4) / 4).tolist(), int(i % 2)) for i in range(900)]
    assert answer(negatives.mine(spark.createDataFrame(rows, SCHEMA))) == exact(rows)


def test_empty_and_huge(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert answer(negatives.mine(empty)) == []
    rows = [(0, [1e300, 1e300], 1), (1, [1e299, 1.0], 1), (2, [1e298, 1e9], 2)]
    most = math.floor(math.sqrt(2.0**61 / 2))
    got = answer(negatives.mine(spark.createDataFrame(rows, SCHEMA)))
    assert got == [(0, 2, 1, 1, 2 * most**2, most**2 + 256 * most)]  # the label of 0 becomes 2


def test_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [tuple(r) for r in vectors.select("vec_id", "embedding", "label").collect()]
    got = answer(negatives.mine(vectors))
    assert got == exact(rows) and got


def test_reading_stops_before_the_end():
    """A threshold strictly below the last wanted scores ends the reading; clustered rows are not all scored."""
    draw = np.random.default_rng(2)
    x = np.r_[draw.integers(90, 110, (200, 4)), draw.integers(-5, 6, (3800, 4))].astype(np.int64)
    ids, labels = np.arange(len(x)) * 3, np.r_[np.arange(200) % 2, np.zeros(3800, int)]
    block, scored = Block(ids, labels, x), []
    plain = block.scores
    block.scores = lambda rows, anchor: scored.append(len(rows)) or plain(rows, anchor)
    anchor = np.array([100, 100, 100, 100])
    got = positives_in(block, anchor, 0, 6)
    every = sorted([(-int(s), int(i)) for s, i, own in zip(x @ anchor, ids, labels) if own == 0])[:6]
    assert got == [(i, -s) for s, i in every] and sum(scored) < 1000
    scored.clear()
    p = got[0][1]
    inside = sorted([(-int(s), int(i)) for s, i, own in zip(x @ anchor, ids, labels) if own == 1 and 50 * p <= 100 * s <= 95 * p])[:3]
    assert negatives_in(block, anchor, 0, [p], 3, 50, 95) == [(p, i, -s) for s, i in inside] and sum(scored) < 1000
