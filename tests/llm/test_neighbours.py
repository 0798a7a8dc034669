from __future__ import annotations

import math

import numpy as np

from gleaner.llm import neighbours


def exact(rows, every, k):
    """Each query's nearest rows over all pairs."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            best = {}
            for i, b in good:
                if i != q and len(a) == len(b):
                    d = float(np.sqrt(((a - b) ** 2).sum()))
                    best[i] = min(d, best.get(i, math.inf))
            old = out.get(q, {})
            out[q] = {i: min(best.get(i, math.inf), old.get(i, math.inf)) for i in {*best, *old}}
    return {q: sorted((d, i) for i, d in b.items())[:k] for q, b in out.items() if b}


def answer(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        own = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["score"], r["vec_id"]))
    return out


def test_odd_rows_are_exact_when_all_is_searched(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(20)] + [(500, None), (501, []), (502, [0.0] * 8), (503, [math.nan] + [1.0] * 7), (504, [None] + [1.0] * 7)]
    rows += [(505, [math.inf] * 8), (None, [1.0] * 8), (600, [1.0, 2.0]), (601, [1.0, 3.0]), rows[7], (100, draw.normal(size=8).tolist()), (-100, rows[3][1])]
    got = answer(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), trees=4, share=9.0))
    want = exact(rows, 100, 10)
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]] and np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-12)


def test_one_vector_holds_a_third(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=16).astype(np.float32).tolist() if i % 3 else [1.0] * 16) for i in range(1500)]
    got = answer(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), least_rows=10))
    want = exact(rows, 100, 10)
    assert got[0] == want[0] and got[300] == want[300]


def test_copies_do_not_use_up_what_other_queries_visit(spark):
    draw = np.random.default_rng(3)
    values = draw.normal(size=(12_000, 64)).astype(np.float32)
    values[::3] = values[0]
    asked = [q for q in range(0, 12_000, 100) if q % 3]
    got = answer(neighbours.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<float>")))
    assert set(got) == set(range(0, 12_000, 100))
    hits = 0
    for q in asked:
        distance = np.sqrt(((values.astype(np.float64) - values[q].astype(np.float64)) ** 2).sum(axis=1))
        distance[q] = np.inf
        best = np.lexsort((np.arange(len(distance)), distance))[:10]
        hits += len({i for _, i in got[q]} & set(best.tolist()))
    assert hits / (10 * len(asked)) >= 0.9
    assert all([i for _, i in got[q]] == [i for i in range(0, 36, 3) if i != q][:10] for q in got if q % 3 == 0)


def test_an_id_with_many_near_vectors_takes_one_place(spark):
    draw = np.random.default_rng(4)
    rows = [(0, [1.0] * 8)] + [(7, (1 + draw.normal(size=8) / 1000).tolist()) for _ in range(40)] + [(i, draw.normal(size=8).tolist()) for i in range(101, 161)]
    got = answer(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), trees=4, share=9.0))
    want = exact(rows, 100, 10)
    assert [i for _, i in got[0]] == [i for _, i in want[0]] and len(got[0]) == 10
    assert np.allclose([d for d, _ in got[0]], [d for d, _ in want[0]], rtol=1e-12)


def test_recall_on_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [tuple(r) for r in vectors.select("vec_id", "embedding").collect()]
    got, want = answer(neighbours.search(vectors)), exact(rows, 100, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9


def test_fewer_rows_than_asked_and_none(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (200, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert answer(neighbours.search(vectors)) == exact([tuple(r) for r in vectors.collect()], 100, 10)
    assert neighbours.search(vectors.limit(0)).count() == 0
