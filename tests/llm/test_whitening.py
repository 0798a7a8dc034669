from __future__ import annotations

import math

import numpy as np
import pytest

from gleaner.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def good(rows):
    return [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def exact(rows, weights="one", count=16):
    """(vec_id, component, n, deviation, whitened, explained) for vectors of one width, by plain integers and one decomposition."""
    own = good(rows)
    fit = [x for _, x in own] if weights == "count" else sorted({x for _, x in own})
    n, width = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(width)]
    moved = np.array([[n * x[d] - sums[d] for d in range(width)] for x in fit], dtype=object)
    whole = moved.T.dot(moved)
    covariance = np.array([[float(v) / n**3 for v in r] for r in whole])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    out = []
    for i, x in own:
        y = np.array([(n * x[d] - sums[d]) / n for d in range(width)])
        far = sum((n * x[d] - sums[d]) ** 2 for d in range(width))
        out += [(i, c + 1, n, far, float(y @ vectors[:, c]) / math.sqrt(values[c]), values[c] / np.trace(covariance)) for c in range(len(values))]
    return out


def same(got, want):
    """Equal up to the sign of each component."""
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], abs(r[4]))
    got, want = sorted([tuple(r) for r in got], key=key), sorted(want, key=key)
    signs: dict = {}
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and abs(a[5] - b[5]) < 1e-8 * b[5] and a[6] < 1e-8
        if abs(b[4]) > 1e-3:
            signs.setdefault(a[1], set()).add(round(a[4] / b[4], 6))
    assert all(s in ({1.0}, {-1.0}) for s in signs.values()), signs


@pytest.mark.parametrize("weights", ["one", "count"])
def test_against_integers(spark, weights):
    draw = np.random.default_rng(1)
    spread = draw.normal(size=(20, 20)) * np.linspace(3, 0.5, 20)
    rows = [(i, (draw.normal(size=20) @ spread + 5).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(None, rows[8][1]), (3, rows[9][1]), (3, rows[9][1])]
    odd = [(900, None), (901, [math.nan] * 20), (902, [None] + [1.0] * 19), (903, [math.inf] * 20), (904, [])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], SCHEMA + ", weight int, x string")
    got = whitening.whiten(docs, weights=weights)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    same(got.collect(), exact(rows, weights))


def test_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [tuple(r) for r in vectors.select("vec_id", "embedding").collect()]
    same(whitening.whiten(vectors).collect(), exact(rows))


def test_widths_are_fits_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(whitening, "LOT_NUMBERS", 10)
    draw = np.random.default_rng(2)
    rows = {w: [(100 * w + i, draw.normal(size=w).tolist()) for i in range(40)] for w in (2, 3, 5)}
    got = whitening.whiten(spark.createDataFrame(sum(rows.values(), []), SCHEMA)).collect()
    for w, own in rows.items():
        same([r for r in got if r["vec_id"] // 100 == w], exact(own))


def test_nothing_varies_and_nothing_given(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).count() == 0
    flat = [(i, [float(i), 1.0, -2.0 * i]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r["component"]: r["whitened"] is None for r in got} == {1: False, 2: True, 3: True} and all(r["identity_error"] < 1e-9 for r in got)


def test_deviation_beyond_a_long_is_null():
    centre = whitening.Centre(3, [0, 0])
    edge = math.isqrt((1 << 63) - 1)
    x = np.array([[edge // 3, 0], [edge // 3 + 1, 0], [5, -7]])
    assert centre.deviations(x) == [9 * (edge // 3) ** 2, None, 9 * (25 + 49)]
    odd = whitening.Centre(7, [3, -5])
    assert odd.deviations(np.array([[1, 2], [0, 0]])) == [(7 - 3) ** 2 + (14 + 5) ** 2, 9 + 25]


def test_huge_entries_count_as_the_largest(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], SCHEMA)).collect()
    assert len(got) == 6 and all(r["n"] == 3 for r in got)
