"""Block joins of questions and chunks, and the coarse index, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import blocks, coarse
from gleaner.operators import nearest as N
from gleaner.operators.upsert import broadcast_if_small

CHUNK = "collection string, id string, source string, document string, embedding array<float>"


def clustered(n, width=16, clusters=40, seed=3):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(clusters, width)) * 3
    return (centre[np.arange(n) % clusters] + draw.normal(size=(n, width))).astype(np.float32)


def exact(rows, vector, k):
    scored = [(round(float(((np.array(r[4], np.float64) - vector) ** 2).sum()), 9), r[1]) for r in rows if r[4] is not None and len(r[4]) == len(vector)]
    return [i for _, i in sorted(scored)[:k]]


@pytest.mark.parametrize("chunk_block, question_block", [(16_384, 1_024), (40, 3)])
def test_a_hot_source_in_blocks(spark, monkeypatch, chunk_block, question_block):
    """Most chunks and questions share one source; some have no source, some sources no chunks."""
    monkeypatch.setattr(blocks, "CHUNKS", chunk_block)
    monkeypatch.setattr(blocks, "QUESTIONS", question_block)
    vectors = clustered(600, 6)
    rows = [("ti_pdfs", f"i{i:04d}", "hot" if i % 3 else (None if i % 5 == 0 else f"s{i % 7}"), "t", v.tolist()) for i, v in enumerate(vectors)]
    rows += [("ti_pdfs", "bad", "hot", "t", [float("nan")] * 6), ("ti_pdfs", "short", "hot", "t", [0.0]), ("ti_pdfs", "none", "hot", "t", None)]
    asked = [(f"q{i}", "hot" if i % 4 else "s3", vectors[i].astype(float).tolist()) for i in range(0, 60)] + [("n", None, [0.0] * 6), ("w", "hot", [0.1]), ("z", "nowhere", [0.0] * 6), ("v", "hot", None)]
    chunks = spark.createDataFrame(rows, CHUNK).repartition(5)
    got = {}
    for r in N.nearest_in_source(chunks, spark.createDataFrame(asked, "qid string, source string, vector array<double>"), 4).orderBy("qid", "snippet_no").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    want = {q: exact([r for r in rows if r[2] == s], np.array(v), 4) for q, s, v in asked if v is not None and s is not None}
    assert got == {q: ids for q, ids in want.items() if ids} and got["w"] == ["short"]


def test_rows_that_leave_a_task_are_bounded(spark, monkeypatch):
    """Nothing but the best few of a question and block comes out, however many chunks share the key."""
    monkeypatch.setattr(blocks, "CHUNKS", 500)
    vectors = clustered(3000, 6)
    chunks = spark.createDataFrame([("c", f"i{i:05d}", "hot", "t", v.tolist()) for i, v in enumerate(vectors)], CHUNK)
    rows = chunks.select(F.col("source").alias("_key"), F.lit(None).cast("string").alias("_slot"), "collection", "id", "source", "embedding", F.lit(0).alias("_rank"))
    asked = spark.createDataFrame([(i, "hot", vectors[i].astype(float).tolist()) for i in range(20)], "qid long, _key string, vector array<double>")
    met = blocks.best_by_key(rows, asked, 3)
    assert met.count() == 20 * 3 * 6
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def recall(found, rows, asked, k):
    hits = sum(len(set(found.get(q, [])) & set(exact(rows, np.array(v), k))) for q, v in asked)
    return hits / (k * len(asked))


def answers(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["id"])
    return out


def test_recall_and_share_read_on_clustered_vectors(spark, tmp_path):
    vectors = clustered(8000)
    rows = [("ti_urls", f"i{i:05d}", "s", f"t{i}", v.tolist()) for i, v in enumerate(vectors)]
    index = coarse.CoarseIndex(spark, str(tmp_path / "x")).build(spark.createDataFrame(rows, CHUNK))
    asked = [(i, (vectors[i] + 0.1).astype(float).tolist()) for i in range(0, 8000, 200)]
    questions = spark.createDataFrame(asked, "qid long, vector array<double>")
    assert recall(answers(index.nearest(questions, 10)), rows, asked, 10) >= 0.9
    one = index.asked(questions.where("qid = 0"), coarse.PROBES)
    part = index.read_for(one)
    assert part.count() <= len(rows) / 4
    assert "PartitionFilters: [" in part._jdf.queryExecution().toString() and "centre" in part._jdf.queryExecution().toString().split("PartitionFilters: [")[1][:80]


def test_recall_curve_on_given_vectors(spark, tmp_path):
    """The given vectors have no clusters: recall grows with the share that is read, and is whole when all is read."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    rows = [("ti_urls", f"v{r['vec_id']:05d}", "s", "t", r["embedding"]) for r in vectors]
    index = coarse.CoarseIndex(spark, str(tmp_path / "x")).build(spark.createDataFrame(rows, CHUNK), count=32)
    asked = [(r["vec_id"], [float(x) + 0.01 for x in r["embedding"]]) for r in vectors[::100]]
    questions = spark.createDataFrame(asked, "qid long, vector array<double>")
    curve = [recall(answers(index.nearest(questions, 10, probes=p)), rows, asked, 10) for p in (2, 8, 24, 32)]
    assert curve == sorted(curve) and curve[-1] == 1.0 and curve[-2] >= 0.9


def test_odd_chunks_and_short_answers(spark, tmp_path):
    nan = float("nan")
    rows = [("ti_urls", f"i{i}", None if i == 3 else "s", "t", [float(i), 0.0]) for i in range(12)]
    rows += [("ti_urls", "n", "s", "t", [nan, 0.0]), ("ti_urls", "x", "s", "t", None), ("ti_urls", "e", "s", "t", []), ("ti_urls", "w1", "s", "t", [1.0, 0.0, 0.0]), ("ti_urls", "w2", "s", "t", [2.0, 0.0, 0.0])]
    index = coarse.CoarseIndex(spark, str(tmp_path / "x")).build(spark.createDataFrame(rows, CHUNK), count=4)
    assert index.chunks().count() == len(rows) and index.centres().shape == (4, 2)
    asked = [(1, [0.2, 0.0]), (2, [1.9, 0.0, 0.0]), (3, [nan, 0.0]), (4, None), (5, [11.0, 0.0])]
    got = answers(index.nearest(spark.createDataFrame(asked, "qid long, vector array<double>"), 3, probes=1))
    assert got[2] == ["w2", "w1"] and set(got) == {1, 2, 5} and len(got[1]) == len(got[5]) == 3
    whole = answers(index.nearest(spark.createDataFrame(asked, "qid long, vector array<double>"), 3, probes=4))
    assert whole[1] == ["i0", "i1", "i2"] and whole[5] == ["i11", "i10", "i9"]
    empty = coarse.CoarseIndex(spark, str(tmp_path / "y")).build(spark.createDataFrame([], CHUNK))
    assert empty.nearest(spark.createDataFrame(asked, "qid long, vector array<double>"), 3).count() == 0


def test_equal_vectors_and_few_rows():
    same = np.ones((50, 3))
    assert coarse.k_means(same, 8).tolist() == [[1.0, 1.0, 1.0]]
    sample = np.r_[np.zeros((30, 2)), np.full((30, 2), 5.0), np.full((1, 2), 9.0)]
    assert sorted(map(tuple, coarse.k_means(sample, 3))) == [(0.0, 0.0), (5.0, 5.0), (9.0, 9.0)]


def test_broadcast_is_bounded_in_bytes(spark):
    few = spark.createDataFrame([(i, [0.0] * 1000, "x" * 500) for i in range(50)], "a long, v array<double>, t string")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(broadcast_if_small(few)) and not hinted(broadcast_if_small(few, max_bytes=100_000)) and not hinted(broadcast_if_small(few, max_rows=49))
    assert hinted(broadcast_if_small(few.limit(0)))
