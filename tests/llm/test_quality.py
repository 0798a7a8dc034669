from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.llm import quality
from helpers import DOCUMENTS, SMALL, corpus


def test_identity_equals_all_pairs():
    model = quality.fit([])
    draw = np.random.default_rng(3)
    model["w"], model["v"], model["w0"] = (draw.normal(size=model[k].shape).astype(np.float32) for k in ("w", "v", "w0"))
    texts, given = pa.array(["a b c a", "", "Éa <x>\nq"]), pa.array([7.0, None, 3.0])
    places, starts, table = quality.features(texts, given)
    index, value, begin = quality.sparse(places, starts, table, model["centre"], model["scale"])
    got, _ = quality.raw_score(model, index, value, begin)
    for i, (a, b) in enumerate(zip(begin, [*begin[1:], len(index)])):
        x, at = value[a:b].astype(np.float64), index[a:b]
        pairs = sum(float(model["v"][at[p]] @ model["v"][at[q]]) * x[p] * x[q] for p in range(len(x)) for q in range(p + 1, len(x)))
        want = model["w0"] + float(model["w"][at] @ x) + pairs
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want))


def test_held_out_rows_are_told_apart(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, labels)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    truth = [(rows[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert np.mean([p == q for p, q in truth]) >= 0.97


def test_held_out_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(map(tuple, quality.score(docs, x).drop("mark").collect())) for x in (labels, turned))
    assert one == two


def test_odd_rows(spark):
    docs = spark.createDataFrame(corpus(), DOCUMENTS).withColumn("score", F.lit("own"))
    labels = spark.createDataFrame([(7, 1, 0), (10, 0, 0), (10, 1, 0), (12, None, 0), (None, 1, 0), (400, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).drop("mark")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(corpus())
    assert quality.score(docs, labels.limit(0)).filter("score = 0.5").count() == len(corpus())
    assert quality.score(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == len(corpus())
