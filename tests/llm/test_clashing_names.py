"""Stages keep columns whose names an operator might use itself."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleaner.llm import exact, minhash, mixing, quality
from helpers import prose

NAMES = ["_own", "_id", "_mark", "_given", "_sum", "_rows", "_turn", "_copy", "row", "id", "own", "mark", "all", "rows", "turn", "times", "copy", "given", "Given_", "keep_id", "a.b", "c`d"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(i % 12, 30 + i % 12) + (" tail" if i % 5 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [rows[3], rows[3], (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n, name in enumerate(NAMES):
        frame = frame.withColumn(name, F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return frame


def whole(df):
    """Every row has the values it came with."""
    own = df.collect()
    for r in own:
        told = "none" if r["doc_id"] is None else str(r["doc_id"])
        assert [r[name] for name in NAMES] == [f"{n}:{told}" for n in range(len(NAMES))]
    return sorted(((r["doc_id"] is None, r["doc_id"], r["text"]) for r in own), key=repr)


@pytest.mark.parametrize("stage", [exact.drop_copies, minhash.drop_near, mixing.apply_mix, "quality"])
def test_names_do_not_clash(spark, docs, stage):
    plain = docs.drop(*NAMES)
    if stage == "quality":
        labels = spark.createDataFrame([(i, int(i % 12 > 3), 0) for i in range(40)], "doc_id long, quality int, toxic int")
        stage = lambda d: quality.keep_good(d, labels)
    got = stage(docs)
    assert got.columns == docs.columns and [t for _, t in got.dtypes] == [t for _, t in docs.dtypes]
    want = sorted(((r["doc_id"] is None, r["doc_id"], r["text"]) for r in stage(plain).collect()), key=repr)
    assert whole(got) == want


def test_one_text_of_an_id_trains(spark):
    texts = spark.createDataFrame([(i, prose(i + 100 * k, 40), 1) for i in range(60) for k in range(3)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    models = [quality.train(d, labels) for d in (texts, texts.orderBy(F.desc("text")).coalesce(1))]
    assert (models[0]["v"] == models[1]["v"]).all() and (models[0]["w"] == models[1]["w"]).all()
