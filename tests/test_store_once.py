"""A batch is written and exchanged once on its way into the chunk table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleaner import schemas as S
from gleaner.operators import upsert
from gleaner.plans import chunking, ingest


def _images(spark, n, text="text"):
    number = F.col("id").cast("string")
    return spark.range(n).select(
        F.concat(F.lit("/s/"), number, F.lit(".png")).alias("source"), F.concat(number, F.lit(".png")).alias("file"), F.concat(F.lit(f"{text} "), number).alias("text")
    )


def test_single_ids_are_neither_aggregated_nor_staged_twice(spark, tmp_path, monkeypatch):
    staged = []
    monkeypatch.setattr(upsert, "stage", lambda df, label, plain=upsert.stage: (staged.append(label), plain(df, label))[1])
    monkeypatch.setattr(upsert, "last_write", lambda *_: pytest.fail("no id repeats"))
    store = upsert.ChunkTable(spark, str(tmp_path / "t"), buckets=2)
    report = ingest.store_ocr(store, _images(spark, 50)).collect()
    assert {r["status"] for r in report} == {S.STATUS_NEW} and sum(r["chunks"] for r in report) == store.read().count() == 50
    assert staged == ["repeated-ids"]
    # The second batch takes the place of a part of the first.
    ingest.store_ocr(store, _images(spark, 20, "again")).collect()
    assert staged == ["repeated-ids", "repeated-ids", "kept"]
    kept = {r["document"] for r in store.read().collect()}
    assert kept == {f"again {i}" for i in range(20)} | {f"text {i}" for i in range(20, 50)}


@pytest.mark.parametrize("few", [True, False])
def test_the_last_of_repeated_ids_stays(spark, tmp_path, monkeypatch, few):
    if not few:
        monkeypatch.setattr(upsert, "broadcast_if_small", lambda df: df)
    rows = [("c", "a", 0, "old"), ("c", "a", 2, "new"), ("c", "b", 0, "only"), ("d", "a", 1, "other"), ("c", "e", 1, "e1"), ("c", "e", 3, "e3"), ("c", "e", 2, "e2")]
    batch = chunking.conform(spark.createDataFrame(rows, "collection string, id string, chunk_no int, document string").withColumn("source", F.col("id")))
    store = upsert.ChunkTable(spark, str(tmp_path / "t"), buckets=2)
    for _ in range(2):
        assert store.upsert(batch) == 4
        got = sorted((r["collection"], r["id"], r["document"]) for r in store.read().collect())
        assert got == [("c", "a", "new"), ("c", "b", "only"), ("c", "e", "e3"), ("d", "a", "other")]
