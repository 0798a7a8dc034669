from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleaner.functions.embedding import hash_embedder
from gleaner.operators import index, stats, upsert
from gleaner.operators.vectors import VectorTable
from gleaner.plans.chunking import conform

ODD = "p+q %2B/x"  # a collection whose folder name is escaped


def rows(spark, lo, hi, source="s"):
    ids = spark.range(lo, hi)
    return conform(
        ids.select(
            F.when(F.col("id") % 2 == 0, F.lit(ODD)).otherwise("ti_tabular_docs").alias("collection"), F.concat(F.lit("i"), "id").alias("id"),
            F.when(F.col("id") % 37 > 0, F.concat(F.lit(source), (F.col("id") % 37).cast("string"))).alias("source"),
            F.col("id").alias("chunk_no"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("rows"), F.lit("text").alias("document"),
        )
    )


def same(df, text, out):
    return df


def figures(df):
    return sorted(map(tuple, df.collect()))


def check(table):
    assert figures(table.stats()) == figures(stats.collection_stats(table.read()))


def test_figures_follow_every_kind_of_write(spark, tmp_path):
    table = upsert.ChunkTable(spark, str(tmp_path / "t"), buckets=4)
    check(table)  # no table yet
    assert table.lookup(rows(spark, 0, 3)).count() == 0
    table.create(rows(spark, 0, 2000))
    check(table)
    table.upsert(rows(spark, 100, 120))
    check(table)
    table.upsert(rows(spark, 130, 140, "moved"), keep_stale=True)
    check(table)
    stored = {r["id"] for r in table.read().collect()}
    assert table.add_new(rows(spark, 1990, 2010, "third"), same) == len({f"i{i}" for i in range(1990, 2010)} - stored)
    check(table)


def test_lookup_reads_only_files_that_may_hold_an_id(spark, tmp_path):
    table = upsert.ChunkTable(spark, str(tmp_path / "t"), buckets=16)
    table.create(rows(spark, 0, 4000))
    table.add_new(rows(spark, 4000, 4400), same)
    asked = rows(spark, 77, 79).unionByName(rows(spark, 4100, 4101)).unionByName(rows(spark, 90_000, 90_001))
    assert sorted(r["id"] for r in table.lookup(asked).collect()) == ["i4100", "i77", "i78"]
    every = index.listing(table.read())
    named = table.index.holding(table.read(), asked.select("collection", "id"))
    assert set(named) <= every and 3 <= len(named) < len(every) / 3
    scan = index.of_files(table.read(), named).select("id")
    scan.collect()
    read = scan._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()
    assert read < len(every) / 3
    absent = rows(spark, 100_000, 101_000).select("collection", "id")  # few of these pass a filter by chance
    probes = [table.index.holding(table.read(), absent.where(F.col("id") == f"i{i}")) for i in (100_000, 100_001, 100_002)]
    assert sum(map(len, probes)) <= 2


def test_statistics_read_no_stored_chunk(spark, tmp_path):
    table = upsert.ChunkTable(spark, str(tmp_path / "t"), buckets=4)
    table.create(rows(spark, 0, 500))
    table.stats().collect()
    read = table.stats().inputFiles()
    assert read and all("/_index/sources/" in name for name in read)


def test_an_index_that_broke_off_or_is_gone_is_made_up(spark, tmp_path, monkeypatch):
    table = upsert.ChunkTable(spark, str(tmp_path / "t"), buckets=4)
    table.create(rows(spark, 0, 300))
    whole = index.ChunkIndex._append

    def broken(self, name, frame):
        if name == "files":
            raise RuntimeError("lost before the run counts")
        whole(self, name, frame)

    monkeypatch.setattr(index.ChunkIndex, "_append", broken)
    with pytest.raises(RuntimeError):
        table.stats()
    monkeypatch.setattr(index.ChunkIndex, "_append", whole)
    check(table)  # what the broken run left is not counted twice
    for _ in range(3):  # replaced files come to outnumber the files
        table.upsert(rows(spark, 0, 300))
        check(table)
    assert table.lookup(rows(spark, 5, 9)).count() == 4
    table.index.forget()
    check(table)


def test_a_text_is_embedded_once(spark, tmp_path):
    calls = []

    def embed(df, text, out):
        calls.append(sorted((r[0] for r in df.select(text).collect()), key=lambda t: t or ""))
        return hash_embedder(8)(df, text, out)

    table = VectorTable(spark, str(tmp_path / "v"))
    kept = table.embedder(embed)
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "c")], "n int, text string")
    got = {r["n"]: r["vector"] for r in kept(texts, "text", "vector").collect()}
    want = {r["n"]: r["vector"] for r in hash_embedder(8)(texts, "text", "vector").collect()}
    assert got == want and sorted(map(str, calls[0])) == ["", "None", "a b", "c"]
    more = texts.unionByName(spark.createDataFrame([(6, "new"), (7, "c")], "n int, text string"))
    got = {r["n"]: r["vector"] for r in kept(more, "text", "vector").collect()}
    assert calls[1] == ["new"] and len(got) == 7 and got[7] == got[5] == want[5] and table.size() == 5
    assert kept(texts.limit(0), "text", "vector").count() == 0 and calls[2] == []
    # An existing vector column is replaced, as any embedder does.
    again = kept(texts.withColumn("vector", F.lit(None).cast("array<float>")), "text", "vector")
    assert {r["n"]: r["vector"] for r in again.collect()} == want
