"""Arrow batches of the chunker are bounded, whatever the length of the texts and the number of rows in a partition."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions import splitter
from gleaner.plans import chunking
from gleaner.session import BATCH_LIMITS, bound_batches


@pytest.fixture
def limits(spark):
    """The session's own limits before and after."""
    before = {key: spark.conf.get(key) for key in BATCH_LIMITS}
    for key in BATCH_LIMITS:
        spark.conf.unset(key)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def _batch_rows(column: str):
    """Rows of the batch that each row came in."""

    @F.arrow_udf("int")
    def rows(texts: pa.Array) -> pa.Array:
        return pa.array([len(texts)] * len(texts), pa.int32())

    return rows(column)


def test_chunker_bounds_its_batches(spark, limits):
    short = spark.range(1000, numPartitions=1).select(F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"))
    long = spark.range(30, numPartitions=1).select(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" word")), 200_000).alias("text"))
    rows = short.select(_batch_rows("text").alias("n"), F.size(splitter.chunks("text")).alias("chunks")).agg(F.max("n").alias("n"), F.sum("chunks").alias("chunks")).first()
    assert rows["n"] <= 256 and rows["chunks"] == 1000
    assert long.select(F.max(_batch_rows("text"))).first()[0] <= 5  # over 1 MB each


def test_smaller_limits_of_the_user_stay(spark, limits):
    rows, size = BATCH_LIMITS
    spark.conf.set(rows, "10")
    spark.conf.set(size, "1m")
    bound_batches(spark)
    assert (spark.conf.get(rows), spark.conf.get(size)) == ("10", "1m")
    spark.conf.set(rows, "-1")
    bound_batches(spark)
    assert int(spark.conf.get(rows)) == BATCH_LIMITS[rows]


def test_bound_is_set_where_the_rows_are(spark, limits):
    """The rows of a second session are cut by its settings, whichever session is active."""
    second = spark.newSession()
    text = F.concat(F.lit("page "), F.col("id").cast("string"))
    pages = second.range(600, numPartitions=1).select(
        F.concat(F.lit("http://x/"), F.col("id").cast("string")).alias("source"), text.alias("text"),
        F.col("id").alias("page"), F.lit("f").alias("file"), F.create_map(F.lit("title"), F.lit("t")).alias("metadata"),
    )
    for cut in (chunking.page_chunks, chunking.paged_chunks, chunking.ocr_split_chunks):
        for key in BATCH_LIMITS:
            second.conf.unset(key)
        chunks = cut(pages)
        assert {key: second.conf.get(key) for key in BATCH_LIMITS} == {key: str(most) for key, most in BATCH_LIMITS.items()}, cut.__name__
        assert pages.select(F.max(_batch_rows("text"))).first()[0] <= 256, cut.__name__
        assert chunks.count() == 600, cut.__name__


def test_pages_are_cut_in_bounded_batches(spark, limits):
    body = F.concat(F.lit("page "), F.col("id").cast("string"), F.repeat(F.lit(" word"), 300))
    pages = spark.range(600, numPartitions=1).select(
        F.concat(F.lit("http://x/"), F.col("id").cast("string")).alias("source"), body.alias("text"), F.create_map(F.lit("title"), F.lit("t")).alias("metadata")
    )
    chunks = chunking.ingest_pages(pages)
    assert pages.select(F.max(_batch_rows("text"))).first()[0] <= 256
    got = {(r["source"], r["chunk_no"]): r["document"] for r in chunks.collect()}
    want = {(p["source"], i): body for p in pages.collect() for i, (_, body) in enumerate(splitter.split_text(p["text"]))}
    assert got == want
