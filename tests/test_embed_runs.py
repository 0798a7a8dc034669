"""New texts are embedded in one pass, and buckets are counted alike however many there are."""

from __future__ import annotations

from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from gleaner.functions.embedding import bucket_counts, hash_embedder, token_buckets
from gleaner.operators.vectors import VectorTable


def test_every_new_text_is_embedded_in_one_pass(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        calls.add(1)
        return text

    def embed(df, text, out):
        return hash_embedder()(df.withColumn(text, seen.asNondeterministic()(text)), text, out)

    texts = spark.range(40).select(F.concat(F.lit("text "), (F.col("id") % 30).cast("string")).alias("text"))
    table = VectorTable(spark, str(tmp_path / "v"))
    assert table.fill(texts, "text", embed) == 30
    assert calls.value == 30 and table.size() == 30
    assert table.fill(texts, "text", embed) == 0 and calls.value == 30


@pytest.mark.parametrize("dim", [64, 256, 100, 1])
def test_bucket_counts_of_short_and_long_texts(spark, dim):
    texts = [None, "", " \t", "one", "Same same SAME", " ".join(f"w{i % 37}" for i in range(63)), " ".join(f"w{i % 37}" for i in range(65)),
             " ".join(f"é{i % 301}" for i in range(1500)), "x " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in rows.select("text", bucket_counts(token_buckets(F.col("text"), dim), dim).alias("c")).collect():
        want = Counter(int(md5(t.encode()).hexdigest()[:8], 16) % dim for t in (row["text"] or "").lower().split())
        assert row["c"] == [want[i] for i in range(dim)]
