"""Vectors kept by content: a text is embedded once, however often it is ingested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.embedding import Embedder
from gleaner.operators.index import exists
from gleaner.operators.sizes import broadcast_if_small
from gleaner.session import stage

NO_TEXT = "none"  # no digest looks like this


class VectorTable:
    """Parquet of ``key, vector``, the key being the SHA-256 of a text.

    One table belongs to one embedder: what it holds is not embedded again. A
    text without vector (the embedder gave NULL) is kept as such. Keys repeat
    where two callers embed a text at once; then one of the vectors is taken.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def read(self) -> DataFrame:
        schema = "key string, vector array<float>"
        return self.spark.read.schema(schema).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], schema)

    def size(self) -> int:
        """Number of different texts that have been embedded."""
        return self.read().select("key").distinct().count()

    def fill(self, texts: DataFrame, text: str, embed: Embedder) -> int:
        """Embed the texts of a column that are not kept yet, each once; returns how many."""
        keyed = texts.select(_key(text).alias("key"), F.col(text).alias("_text"))
        new = keyed.select("key").distinct().join(self.read().select("key").distinct(), "key", "left_anti")
        new = stage(new, "new-texts")
        # Only texts that are new are exchanged; a text that repeats shrinks before it is.
        todo = keyed.join(broadcast_if_small(new), "key", "left_semi").groupBy("key").agg(F.any_value("_text").alias("_text"))
        done = embed(todo, "_text", "vector").select("key", F.col("vector").cast("array<float>").alias("vector"))
        # In the order of the keys, so that the scan of a few leaves row groups out. Staged, as drawing the ranges would embed every text once more.
        stage(done, "embedded").repartitionByRange("key").sortWithinPartitions("key").write.mode("append").parquet(self.path)
        return new.count()

    def embedder(self, embed: Embedder) -> Embedder:
        """``embed`` behind this table: texts it holds are looked up, others are embedded and kept."""

        def kept(df: DataFrame, text: str, out: str) -> DataFrame:
            self.fill(df, text, embed)
            keyed = df.drop(out).withColumn("_vector_key", _key(text))
            vectors = self.read().join(keyed.select(F.col("_vector_key").alias("key")).distinct(), "key", "left_semi")
            vectors = vectors.groupBy("key").agg(F.max("vector").alias("_vector"))
            vectors = vectors.withColumnRenamed("key", "_vector_key")
            return keyed.join(vectors, "_vector_key", "left").drop("_vector_key").withColumnRenamed("_vector", out)

        return kept


def _key(text: str):
    return F.coalesce(F.sha2(F.col(text), 256), F.lit(NO_TEXT))
