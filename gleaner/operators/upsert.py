"""Keyed upserts and the partitioned chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import schemas as S
from gleaner.functions.embedding import Embedder
from gleaner.operators import index, stats
from gleaner.operators.sizes import broadcast_if_small
from gleaner.session import stage

SOURCE_BUCKETS = 64


def last_write(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row per key, the one with the greatest version.

    An aggregate, so a key repeated in a third of all rows shrinks before the
    shuffle.
    """
    order = F.struct(*version)
    rest = F.struct(*[c for c in df.columns if c not in keys])
    best = df.groupBy(*keys).agg(F.max_by(rest, order).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Rows of ``existing`` replaced or extended by the last write per key."""
    fresh = last_write(incoming, keys, version)
    kept = existing.join(fresh.select(*keys), keys, "left_anti")
    return kept.select(*existing.columns).unionByName(fresh.select(*existing.columns))


def upsert_chunks(
    existing: DataFrame, incoming: DataFrame, version: list[str], keep_stale: bool = False
) -> DataFrame:
    """Chunk upsert. By default every old chunk of a rewritten source goes.

    With ``keep_stale`` only equal ids are replaced, so a source that got
    shorter keeps its old tail.
    """
    if keep_stale:
        return upsert(existing, incoming, ["collection", "id"], version)
    fresh = last_write(incoming, ["collection", "id"], version)
    rewritten = incoming.select("collection", "source").distinct()
    kept = existing.join(rewritten, ["collection", "source"], "left_anti")
    return kept.select(*existing.columns).unionByName(fresh.select(*existing.columns))


def insert_new(existing_ids: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet."""
    return incoming.join(existing_ids.select(*keys), keys, "left_anti")


def lookup(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Point reads by key; keys without a row are left out."""
    return df.join(wanted.select(*keys), keys, "left_semi")


class ChunkTable:
    """Chunks in Parquet, partitioned by collection and a hash of the source.

    A batch rewrites only the partitions its sources fall into: the batch and what
    is kept of them are staged in the shared folder, then swapped in by a dynamic
    partition overwrite, so a lost executor or a retried task cannot leave a
    half-written partition behind. An id stands once in a collection: ids that
    come back under another source are looked up in the files whose id filters
    (:mod:`gleaner.operators.index`) do not rule them out.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = SOURCE_BUCKETS):
        self.spark = spark
        self.path = path
        self.buckets = buckets
        self.index = index.ChunkIndex(spark, path)

    def read(self) -> DataFrame:
        """All stored chunks; an absent table reads as empty, any other trouble is an error."""
        if not index.exists(self.spark, self.path):
            return self.spark.createDataFrame([], S.CHUNK).withColumn("bucket", F.lit(0))
        schema = T.StructType([*S.CHUNK.fields, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path).select(*S.CHUNK.fieldNames(), "bucket")

    def _bucketed(self, df: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64("source"), F.lit(self.buckets)).cast("int")
        return df.select(*S.CHUNK.fieldNames()).withColumn("bucket", bucket)

    def _same_ids(self, incoming: DataFrame) -> DataFrame:
        """``collection, id, bucket`` of the stored chunks whose id the batch holds."""
        return self.lookup(incoming.select("collection", "id")).select("collection", "id", "bucket")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Stored chunks whose ``collection, id`` are asked for; only files that may hold one are read."""
        asked = wanted.select("collection", "id").distinct()
        stored = index.of_files(self.read(), self.index.holding(self.read(), asked))
        return stored.join(broadcast_if_small(asked), ["collection", "id"], "left_semi")

    def stats(self) -> DataFrame:
        """As :func:`gleaner.operators.stats.collection_stats` of the table, from what the index keeps; no stored chunk is read."""
        return stats.of_sources(self.index.sources(self.read()))

    def _touched(self, incoming: DataFrame) -> DataFrame:
        """Stored rows of the partitions the batch falls into or takes an id from (a pruned scan)."""
        # At most collections x buckets rows come back.
        own = incoming.select("collection", "bucket")
        pairs = own.unionByName(self._same_ids(incoming).select("collection", "bucket")).distinct().collect()
        hit = F.lit(False)
        for name in sorted({p["collection"] for p in pairs}):
            buckets = sorted(p["bucket"] for p in pairs if p["collection"] == name)
            hit = hit | ((F.col("collection") == name) & F.col("bucket").isin(*buckets))
        return self.read().where(hit)

    def _write(self, df: DataFrame, mode: str) -> None:
        # Rebalance splits an oversized partition, so one hot source is many files.
        (
            df.hint("rebalance", "collection", "bucket")
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("collection", "bucket")
            .parquet(self.path)
        )

    def create(self, chunks: DataFrame) -> int:
        """First write; an existing table is an error."""
        self._write(self._bucketed(chunks), "errorifexists")
        return self.read().count()

    def _last(self, incoming: DataFrame) -> tuple[DataFrame, int]:
        """The last row of every id of a staged batch, and their number.

        Ids that may repeat, usually none, are found from their hashes alone; only their rows are exchanged.
        """
        keys = ["collection", "id"]
        hashed = incoming.withColumn("_hash", F.xxhash64(*keys))
        often = stage(hashed.groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select("_hash"), "repeated-ids")
        if often.isEmpty():
            return incoming, incoming.count()
        often = broadcast_if_small(often)
        repeated = last_write(hashed.join(often, "_hash", "left_semi").drop("_hash"), keys, ["chunk_no"])
        once = hashed.join(often, "_hash", "left_anti").drop("_hash")
        return once.unionByName(repeated), incoming.select(*keys).distinct().count()

    def upsert(self, chunks: DataFrame, keep_stale: bool = False, staged: bool = False) -> int:
        """Write a batch; returns the number of chunks in it.

        ``staged`` says that ``chunks`` only reads files that stay, so that they are not written once more.
        """
        incoming = self._bucketed(chunks)
        incoming = incoming if staged else stage(incoming, "incoming")
        merged, count = self._last(incoming)
        if index.exists(self.spark, self.path):
            kept = self._touched(incoming)
            for key in [["collection", "id"]] + ([] if keep_stale else [["collection", "source"]]):
                kept = kept.join(broadcast_if_small(incoming.select(*key).distinct()), key, "left_anti")
            # What is kept is read before it is swapped; the batch is in files of its own.
            merged = merged.unionByName(stage(kept.select(*incoming.columns), "kept"))
        self._write(merged, "overwrite")
        return count

    def add_new(self, chunks: DataFrame, embed: Embedder) -> int:
        """Embed and append only chunks whose id is not stored yet."""
        incoming = stage(last_write(self._bucketed(chunks), ["collection", "id"], ["chunk_no"]), "incoming")
        fresh = embed(insert_new(self._same_ids(incoming), incoming, ["collection", "id"]), "document", "embedding")
        fresh = stage(fresh.select(*incoming.columns), "fresh")
        self._write(fresh, "append")
        return fresh.count()
