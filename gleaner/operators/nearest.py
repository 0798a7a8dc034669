"""Nearest chunks for a table of questions, by squared Euclidean distance.

The questions are the small side: a block of them, bounded in bytes, goes to
every task as one matrix. Chunks are never shuffled and no (question, chunk)
pair ever becomes a row: each task streams its chunk batches through a matrix
product and keeps the best ``k`` per question, and only those survivors are
exchanged for the final ranking. A question set beyond the bound is cut into
blocks by hash, and one scan serves several blocks.

Vectors with a null or non-finite element take no part; questions meet the
chunks of their own width. Distances are rounded to nine places before ranking, so that equal vectors tie
whatever order the sums ran in; ties go by collection order, then id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import schemas as S
from gleaner.functions import text as X
from gleaner.operators.best import Best, matrix, widths
from gleaner.operators.blocks import best_by_key
from gleaner.operators.upsert import broadcast_if_small
from gleaner.session import stage

BLOCK_BYTES = 64 << 20
BLOCK_ROWS = 20_000
BLOCKS_PER_SCAN = 4
# From so many tasks on, their rows are cut once more before a question's rows meet.
MANY_TASKS, MERGES = 512, 64


def collection_rank(order: tuple[str, ...], column: str = "collection") -> Column:
    """Position of the collection in a visiting order; unknown ones last."""
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(F.col(column) == name, F.lit(i)).otherwise(rank)
    return rank


def _scanner(blocks, k: int):
    """Batch function: chunk rows in, the task's best rows per question out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = [shared.value for shared in blocks]
        bests = [{width: Best(own["vectors"], k) for width, own in probe.items()} for probe in probes]
        for batch in batches:
            # Collection order, then id: the order equal distances are settled in.
            batch = batch.take(pc.sort_indices(batch, [("_rank", "ascending"), ("id", "ascending")]))
            found = widths(batch.column("embedding"))
            for width in sorted({width for probe in probes for width in probe} & set(found.tolist())):
                rows = batch.take(pa.array(np.flatnonzero(found == width)))
                vectors = matrix(rows.column("embedding"))
                ranks = rows.column("_rank").to_numpy(zero_copy_only=False)
                named = [rows.column(c) for c in ("collection", "id", "source")]
                for probe, best in zip(probes, bests):
                    if width in probe:
                        best[width].offer(np.arange(len(probe[width]["vectors"])), vectors, ranks, *named)
        for probe, best in zip(probes, bests):
            for width, own in probe.items():
                question, rows = [], []
                for q, kept in best[width].kept.items():
                    question.extend([q] * len(kept))
                    rows.extend(kept)
                yield pa.RecordBatch.from_arrays(
                    [
                        own["qid"].take(pa.array(question, pa.int64())),
                        pa.array([r[3] for r in rows], pa.string()),
                        pa.array([r[2] for r in rows], pa.string()),
                        pa.array([r[4] for r in rows], pa.string()),
                        pa.array([r[0] for r in rows], pa.float64()),
                        pa.array([r[1] for r in rows], pa.int32()),
                    ],
                    names=["qid", "collection", "id", "source", "distance", "_rank"],
                )

    return scan


def _probe(block: pa.Table) -> dict[int, dict]:
    """Questions of a block by the width of their vectors; unusable vectors are left out."""
    vectors = block.column("vector").combine_chunks()
    found = widths(vectors)
    out = {}
    for width in sorted(set(found.tolist()) - {0}):
        rows = pa.array(np.flatnonzero(found == width))
        out[width] = {"qid": block.column("qid").combine_chunks().take(rows), "vectors": matrix(vectors.take(rows))}
    return out


def _blocks(probes: DataFrame) -> Iterator[pa.Table]:
    """The questions in blocks of bounded size."""
    head = probes.limit(BLOCK_ROWS + 1).toArrow()
    widest = max(widths(head.column("vector").combine_chunks()).tolist(), default=1) if head.num_rows else 1
    bound = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(widest, 1))))
    if head.num_rows <= bound:
        yield head
        return
    passes = math.ceil(1.5 * probes.count() / bound)
    for i in range(passes):
        yield probes.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i).toArrow()


def _survivors(
    chunks: DataFrame, probes: DataFrame, k: int, order: tuple[str, ...], tasks: int | None = None
) -> tuple[DataFrame, int]:
    """Best rows of every task, and the number of question blocks."""
    spark = chunks.sparkSession
    probes = probes.where(F.col("vector").isNotNull())
    rows = chunks.select("collection", "id", "source", "embedding", collection_rank(order).alias("_rank"))
    if tasks:
        rows = rows.coalesce(tasks)
    schema = T.StructType(
        [
            T.StructField("qid", probes.schema["qid"].dataType),
            T.StructField("collection", T.StringType()),
            T.StructField("id", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("distance", T.DoubleType()),
            T.StructField("_rank", T.IntegerType()),
        ]
    )
    shared = [spark.sparkContext.broadcast(_probe(block)) for block in _blocks(probes) if block.num_rows]
    if not shared:
        return spark.createDataFrame([], schema), 0
    out = None
    for first in range(0, len(shared), BLOCKS_PER_SCAN):
        scanned = rows.mapInArrow(_scanner(shared[first : first + BLOCKS_PER_SCAN], k), schema)
        out = scanned if out is None else out.unionByName(scanned)
    if out.rdd.getNumPartitions() > MANY_TASKS:
        out = ranked(out.withColumn("_merge", F.spark_partition_id() % MERGES), ["qid", "_merge"], k, "_first").drop("_merge", "_first")
    return out, len(shared)


def ranked(rows: DataFrame, keys: list[str], k: int, out: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy("distance", "_rank", "id")
    return rows.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)


def with_text(winners: DataFrame, chunks: DataFrame, few: bool = False) -> DataFrame:
    """Text for the winners only. One id may stand under several sources, so the source is part of the key."""
    small = F.broadcast(winners) if few else broadcast_if_small(stage(winners, "winners"))
    texts = chunks.select(*[F.col(c).alias(f"_{c}") for c in ("collection", "id", "source")], "document")
    same = (small["collection"] == texts["_collection"]) & (small["id"] == texts["_id"]) & small["source"].eqNullSafe(texts["_source"])
    return texts.join(small, same).drop("_collection", "_id", "_source")


def nearest(chunks: DataFrame, questions: DataFrame, k: int = S.TOP_K, tasks: int | None = None) -> DataFrame:
    """The ``k`` nearest chunks of all collections for every question.

    ``questions`` has ``qid`` and ``vector``. Taking the best ``k`` of each
    collection, merging, and cutting at ``k`` keeps exactly the best ``k`` of
    the union under the same order, so one cut suffices. ``tasks`` packs the
    scan's splits into that many tasks: each sends at most ``k`` rows per
    question, so fewer, longer tasks exchange less.
    """
    rows, passes = _survivors(chunks, questions.select("qid", "vector"), k, S.RETRIEVAL_ORDER, tasks=tasks)
    best = ranked(rows, ["qid"], k, "rank")
    # One block has at most BLOCK_ROWS questions, hence BLOCK_ROWS x k winners.
    return with_text(best, chunks, few=passes <= 1).select(
        "qid", "rank", "collection", "id", "source", "document", "distance"
    )


def nearest_in_source(chunks: DataFrame, probes: DataFrame, n: int = S.SNIPPETS, buckets: int | None = None) -> DataFrame:
    """The ``n`` nearest chunks within the asked source.

    ``probes`` has ``qid``, ``source`` and ``vector``. Per collection the best
    ``max(n, 5)`` are fetched, blank texts dropped after that, the rest merged.
    Chunks and probes of a source meet in blocks (:mod:`gleaner.operators.blocks`), so neither a source
    with a third of all chunks nor one that everybody asks for is one task. With ``buckets``, the number
    of hash buckets of a stored chunk table, only the buckets of the asked sources are read.
    """
    fetch = max(n, S.SNIPPET_FETCH)
    if buckets:
        asked = probes.where(F.col("source").isNotNull()).select(F.pmod(F.xxhash64("source"), F.lit(buckets)).cast("int").alias("_bucket"))
        # At most as many rows as buckets; a side with a comparison prunes the other's partitions at run time.
        asked = F.broadcast(stage(asked.distinct(), "asked-buckets").where("_bucket >= 0"))
        chunks = chunks.join(asked, chunks["bucket"] == asked["_bucket"], "left_semi")
    order = collection_rank(S.SNIPPET_ORDER).alias("_rank")
    rows = chunks.select(F.col("source").alias("_key"), F.col("collection").alias("_slot"), "collection", "id", "source", "embedding", order)
    met = best_by_key(rows, probes.select(F.col("source").alias("_key"), "qid", "vector"), fetch)
    fetched = ranked(met, ["qid", "_slot"], fetch, "_fetched").drop("_fetched", "_slot")
    # Which of the fetched have text is asked by their names alone; texts go to the final ones only.
    named = chunks.where(X.strip("document") != "").select(*[F.col(c).alias(f"_{c}") for c in ("collection", "id", "source")])
    same = (fetched["collection"] == named["_collection"]) & (fetched["id"] == named["_id"]) & fetched["source"].eqNullSafe(named["_source"])
    best = ranked(fetched.join(named, same, "left_semi"), ["qid"], n, "snippet_no")
    return with_text(best, chunks).select(
        "qid", "source", "snippet_no", "collection", "id", "document", "distance"
    )
