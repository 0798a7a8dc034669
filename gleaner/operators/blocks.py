"""Questions and chunks that share a key, compared block by block.

A key (a source, a cell of an index) may hold a third of all chunks and most questions. Its chunks and its
questions are cut into blocks by hash, every block of questions meets every block of chunks in one
group of a shuffle, and a group is a matrix product over streamed batches. At most ``k`` rows per
question and block leave a task; no (question, chunk) pair becomes a row, and nothing is broadcast but the
block counts of the keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.best import Best, matrix, widths
from gleaner.operators.upsert import broadcast_if_small
from gleaner.session import stage

#: Chunks of a block, questions of a block.
CHUNKS, QUESTIONS = 16_384, 1_024

_KEYS = ("_key", "_block", "_lot")


def _runs(batch: pa.RecordBatch, columns: tuple[str, ...]) -> np.ndarray:
    """Where a row differs from the one before it in one of the ``columns`` (none of them null), and the end."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in columns:
        column = batch.column(name)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.r_[np.flatnonzero(new), batch.num_rows]


class _Group:
    """The questions of one group, and the best chunks seen of each slot."""

    def __init__(self, k: int):
        self.k, self.asked, self.bests = k, {}, {}

    def ask(self, rows: pa.RecordBatch) -> None:
        vectors = rows.column("vector")
        found = widths(vectors)
        for width in np.unique(found[found > 0]).tolist():
            own = pa.array(np.flatnonzero(found == width))
            self.asked.setdefault(width, []).append((rows.column("qid").take(own), matrix(vectors.take(own))))

    def offer(self, slot: str, rows: pa.RecordBatch) -> None:
        embeddings = rows.column("embedding")
        found = widths(embeddings)
        for width in np.unique(found[found > 0]).tolist():
            if width not in self.asked:
                continue
            if (slot, width) not in self.bests:
                parts = self.asked[width]
                if len(parts) > 1:
                    parts[:] = [(pa.concat_arrays([q for q, _ in parts]), np.concatenate([v for _, v in parts]))]
                self.bests[slot, width] = Best(parts[0][1], self.k)
            own = pa.array(np.flatnonzero(found == width))
            held = rows.take(own)
            ranks = held.column("_rank").to_numpy(zero_copy_only=False)
            names = [held.column(c) for c in ("collection", "id", "source")]
            self.bests[slot, width].offer(np.arange(len(self.asked[width][0][0])), matrix(held.column("embedding")), ranks, *names)

    def kept(self) -> Iterator[pa.RecordBatch]:
        for (slot, width), best in self.bests.items():
            question, rows = [], []
            for q, own in best.kept.items():
                question += [q] * len(own)
                rows += own
            yield pa.RecordBatch.from_arrays(
                [
                    self.asked[width][0][0].take(pa.array(question, pa.int64())), pa.array([slot] * len(rows), pa.string()),
                    pa.array([r[3] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()),
                    pa.array([r[4] for r in rows], pa.string()), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int32()),
                ],
                ["qid", "_slot", "collection", "id", "source", "distance", "_rank"],
            )


def _compared(k: int):
    """Arrow function over rows sorted by key, block, lot, questions before chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, _Group(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = _runs(batch, (*_KEYS, "_kind", "_slot"))
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows = batch.slice(a, b - a)
                own = tuple(rows.column(c)[0].as_py() for c in _KEYS)
                if own != key:
                    yield from group.kept()
                    key, group = own, _Group(k)
                if rows.column("_kind")[0].as_py() == 0:
                    group.ask(rows)
                elif group.asked:
                    group.offer(rows.column("_slot")[0].as_py(), rows)
        yield from group.kept()

    return run


def best_by_key(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """``qid, _slot, collection, id, source, distance, _rank``: at most ``k`` chunks per question, slot and block, the best ``k`` of a slot among them.

    ``chunks`` has ``_key``, ``_slot`` (null counts as empty; the best are kept for each slot), ``collection, id, source,
    embedding, _rank``; ``questions`` has ``_key, qid, vector`` and may ask several keys. Rows without a
    key meet nothing. ``chunks`` is read twice, its keys alone the first time.
    """
    asked = stage(questions.where(F.col("_key").isNotNull() & F.col("vector").isNotNull()).select("_key", "qid", F.col("vector").cast("array<double>").alias("vector")), "asked")
    lots = asked.groupBy("_key").agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("_lots"))
    lots = broadcast_if_small(stage(lots, "asked-keys"))
    sizes = chunks.join(lots, "_key").groupBy("_key", "_lots").agg(F.ceil(F.count("*") / CHUNKS).cast("int").alias("_blocks"))
    sizes = broadcast_if_small(stage(sizes, "asked-sizes"))

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    rows = chunks.join(sizes, "_key").select(
        "_key", F.pmod(F.xxhash64("collection", "id", "source"), "_blocks").cast("int").alias("_block"), every("_lots").alias("_lot"), F.lit(1).alias("_kind"),
        F.coalesce("_slot", F.lit("")).alias("_slot"), "collection", F.coalesce("id", F.lit("")).alias("id"), "source", "_rank", "embedding",
        F.lit(None).cast(asked.schema["qid"].dataType).alias("qid"), F.lit(None).cast("array<double>").alias("vector"),
    )
    probes = asked.join(sizes, "_key").select(
        "_key", F.pmod(F.xxhash64("qid"), "_lots").cast("int").alias("_lot"), every("_blocks").alias("_block"), F.lit(0).alias("_kind"), F.lit("").alias("_slot"),
        F.lit(None).cast("string").alias("collection"), F.lit("").alias("id"), F.lit(None).cast("string").alias("source"), F.lit(0).alias("_rank"),
        F.lit(None).cast(rows.schema["embedding"].dataType).alias("embedding"), "qid", "vector",
    )
    # Within a slot rows come in tie order, as the search expects.
    dealt = rows.unionByName(probes).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "_kind", "_slot", "_rank", "id")
    schema = T.StructType(
        [
            T.StructField("qid", asked.schema["qid"].dataType), T.StructField("_slot", T.StringType()), T.StructField("collection", T.StringType()),
            T.StructField("id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("distance", T.DoubleType()),
            T.StructField("_rank", T.IntegerType()),
        ]
    )
    return dealt.mapInArrow(_compared(k), schema)
