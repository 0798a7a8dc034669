"""Approximate search over chunks stored by the nearest of a few centres.

The centres are fitted on a bounded sample. Every chunk is stored in the partition of its nearest centre;
a question looks into the partitions of its own nearest centres only, so what is far from all questions
is not even read. Inside the partitions the search is exact, and a question that
finds fewer chunks than it wants is answered by the exact search over everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import schemas as S
from gleaner.operators.best import matrix, widths
from gleaner.operators.blocks import best_by_key
from gleaner.operators.nearest import collection_rank, nearest, ranked, with_text
from gleaner.session import fresh_dir, stage

#: Rows of the sample that centres are fitted on, most centres, rounds of the fit.
SAMPLE_ROWS, MOST_CENTRES, ROUNDS, SEED = 32_768, 4_096, 12, 5

#: Centres a question looks at.
PROBES = 8

#: Partition of chunks that no centre is for: unusable vectors and other widths. Numbers compared at once.
ELSEWHERE, CELLS = -1, 4_000_000


def _nearest_centres(centres: np.ndarray, vectors: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the ``count`` nearest centres of each vector, nearest first, ties to the smaller number."""
    out = np.empty((len(vectors), min(count, len(centres))), np.int32)
    squares = (centres**2).sum(axis=1)
    step = max(1, CELLS // max(1, len(centres)))
    for at in range(0, len(vectors), step):
        part = vectors[at : at + step]
        apart = squares[None, :] - 2.0 * (part @ centres.T)
        out[at : at + step] = np.argsort(apart, axis=1, kind="stable")[:, : out.shape[1]] if count > 1 else apart.argmin(axis=1)[:, None]
    return out


def k_means(sample: np.ndarray, count: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """``count`` centres of ``sample`` at most; a centre that loses its rows moves to the row farthest from its own."""
    draw = np.random.default_rng(seed)
    different = np.unique(sample, axis=0)
    centres = different[draw.permutation(len(different))[:count]].astype(np.float64)
    for _ in range(rounds if len(centres) < len(different) else 0):
        own = _nearest_centres(centres, sample, 1)[:, 0]
        held = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        far = ((sample - centres[own]) ** 2).sum(axis=1)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
        empty = np.flatnonzero(held == 0)
        centres[empty] = sample[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def _usable(column: str):
    return (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def fit_centres(chunks: DataFrame, count: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> np.ndarray:
    """Centres for the width that most usable vectors of ``chunks`` have; by default as many as the square root of their number.

    Fitted in one task on the ``sample_rows`` rows with the smallest digests of their ids, whatever their partitions.
    """
    good = chunks.where(F.col("embedding").isNotNull() & _usable("embedding"))
    counted = good.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if counted is None:
        return np.zeros((0, 0))
    count = count or min(MOST_CENTRES, max(1, int(np.sqrt(counted["count"]))))
    drawn = good.where(F.size("embedding") == counted["width"]).select(F.xxhash64("collection", "id", F.lit(seed)).alias("_draw"), "id", "embedding")
    drawn = drawn.orderBy("_draw", "id").limit(sample_rows).select("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [matrix(batch.column("embedding")) for batch in batches if batch.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(k_means(np.concatenate(parts), count, seed=seed)), pa.list_(pa.float64()))], ["centre"])

    # At most ``MOST_CENTRES`` vectors come back.
    return np.array([r["centre"] for r in drawn.coalesce(1).mapInArrow(run, "centre array<double>").collect()])


def _placed(centres: np.ndarray, count: int, column: str, out: str, schema: T.StructType):
    """Arrow function: rows with the list ``out`` of their nearest centres (empty where no centre is for them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(column)
            fits = np.flatnonzero(widths(vectors) == centres.shape[1]) if centres.size else np.zeros(0, int)
            near: list = [[]] * batch.num_rows
            if len(fits):
                for row, own in zip(fits.tolist(), _nearest_centres(centres, matrix(vectors.take(pa.array(fits))), count).tolist()):
                    near[row] = own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], schema.fieldNames())

    return run


def _with_centres(df: DataFrame, centres: np.ndarray, count: int, column: str, out: str) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(_placed(centres, count, column, out, schema), schema)


class CoarseIndex:
    """Chunks in Parquet, partitioned by centre, and their centres. Written once; a new one takes the place of an old one."""

    COLUMNS = ("collection", "id", "source", "document", "embedding")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, chunks: DataFrame, centres: np.ndarray | None = None, count: int | None = None) -> "CoarseIndex":
        """Store ``chunks`` by centre. ``centres``: given ones, else ``count`` fitted ones.

        Every chunk is stored: those with unusable vectors or another width apart. A partition larger than
        a file should be is split by the rebalance before the write.
        """
        centres = fit_centres(chunks, count) if centres is None else np.asarray(centres, np.float64)
        rows = [(i, c.tolist()) for i, c in enumerate(centres)]
        self.spark.createDataFrame(rows, "number int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        # Says the columns where no partition does.
        chunks.select(*self.COLUMNS).limit(0).write.mode("overwrite").parquet(f"{self.path}/columns")
        placed = _with_centres(chunks.select(*self.COLUMNS), centres, 1, "embedding", "_near")
        placed = placed.withColumn("centre", F.coalesce(F.get("_near", F.lit(0)), F.lit(ELSEWHERE))).drop("_near")
        placed.hint("rebalance", "centre").write.mode("overwrite").partitionBy("centre").parquet(f"{self.path}/chunks")
        return self

    def centres(self) -> np.ndarray:
        """The stored centres, ``MOST_CENTRES`` at most."""
        rows = self.spark.read.schema("number int, centre array<double>").parquet(f"{self.path}/centres").orderBy("number").collect()
        return np.array([r["centre"] for r in rows])

    def chunks(self) -> DataFrame:
        columns = self.spark.read.parquet(f"{self.path}/columns").schema
        return self.spark.read.schema(columns.add("centre", T.IntegerType())).parquet(f"{self.path}/chunks")

    def asked(self, questions: DataFrame, probes: int) -> DataFrame:
        """``qid, vector, _near``: the questions with the centres they look at."""
        return _with_centres(questions.select("qid", F.col("vector").cast("array<double>").alias("vector")), self.centres(), probes, "vector", "_near")

    def read_for(self, asked: DataFrame) -> DataFrame:
        """The partitions that some question looks at; as many numbers as there are centres are gathered."""
        wanted = [r[0] for r in asked.select(F.explode("_near")).distinct().collect()]
        return self.chunks().where(F.col("centre").isin(wanted))

    def nearest(self, questions: DataFrame, k: int = S.TOP_K, probes: int = PROBES) -> DataFrame:
        """As :func:`gleaner.operators.nearest.nearest`, among the chunks of each question's ``probes`` nearest centres.

        A question that finds fewer than ``k`` there, or has a width without centres, is answered by the exact search.
        """
        asked = stage(self.asked(questions, probes), "coarse-asked")
        chunks = self.read_for(asked)
        order = collection_rank(S.RETRIEVAL_ORDER).alias("_rank")
        rows = chunks.select(F.col("centre").alias("_key"), F.lit("").alias("_slot"), "collection", "id", "source", "embedding", order)
        met = best_by_key(rows, asked.select(F.explode("_near").alias("_key"), "qid", "vector"), k)
        best = stage(ranked(met, ["qid"], k, "rank"), "coarse-best")
        enough = best.groupBy("qid").count().where(F.col("count") >= k).select("qid")
        found = with_text(best.join(enough, "qid", "left_semi"), chunks)
        columns = ["qid", "rank", "collection", "id", "source", "document", "distance"]
        short = stage(questions.select("qid", "vector").join(enough, "qid", "left_anti"), "coarse-short")
        return found.select(*columns) if short.isEmpty() else found.select(*columns).unionByName(nearest(self.chunks(), short, k))


def nearest_approx(chunks: DataFrame, questions: DataFrame, k: int = S.TOP_K, index: CoarseIndex | None = None, probes: int = PROBES) -> DataFrame:
    """Approximate search in a stored ``index``, or in one made on the way in the shared folder."""
    index = index or CoarseIndex(chunks.sparkSession, fresh_dir(chunks.sparkSession, "coarse")).build(chunks)
    return index.nearest(questions, k, probes)
