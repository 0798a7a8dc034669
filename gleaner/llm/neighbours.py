"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits a bounded sample at every node by the hyperplane between two centres,
drawn at random and moved by a few steps of two means. Every row goes down every tree to
a leaf. Equal vectors are one row of the trees, with as many of their ids as an answer can hold.
A query goes down all trees with one priority queue: the leaf whose
worst wrong turn has the smallest margin comes next, whichever tree it is in, until
the leaves hold enough rows. Their rows are then ranked by exact distance: leaves, in
blocks of bounded size, meet the queries that visit them, a task keeps the
nearest of each query, and only those are shuffled to the final ranking.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from gleaner.llm.common import short_batches
from gleaner.session import stage

#: Trees, rows of the sample they are built on at most, rows wanted in a leaf, rows of a block of a leaf.
TREES, SAMPLE_ROWS, LEAF_ROWS, BLOCK_ROWS = 24, 32_768, 100, 4_096

#: Distinct vectors that the leaves of a query hold together, counted once for each tree they are found in: a share of all, and
#: at least so many. Vectors without clusters need a large share for a recall of 0.9; clustered ones do with far less.
SHARE, LEAST_ROWS, SEED = 0.8, 4_000, 11


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, width`` of the rows that take part: no null, zero or non-finite vector, no null id; repeated rows count once."""
    e = F.col("embedding")
    good = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    good &= ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(good).distinct().withColumn("width", F.size("embedding"))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """``width, embedding, ids``: each vector of ``rows`` once, with its ``k + 1`` smallest ids; one of them may be the query's own.

    A larger id of the same vector is no answer: ``k`` others stand before it.
    """
    # A bounded heap in every task before the exchange: a vector that many ids share stays small.
    return rows.groupBy("width", "embedding").agg(F.sort_array(InternalFunction.collect_top_k(F.col("vec_id"), k + 1, True)).alias("ids"))


def build_tree(sample: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(normals, thresholds) of the inner nodes in heap order; node ``i`` has the children ``2i + 1`` and ``2i + 2``."""
    draw = np.random.default_rng(seed)
    width = sample.shape[1]
    normals, limits = np.zeros(((1 << depth) - 1, width), np.float32), np.zeros((1 << depth) - 1, np.float32)
    rows = {0: np.arange(len(sample))}
    for node in range(len(normals)):
        own = rows.pop(node)
        normal = draw.normal(size=width).astype(np.float32)
        if len(own) > 1:
            some = sample[own[draw.integers(0, len(own), min(256, len(own)))]]
            a, b = sample[draw.choice(own, 2, replace=False)]
            for _ in range(4):
                nearer = ((some - a) ** 2).sum(axis=1) < ((some - b) ** 2).sum(axis=1)
                a = some[nearer].mean(axis=0) if nearer.any() else a
                b = some[~nearer].mean(axis=0) if not nearer.all() else b
            normal = a - b if np.any(a != b) else normal
        normals[node] = normal / max(float(np.linalg.norm(normal)), 1e-12)
        along = sample[own] @ normals[node]
        limits[node] = np.median(along) if len(own) else 0
        left = along <= limits[node]
        rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
    return normals, limits


def _built(sample: np.ndarray, depth: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.column("id").to_pylist():
                normals, limits = build_tree(sample, depth, seed + tree)
                yield pa.RecordBatch.from_arrays([pa.array([tree]), pa.array([normals.tobytes()]), pa.array([limits.tobytes()])], ["tree", "normals", "limits"])

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _celled(forest: list[tuple[np.ndarray, np.ndarray]], depth: int, width: int):
    """Arrow function: rows with the leaf of every tree, numbered across trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("embedding"), width).astype(np.float32)
            cells = np.empty((len(rows), len(forest)), np.int32)
            for tree, (normals, limits) in enumerate(forest):
                node = np.zeros(len(rows), np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + ((rows * normals[node]).sum(axis=1) > limits[node])
                cells[:, tree] = (tree << depth) + node - len(normals)
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids"), batch.column("embedding"), pa.array(list(cells), pa.list_(pa.int32()))], ["ids", "embedding", "cells"]
            )

    return run


def visited(forest: list[tuple[np.ndarray, np.ndarray]], depth: int, held: np.ndarray, wanted: float, query: np.ndarray) -> list[int]:
    """Leaves that a query visits, nearest first, until they hold ``wanted`` distinct vectors. ``held``: distinct vectors by leaf."""
    sides = [normals @ query - limits for normals, limits in forest]
    queue = [(0.0, tree, 0) for tree in range(len(forest))]
    cells, rows, inner = [], 0, (1 << depth) - 1
    while queue and rows < wanted:
        worst, tree, node = heapq.heappop(queue)
        while node < inner:
            side = float(sides[tree][node])
            right = side > 0
            heapq.heappush(queue, (max(worst, abs(side)), tree, 2 * node + (1 if right else 2)))
            node = 2 * node + (2 if right else 1)
        cell = (tree << depth) + node - inner
        if held[cell]:
            cells.append(cell)
            rows += int(held[cell])
    return cells


def _probes(forest, depth: int, width: int, held: np.ndarray, wanted: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("embedding"), width).astype(np.float32)
            own = [visited(forest, depth, held, wanted, q) for q in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("embedding"), pa.array(own, pa.list_(pa.int32()))], ["vec_id", "embedding", "cells"]
            )

    return run


def _nearest(query: np.ndarray, found: np.ndarray, score: np.ndarray, k: int):
    """The ``k`` best ids of every query, each id once with its smallest score."""
    # An id found in several leaves, or with several vectors, stands side by side.
    order = np.lexsort((score, found, query))
    query, found, score = query[order], found[order], score[order]
    first = np.r_[True, (query[1:] != query[:-1]) | (found[1:] != found[:-1])]
    query, found, score = query[first], found[first], score[first]
    order = np.lexsort((found, score, query))
    query, found, score = query[order], found[order], score[order]
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    return query[rank < k], found[rank < k], score[rank < k]


def _ranked(width: int, k: int):
    """Arrow function over rows sorted by block: the nearest of each query among the task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"key": None, "ids": [], "row": [], "rows": [], "repeats": None}
        held: list[tuple] = []
        size = 0

        def batch_of():
            got = _nearest(*[np.concatenate(c) for c in zip(*held)], k)
            return got, pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["query_id", "vec_id", "score"])

        for batch in batches:
            cells, blocks, kinds = [batch.column(c).to_numpy() for c in ("cell", "block", "kind")]
            lists = batch.column("ids")
            ids, ends = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            rows = _matrix(batch.column("embedding"), width).astype(np.float64)
            cuts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1]), True])
            for a, b in zip(cuts[:-1], cuts[1:]):
                key = (cells[a], blocks[a])
                if key != state["key"]:
                    state = {"key": key, "ids": [], "row": [], "rows": [], "repeats": None}
                if kinds[a] == 0:
                    before = sum(map(len, state["rows"]))
                    state["ids"].append(ids[ends[a] : ends[b]])
                    state["row"].append(np.repeat(np.arange(before, before + b - a), np.diff(ends[a : b + 1])))
                    state["rows"].append(rows[a:b])
                    continue
                if not state["ids"]:
                    continue
                if len(state["ids"]) > 1:
                    for part in ("ids", "row", "rows"):
                        state[part] = [np.concatenate(state[part])]
                if state["repeats"] is None:
                    state["repeats"] = len(np.unique(state["ids"][0])) < len(state["ids"][0])
                own, row, members = state["ids"][0], state["row"][0], state["rows"][0]
                for i in range(a, b):
                    query = ids[ends[i]]
                    distance = np.sqrt(((members - rows[i]) ** 2).sum(axis=1))[row]
                    other = own != query
                    near, names = distance[other], own[other]
                    if state["repeats"]:
                        order = np.lexsort((near, names))
                        near, names = near[order], names[order]
                        first = np.r_[True, names[1:] != names[:-1]][: len(names)]
                        near, names = near[first], names[first]
                    if len(near) > k:
                        limit = np.partition(near, k - 1)[k - 1]
                        near, names = near[near <= limit], names[near <= limit]
                    held.append((np.full(len(near), query), names, near))
                    size += len(near)
                if size > 200_000:
                    got, out = batch_of()
                    if len(got[0]) > 100_000:
                        yield out
                        held, size = [], 0
                    else:
                        held, size = [got], len(got[0])
        if size:
            yield batch_of()[1]

    return run


def search(
    vectors: DataFrame, every: int = 100, k: int = 10, trees: int = TREES, share: float = SHARE, least_rows: int = LEAST_ROWS, seed: int = SEED
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for every row of ``vectors`` (``vec_id``, ``embedding``) whose id ``every`` divides.

    The score is the Euclidean distance of the given vectors in double precision,
    nearest first, ties to the smaller id; a query's own id is no answer. Null, zero and
    non-finite vectors and rows without an id take no part; vectors meet
    those of their own width only. Ids that repeat with different vectors count with the nearest.
    A query that finds fewer than ``k`` rows has seen all of them.
    """
    spark = vectors.sparkSession
    short_batches(spark)
    rows = stage(usable(vectors), "near-vectors")
    whole = None
    distinct = stage(classes(rows, k), "near-classes")
    asked = rows.filter(F.col("vec_id") % every == 0)
    for got in distinct.groupBy("width").count().collect():
        own = F.col("width") == got["width"]
        found = _search_one(distinct.filter(own), asked.filter(own), got["width"], got["count"], k, trees, share, least_rows, seed)
        whole = found if whole is None else whole.unionByName(found)
    if whole is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = whole.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_one(
    rows: DataFrame, asked: DataFrame, width: int, count: int, k: int, trees: int, share: float, least_rows: int, seed: int
) -> DataFrame:
    spark = rows.sparkSession
    deepest = max(0, int(np.log2(SAMPLE_ROWS // 16)))
    depth = min(max(0, int(np.log2(max(count / LEAF_ROWS, 1)))), deepest)
    chosen = rows.orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE_ROWS).select("embedding").toArrow().column(0).combine_chunks()
    sample = _matrix(chosen, width).astype(np.float32)
    made = spark.range(trees).repartition(trees).mapInArrow(_built(sample, depth, seed), "tree long, normals binary, limits binary").collect()
    forest = [
        (np.frombuffer(r["normals"], np.float32).reshape(-1, width), np.frombuffer(r["limits"], np.float32)) for r in sorted(made, key=lambda r: r["tree"])
    ]
    element = rows.schema["embedding"].dataType.elementType.simpleString()
    types = f"embedding array<{element}>, cells array<int>"
    index = stage(rows.select("ids", "embedding").mapInArrow(_celled(forest, depth, width), "ids array<long>, " + types), "near-index")
    # As many rows as the forest has leaves.
    sizes = index.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    held = np.zeros(trees << depth, np.int64)
    for r in sizes.collect():
        held[r["cell"]] = r["n"]
    wanted = max(share * count, least_rows, trees * (k + 1))
    probes = asked.select("vec_id", "embedding").mapInArrow(_probes(forest, depth, width, held, wanted), "vec_id long, " + types)
    blocks = [(int(c), int(-(-held[c] // BLOCK_ROWS))) for c in np.flatnonzero(held)]
    blocks = F.broadcast(spark.createDataFrame(blocks, "cell int, blocks int"))
    members = index.select("ids", "embedding", F.explode("cells").alias("cell")).join(blocks, "cell")
    members = members.select("cell", F.pmod(F.xxhash64("embedding"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), "ids", "embedding")
    asked = probes.select(F.array("vec_id").alias("ids"), "embedding", F.explode("cells").alias("cell")).join(blocks, "cell")
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "ids", "embedding")
    met = members.unionByName(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    return met.mapInArrow(_ranked(width, k), "query_id long, vec_id long, score double")
