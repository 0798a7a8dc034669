"""Hard negatives by the threshold algorithm.

Rows are dealt into blocks; in a task every block has one sorted candidate list for each dimension. An anchor
reads its lists from the top where its own component is positive, from the bottom where it is negative. Rows that come up
are scored at once, by an integer inner product. What has not come up scores at most the sum of the
anchor's components times the entries last read; reading ends when that threshold is strictly below the last wanted score
of every window (or below the window), so ties are all seen. The best of the blocks are merged.

Two rounds: first the positives of every anchor, which fix its windows, then the best rows of other labels inside them.
Anchors that share vector and label are searched for as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import maybe_broadcast, short_batches
from gleaner.session import stage

#: Entries become ``floor(SCALE * x)``.
SCALE = 256

#: Rows of a block, anchors of a lot that meet it in one task, entries read from every list before the threshold is looked at first.
BLOCK_ROWS, LOT_ROWS, FIRST_READ = 4_096, 4_096, 32

#: Answers of a task that are put into order before they leave it.
HELD = 100_000


def candidates(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, x, width``: integer vectors of the rows that take part, each row once, labels of every seventh id moved on.

    Entries whose products could leave 64 bits count as the largest that cannot.
    """
    e = F.col("embedding")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    good &= ~F.exists(e, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    most = F.floor(F.sqrt(F.lit(2.0**61) / F.size(e)))
    x = F.transform(e, lambda c: F.greatest(-most, F.least(most, F.floor(F.lit(float(SCALE)) * c.cast("double")))))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), x.cast("array<long>").alias("x"))
    return rows.distinct().withColumn("width", F.size("x"))


class Block:
    """Rows of one block with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")  # ties go to the smaller id without looking at it again
        self.ids, self.labels = ids[order], labels[order]
        whole = x[order]
        # Doubles hold every partial sum exactly as long as it is below 2**53, and multiply faster.
        self.most = int(np.abs(whole).max(initial=0))
        self.whole, self.quick = whole, whole.astype(np.float64)
        self.up = np.argsort(whole, axis=0, kind="stable").astype(np.int32)
        self.low = np.take_along_axis(whole, self.up, axis=0)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.most * int(np.abs(anchor).max(initial=0)) * len(anchor) < 1 << 53:
            return (self.quick[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.whole[rows] @ anchor

    def search(self, anchor: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], tuple[list, int]]) -> list:
        """``wanted`` gets rows and scores seen so far, and tells what it would take and the smallest threshold at which it is not sure yet."""
        n = len(self.ids)
        falling, rising = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, read = 0, FIRST_READ
        while True:
            to = min(at + read, n)
            fresh = np.zeros(n, bool)
            fresh[self.up[n - to : n - at, falling].ravel()] = True
            fresh[self.up[at:to, rising].ravel()] = True
            if to == n:
                fresh[:] = True  # an anchor of zeros reads no list
            new = np.flatnonzero(fresh & ~seen)
            seen[new] = True
            rows, scores = np.r_[rows, new], np.r_[scores, self.scores(new, anchor)]
            taken, unsure = wanted(rows, scores)
            if len(rows) == n:
                return taken
            last = self.low[n - to, falling] @ anchor[falling] + self.low[to - 1, rising] @ anchor[rising]
            if last < unsure:
                return taken
            at, read = to, read * 4


def _best(rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest, ties to the smaller row number."""
    if len(rows) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= least
        rows, scores = rows[near], scores[near]
    order = np.lexsort((rows, -scores))[:k]
    return rows[order], scores[order]


#: A threshold below everything: nothing unseen matters.
_ALL = -(1 << 62)


def positives_in(block: Block, anchor: np.ndarray, label: int, k: int) -> list[tuple[int, int]]:
    """(id, score) of the ``k`` best rows of the anchor's label, itself included."""

    def wanted(rows: np.ndarray, scores: np.ndarray) -> tuple[list, int]:
        own = block.labels[rows] == label
        got, value = _best(rows[own], scores[own], k)
        return list(zip(block.ids[got].tolist(), value.tolist())), int(value[-1]) if len(got) == k else _ALL

    return block.search(anchor, wanted)


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Scores ``n`` with ``low * score <= 100 * n <= high * score``."""
    return -(-low * score // 100), high * score // 100


def negatives_in(block: Block, anchor: np.ndarray, label: int, positive: list[int], k: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """(positive score, id, score) of the ``k`` best rows of other labels in the window of each positive score."""
    windows = [(p, *window_of(p, low, high)) for p in positive]

    def wanted(rows: np.ndarray, scores: np.ndarray) -> tuple[list, int]:
        other = block.labels[rows] != label
        rows, scores = rows[other], scores[other]
        out, unsure = [], 1 << 62
        for p, least, most in windows:
            inside = (scores >= least) & (scores <= most)
            got, value = _best(rows[inside], scores[inside], k)
            out += [(p, i, v) for i, v in zip(block.ids[got].tolist(), value.tolist())]
            unsure = min(unsure, int(value[-1]) if len(got) == k else least)
        return out, unsure

    return block.search(anchor, wanted)


def _met(find: Callable[[Block, np.ndarray, int, list[int]], list[tuple]], names: list[str]):
    """Arrow function over rows sorted by lot and block: ``find`` for every anchor of the lot in the block."""

    def out(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block, held = None, [], None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("width", "lot", "block"))))
            kinds, names_, labels = (batch.column(c).to_numpy() for c in ("kind", "vec_id", "label"))
            lists, positive = batch.column("x"), batch.column("positive").to_pylist()
            flat, starts = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            for i, own in enumerate(keys):
                if own != key:
                    key, parts, block = own, [], None
                x = flat[starts[i] : starts[i + 1]]
                if kinds[i] == 0:
                    parts.append((names_[i], labels[i], x))
                    continue
                if block is None and parts:
                    block = Block(*(np.array(c) for c in zip(*parts)))
                    parts = []
                if block is not None:
                    held += [(int(names_[i]), *got) for got in find(block, x, int(labels[i]), positive[i])]
                    if len(held) > HELD:
                        yield out(held)
                        held = []
        if held:
            yield out(held)

    return run


def _dealt(rows: DataFrame, blocks: DataFrame, asked: DataFrame, lots: DataFrame) -> DataFrame:
    """Every block with every lot of anchors of its width, rows before anchors."""
    spread = lambda table, name, count: F.pmod(F.xxhash64(*table), F.col(count)).cast("int").alias(name)
    counted = rows.join(blocks, "width").join(lots, "width")
    members = counted.select(
        "width", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), spread(("vec_id", "x", "label"), "block", "blocks"),
        F.lit(0).alias("kind"), "vec_id", "label", "x", F.array().cast("array<long>").alias("positive"),
    )
    counted = asked.join(blocks, "width").join(lots, "width")
    anchors = counted.select(
        "width", spread(("class",), "lot", "lots"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(1).alias("kind"), F.col("class").alias("vec_id"), "label", "x", "positive",
    )
    keys = ("width", "lot", "block")
    return members.unionByName(anchors).repartition(*keys).sortWithinPartitions(*keys, "kind")


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``vectors`` (``vec_id``, ``embedding``, ``label``) whose id ``every`` divides.

    An anchor's positives are the best ``positives`` other rows of its label; for each of them the best
    ``negatives`` rows of other labels are returned whose score is from ``low`` to ``high`` hundredths of
    the positive's. Scores are inner products of the integer vectors, higher first, ties to the smaller id. A positive
    without such rows has no answer; below zero no score is in its window. Rows without id or label,
    without a vector or with null or non-finite entries take no part, nor do empty vectors; rows equal in id,
    label and vector count once, and rows that share an id otherwise are rows of their own. Vectors
    meet those of their own width. Other columns are not read.
    """
    spark = vectors.sparkSession
    short_batches(spark)
    rows = stage(candidates(vectors), "hard-rows")
    # Of rows with one vector and label the smallest ids answer for all; the limit acts before the exchange.
    reach = max(positives + 1, negatives)
    rank = F.row_number().over(Window.partitionBy("x", "label").orderBy("vec_id"))
    firsts = stage(rows.withColumn("at", rank).filter(F.col("at") <= reach).drop("at"), "hard-firsts")
    anchors = rows.filter(F.col("vec_id") % every == 0)
    classes = stage(anchors.select("label", "x", "width").distinct().withColumn("class", F.monotonically_increasing_id()), "hard-classes")

    def counted(table: DataFrame, name: str, size: int) -> DataFrame:
        counts = stage(table.groupBy("width").agg(F.ceil(F.count("*") / size).cast("int").alias(name)), "hard-counts")
        return maybe_broadcast(counts, counts.count())

    blocks, lots = counted(firsts, "blocks", BLOCK_ROWS), counted(classes, "lots", LOT_ROWS)
    own_first = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")

    asked = classes.withColumn("positive", F.array().cast("array<long>"))
    near = _met(lambda block, x, label, _: positives_in(block, x, label, positives + 1), ["class", "vec_id", "score"])
    found = _dealt(firsts, blocks, asked, lots).mapInArrow(near, "class long, vec_id long, score long")
    found = stage(found.withColumn("at", F.row_number().over(own_first)).filter(F.col("at") <= positives + 1), "hard-positives")
    # The own row of an anchor has the score of the vector with itself; which of them it is, the id tells below.
    same = firsts.join(classes, ["x", "label", "width"]).select("class", "vec_id", F.lit(True).alias("same"))
    found = stage(found.join(same, ["class", "vec_id"], "left"), "hard-marked")

    sought = found.filter("score >= 0").groupBy("class").agg(F.collect_set("score").alias("positive"))
    asked = stage(classes.join(sought, "class"), "hard-windows")
    hard = _met(lambda block, x, label, own: negatives_in(block, x, label, own, negatives, low, high), ["class", "positive", "vec_id", "score"])
    in_window = Window.partitionBy("class", "positive").orderBy(F.desc("score"), "vec_id")
    taken = _dealt(firsts, blocks, asked, lots).mapInArrow(hard, "class long, positive long, vec_id long, score long")
    taken = taken.withColumn("rank", F.row_number().over(in_window)).filter(F.col("rank") <= negatives)

    # One row a class, with at most ``positives + 1`` times ``negatives`` answers in it, meets its anchors.
    lists = taken.groupBy("class", "positive").agg(F.collect_list(F.struct("rank", "vec_id", "score")).alias("answers"))
    held = found.join(lists, (found["class"] == lists["class"]) & (found["score"] == lists["positive"]), "left")
    held = held.groupBy(found["class"]).agg(F.sort_array(F.collect_list(F.struct("at", found["vec_id"], "same", found["score"], "answers"))).alias("found"))
    held = stage(classes.select("class", "x", "label").join(held, "class"), "hard-answers")
    each = anchors.select(F.col("vec_id").alias("anchor_id"), "x", "label").join(held.hint("merge"), ["x", "label"])
    others = F.filter("found", lambda f: ~((f["vec_id"] == F.col("anchor_id")) & F.coalesce(f["same"], F.lit(False))))
    each = each.select("anchor_id", F.explode(F.slice(others, 1, positives)).alias("p"))
    each = each.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.explode("p.answers").alias("n"))
    return each.select("anchor_id", "positive_id", F.col("n.rank").alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))
