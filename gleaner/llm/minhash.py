"""Near duplicates by bottom-k sketches from one hash function.

A document's sketch is the ``KEPT`` smallest hashes of its shingle set. Sets that
are equal meet by digest first and go on as one. Retained values form inverted
lists. Two sets of the wanted similarity share most retained values, so a set only
enters the lists of its rarest ones (as many as it could lack, and one more), and
the lists of very common values stay short: only a set that consists of such values for
the greater part is in them. Sets that lists connect are compared in blocks of bounded
size: the values that two sketches share estimate the similarity over the sketch of the
union, and pairs above the margin are confirmed on the full sets. A task passes on only as many
links as join what belongs together, so the links do not grow with the square of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import mark, maybe_broadcast, short_batches, stored
from gleaner.llm.components import components
from gleaner.llm.exact import without
from gleaner.llm.words import shingle_sets
from gleaner.session import stage

#: Hashes of a sketch. Margin: an estimate this far below the wanted similarity still counts; for a pair just
#: at 0.8 the chance to share fewer than half of 64 retained values is below one in ten million.
KEPT, MARGIN = 64, 0.3

#: Sets of a block, and most sets that are compared together because lists connect them.
BLOCK, TOGETHER = 512, 8_192

#: Cost of a cell of the table that compares all sets at once, against that of a value in the comparison of two.
TABLE_COST = 0.01


def _sketches(words: int, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([s[:kept].view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "mark", "n", "same", "sketch"],
            )

    return run


def _full(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["row", "full"]
            )

    return run


def least_shared(percent: int, kept: int):
    """Column: retained values that a set of ``n`` shingles shares with any set of the wanted similarity.

    Up to ``kept`` shingles the sketch is the set, and the count is certain; beyond, it holds but for the margin's chance.
    """
    t = percent / 100
    return F.when(F.col("n") <= kept, F.ceil(F.col("n") * max(2 - 1 / t, 0.0) - 1e-9)).otherwise(F.lit(int(kept * max(t - MARGIN, 0.1)))).cast("int")


def _table(sets: list[np.ndarray], columns: int) -> Iterator[np.ndarray]:
    """0/1 tables of the sets over the values that more than one holds, a bounded number of columns at a time."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    held = np.flatnonzero(count[at] > 1)
    held = held[np.argsort(at[held], kind="stable")]
    if not len(held):
        return
    column = np.cumsum(np.r_[0, np.diff(at[held]) > 0])
    for first in range(0, int(column[-1]) + 1, columns):
        lo, hi = np.searchsorted(column, (first, first + columns))
        table = np.zeros((len(sets), columns), np.float32)
        table[owner[held[lo:hi]], column[lo:hi] - first] = 1
        yield table


def _shared(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Number of common values of every two sets."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    for table in _table(sets, columns):
        out += table @ table.T
    return out


def linked_pairs(full: list[np.ndarray], block: np.ndarray, percent: int, kept: int) -> list[tuple[int, int]]:
    """Links between rows of a block (or of two, then only across), as few as join what belongs together.

    The overlap of two sketches below the smaller of their largest values
    estimates the similarity; pairs above the margin are confirmed on the full sets.
    """
    margin = max(percent / 100 - MARGIN, 0.1)
    size = np.array([len(s) for s in full], np.int64)
    sketch = [s[:kept] for s in full]
    last = np.array([s[-1] if len(f) > kept else np.uint64(2**64 - 1) for s, f in zip(sketch, full)], np.uint64)
    below = np.stack([np.searchsorted(s, last, side="right") for s in sketch]).astype(np.float32)
    shared = _shared(sketch)
    union = np.maximum(below + below.T - shared, 1)
    good = shared >= margin * union - 1e-3
    good &= np.minimum.outer(size, size) * 100 >= percent * np.maximum.outer(size, size)
    if block.min() != block.max():
        good &= block[:, None] != block[None, :]
    one, two = np.nonzero(np.triu(good, 1))
    if not len(one):
        return []
    # The likeliest first: what they join need not be compared again.
    order = np.argsort(-(shared / union)[one, two], kind="stable")
    one, two = one[order], two[order]
    rows = np.unique(np.concatenate([one, two]))
    counted = None
    common = np.unique(np.concatenate([full[i] for i in rows]), return_counts=True)[1]
    if len(rows) ** 2 * int((common > 1).sum()) * TABLE_COST <= (size[one] + size[two]).sum():
        place = np.full(len(full), -1)
        place[rows] = np.arange(len(rows))
        counted = _shared([full[i] for i in rows])[place[one], place[two]].astype(np.int64)
    parent = list(range(len(full)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for n, (i, j) in enumerate(zip(one.tolist(), two.tolist())):
        a, b = root(i), root(j)
        if a == b:
            continue
        both = len(np.intersect1d(full[i], full[j], assume_unique=True)) if counted is None else int(counted[n])
        if both * 100 >= percent * (int(size[i]) + int(size[j]) - both):
            parent[a] = b
            out.append((i, j))
    return out


def _links_in_blocks(percent: int, kept: int):
    """Arrow function over rows sorted by group and block pair: confirmed links."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        number = np.array([r[0] for r in rows], np.int64)
        pairs = linked_pairs([r[2] for r in rows], np.array([r[1] for r in rows]), percent, kept)
        one, two = number[[p[0] for p in pairs]], number[[p[1] for p in pairs]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            sets = batch.column("full")
            flat, where = sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy()
            for n, (*own, row, block) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("by_list", "key", "i", "j", "row", "block")])):
                if own != key:
                    if len(rows) > 1:
                        yield links(rows)
                    key, rows = own, []
                rows.append((row, block, flat[where[n] : where[n + 1]].copy()))
        if len(rows) > 1:
            yield links(rows)

    return run


def groups(docs: DataFrame, words: int = 5, percent: int = 80, kept: int = KEPT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, mark`` for every row of ``docs`` (``doc_id``, ``text``).

    Words are runs free of blanks, with A-Z lowered; a row's set holds its
    distinct shingles of ``words`` words, or its whole sequence if that is
    shorter; null and blank texts have an empty set and no links. Rows are linked when
    100 * intersection >= ``percent`` * union (50 < ``percent`` <= 100).
    ``component_id`` is the smallest id reachable, null ids aside. Rows that
    repeat an id and a text are one document and carry the same decision.
    """
    spark = docs.sparkSession
    short_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stage(
        plain.mapInArrow(_sketches(words, kept), "doc_id long, mark long, n long, same binary, sketch array<long>")
        .withColumn("row", F.monotonically_increasing_id()),
        "near-rows",
    )
    # Equal sets go on as their first row.
    classes = stage(
        rows.filter("n > 0").groupBy("same", "n").agg(F.min("row").alias("class"), F.min("doc_id").alias("least")), "near-classes"
    )
    firsts = rows.select("row", "n", "sketch").join(classes.select(F.col("class").alias("row")), "row", "left_semi")
    firsts = stage(firsts, "near-firsts")

    values = firsts.select("row", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("v"))
    common = stage(values.groupBy("v").agg(F.count("*").alias("often")).filter("often > 1"), "near-common")
    shared = values.join(common, "v")
    own = Window.partitionBy("row")
    rank = F.row_number().over(own.orderBy("often", "v"))
    lone = F.col("size") - F.count("*").over(own)
    posted = shared.withColumn("rank", rank).withColumn("lone", lone)
    posted = posted.filter(F.col("lone") + F.col("rank") <= F.col("size") - least_shared(percent, kept) + 1)
    posted = stage(posted.select("v", "row", "n"), "near-lists")

    lists = stage(posted.groupBy("v").agg(F.min("row").alias("head"), F.count("*").alias("length")).filter("length > 1"), "near-heads")
    listed = posted.join(lists, "v")
    # What lists connect is compared together, each set being sent once; what they connect beyond a bound, list by list.
    hung = components(listed.filter("row <> head").select(F.col("head").alias("a"), F.col("row").alias("b")).distinct())
    members = listed.select("row").distinct().join(hung, F.col("row") == F.col("node"), "left").select("row", F.coalesce("root", "row").alias("key"))
    members = stage(members, "near-members")
    sizes = stage(members.groupBy("key").agg(F.count("*").alias("length")), "near-sizes")
    counted = members.join(sizes, "key")
    keyed = counted.filter(F.col("length") <= TOGETHER).select("row", "key", "length", F.lit(False).alias("by_list"))
    wide = counted.filter(F.col("length") > TOGETHER).select("row")
    by_list = listed.join(wide, "row", "left_semi").select("row", F.col("v").alias("key"), "length", F.lit(True).alias("by_list"))
    keyed = keyed.unionByName(by_list)

    texts = rows.join(members, "row", "left_semi").select("row", F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    texts = stage(texts, "near-listed")
    texts = maybe_broadcast(texts, texts.count())
    found = plain.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    sets = found.select("row", "text").mapInArrow(_full(words), "row long, full array<long>")
    sets = stored(sets.dropDuplicates(["row"]), "near-sets")

    blocks = F.ceil(F.col("length") / BLOCK).cast("int")
    keyed = keyed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    dealt = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "by_list", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "row", "block"
    )
    pair = ["by_list", "key", "i", "j"]
    dealt = dealt.join(sets, "row").repartition(*pair).sortWithinPartitions(*pair)
    labels = components(stage(dealt.mapInArrow(_links_in_blocks(percent, kept), "a long, b long"), "near-links"))

    placed = classes.join(labels, classes["class"] == labels["node"], "left").withColumn("label", F.coalesce("root", "class"))
    placed = stage(placed.select("same", "n", "label", "least"), "near-placed")
    smallest = placed.groupBy("label").agg(F.min("least").alias("component"))
    ids = placed.join(smallest, "label").select("same", "n", "component")
    told = rows.select("doc_id", "mark", "n", "same").join(ids, ["same", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return told.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "mark"
    )


def drop_near(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document left of every group of near duplicates, columns unchanged.

    The smallest id stays, with every row that repeats its id and text.
    """
    decided = groups(docs, words, percent).filter("NOT kept").select("doc_id", "mark").distinct()
    return without(docs, stage(decided, "near-dropped"))
