"""Near duplicates by 64-bit fingerprints, found through tables of distances to reference fingerprints.

Every distinct fingerprint gets its Hamming distances to ``PIVOTS`` reference fingerprints. Two
fingerprints that differ in few bits have nearly equal distances to every reference, so a pair with a
larger difference in any column of the table is discarded; survivors are verified bit by bit.

Distances of 64-bit codes to references lie close together (a column alone lets nearly half of all pairs
pass), so pairs are only looked at inside groups that hold every link: the bits are cut into one run more
than two linked fingerprints may differ in, and so they agree in at least one whole run. A group
that is too large is cut again by runs of the remaining bits, until it is small; at the last
level so few bits remain that a group cannot be large.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import mark, short_batches
from gleaner.llm.components import components
from gleaner.session import stage

#: Reference fingerprints, drawn with this seed; seed of the shingle hash.
PIVOTS, PIVOT_SEED, HASH_SEED = 32, 20, 42

#: Bits of the remaining ones by which a group may still differ when it is no longer cut; rows of a group that is not cut.
LAST_BITS = 12
GROUP = 1 << LAST_BITS

#: Bytes of a text that are cut into words at once, and rows compared at once (whole groups, hence up to ``GROUP`` more).
PIECE, ROWS = 1 << 20, 1 << 15

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(text: bytes, words: int = 3) -> int:
    """Bits set in over half of the hashes of all shingles of ``words`` words, A-Z lowered; 0 without words.

    A text with fewer words has one shingle, the whole sequence. The text is cut piece by piece, so
    memory beside it does not grow with the number of its words.
    """
    digest, counts, total, held, at = xxhash.xxh64_digest, np.zeros(64, np.int64), 0, [], 0
    while at < len(text) or held is not None:
        if at < len(text):
            blank = _BLANK.search(text, at + PIECE)
            end = blank.start() if blank else len(text)
            held += text[at:end].lower().split()
            at = end
        last = at >= len(text)
        if len(held) >= words or (last and held and not total):
            joined = b" ".join(held)
            ends = np.cumsum([len(w) + 1 for w in held])
            span = min(words, len(held))
            starts = np.r_[0, ends[: len(held) - span]].tolist()
            found = b"".join([digest(joined[a:b], HASH_SEED) for a, b in zip(starts, (ends[span - 1 :] - 1).tolist())])
            counts += np.unpackbits(np.frombuffer(found, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            total += len(starts)
            held = held[len(held) - words + 1 :] if words > 1 else []
        if last:
            held = None
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big") if total else 0


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
            prints = np.array([fingerprint(memoryview(v.as_buffer()).tobytes(), words) for v in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(prints.view(np.int64))], ["doc_id", "mark", "print"])

    return run


def references(count: int) -> np.ndarray:
    return np.random.default_rng(PIVOT_SEED).integers(0, 2**64, count, dtype=np.uint64)


def distances(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """A row of Hamming distances to the references for each of ``prints``."""
    return np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)


def _tabled(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = references(count)
        for batch in batches:
            table = distances(batch.column("print").to_numpy().view(np.uint64), pivots)
            yield pa.RecordBatch.from_arrays([batch.column("print"), pa.array([r.tobytes() for r in table], pa.binary())], ["print", "distances"])

    return run


def close_pairs(group: np.ndarray, prints: np.ndarray, table: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Links between rows of one group, as few as join what belongs together, as two lists of row numbers.

    Rows are in the order of (group, first column of the ``table``). Row ``i`` meets the rows after it until
    the first column alone discards a row; the other columns discard most of the rest.
    """
    columns = np.ascontiguousarray(table.T)
    label = np.arange(len(group))
    one, two = [], []
    at, step = np.arange(len(group)), 0
    while True:
        step += 1
        at = at[at + step < len(group)]
        other = at + step
        at = at[(group[other] == group[at]) & (columns[0][other] - columns[0][at] <= most)]
        if not len(at):
            return one, two
        left = at[label[at] != label[at + step]]
        for column in columns[1:]:
            left = left[np.abs(column[left + step] - column[left]) <= most]
        left = left[np.bitwise_count(prints[left] ^ prints[left + step]) <= most]
        if len(left):
            parent = {}

            def root(x: int) -> int:
                while x in parent:
                    x = parent[x]
                return x

            for i in left.tolist():
                a, b = root(int(label[i])), root(int(label[i + step]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    one.append(i)
                    two.append(i + step)
            # Labels are row numbers, so a table of them moves every row at once.
            moved = np.arange(len(group))
            for x in parent:
                moved[x] = root(x)
            label = moved[label]


def _linked(most: int, count: int):
    """Arrow function over rows sorted by group: links inside the groups."""

    def links(parts: list[tuple]) -> pa.RecordBatch:
        masks, values, prints, table = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((table[:, 0], values, masks))
        masks, values, prints, table = masks[order], values[order], prints[order], table[order]
        group = np.cumsum(np.r_[0, (masks[1:] != masks[:-1]) | (values[1:] != values[:-1])])
        one, two = close_pairs(group, prints.view(np.uint64), table, most)
        return pa.RecordBatch.from_arrays([pa.array(prints[one], pa.int64()), pa.array(prints[two], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            masks, values, prints = (batch.column(c).to_numpy() for c in ("mask", "value", "print"))
            table = np.frombuffer(b"".join(batch.column("distances").to_pylist()), np.int8).reshape(-1, count)
            if size >= ROWS:
                # What belongs to the group that was open goes with it.
                new = (masks != held[-1][0][-1]) | (values != held[-1][1][-1])
                cut = int(np.argmax(new)) if new.any() else len(masks)
                held.append((masks[:cut], values[:cut], prints[:cut], table[:cut]))
                masks, values, prints, table = masks[cut:], values[cut:], prints[cut:], table[cut:]
                if len(masks):
                    yield links(held)
                    held, size = [], 0
            if len(masks):
                held.append((masks, values, prints, table))
                size += len(masks)
        if held:
            yield links(held)

    return run


def runs_of(mask: int, pieces: int) -> list[int]:
    """``mask`` with one run more of the bits it does not hold, for each of ``pieces`` runs."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in own.tolist()) for own in np.array_split(np.array(free), pieces)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(prints: DataFrame, most: int = 3, pivots: int = PIVOTS) -> DataFrame:
    """``a, b``: pairs of the distinct longs in ``print`` that differ in at most ``most`` bits, enough of them to join whatever belongs together."""
    spark = prints.sparkSession
    state = stage(prints.select("print").mapInArrow(_tabled(pivots), "print long, distances binary").withColumn("mask", F.lit(0).cast("long")), "sim-tables")
    masks, found = [0], []
    while True:
        cut = [(m, child) for m in masks for child in runs_of(m, most + 1)]
        last = min(64 - child.bit_count() for _, child in cut) <= LAST_BITS
        # As many rows as the runs chosen so far can be combined; the levels are few.
        children = spark.createDataFrame([(_signed(m), _signed(c)) for m, c in cut], "mask long, child long")
        rows = state.join(F.broadcast(children), "mask").select("print", "distances", F.col("child").alias("mask"))
        if len(masks) > 1:
            rows = rows.dropDuplicates(["print", "mask"])  # runs chosen in another order may hold the same bits
        rows = rows.withColumn("value", F.col("print").bitwiseAND(F.col("mask")))
        sizes = stage(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).filter("n > 1"), "sim-sizes")
        company = rows.join(sizes.hint("merge"), ["mask", "value"])  # stored, so that the join can split a large group
        small = company if last else company.filter(F.col("n") <= GROUP)
        dealt = small.select("mask", "value", "print", "distances").repartition("mask", "value").sortWithinPartitions("mask", "value")
        found.append(stage(dealt.mapInArrow(_linked(most, pivots), "a long, b long"), "sim-links"))
        if last or sizes.filter(F.col("n") > GROUP).isEmpty():
            break
        state = stage(company.filter(F.col("n") > GROUP).select("print", "distances", "mask"), "sim-large")
        masks = sorted({child for _, child in cut})
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def groups(docs: DataFrame, words: int = 3, most: int = 3, pivots: int = PIVOTS) -> DataFrame:
    """``doc_id, fingerprint, component_id, mark`` for every row of ``docs`` (``doc_id``, ``text``).

    Words are runs free of blanks, with A-Z lowered; all shingles of ``words`` words count, repeats
    included. Null, empty and blank texts have the fingerprint zero and are linked like any other.
    Fingerprints that differ in at most ``most`` bits are linked; ``component_id`` is the smallest id
    reachable, null ids aside (null where a component has no other). Every row is answered, rows that
    repeat an id too. Other columns are not read.
    """
    short_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"), "text")
    rows = stage(plain.mapInArrow(_prints(words), "doc_id long, mark long, print long"), "sim-rows")
    classes = stage(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "sim-classes")
    labels = components(links(classes, most, pivots))
    placed = stage(classes.join(labels, classes["print"] == labels["node"], "left").select("print", "least", F.coalesce("root", "print").alias("label")), "sim-placed")
    smallest = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = stage(placed.join(smallest, "label").select("print", "component_id"), "sim-ids")
    told = rows.join(ids.hint("merge"), "print")
    return told.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "mark")
