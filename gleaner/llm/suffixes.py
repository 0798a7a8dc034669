"""Repeated passages by column-wise construction of the sorted suffixes of a collection.

The column-wise construction inserts one symbol of every member of a collection in
each round, from the right: the suffixes that begin at column ``c`` are sorted by
their first symbol and, among equals, by the order of column ``c + 1``; the common
prefix of two neighbours grows by one where the symbols agree, and is the minimum over the
old neighbours between them. The symbols read in the order of a column are that column of
the collection's Burrows-Wheeler transform. Over whole documents this takes as many rounds
as the longest has bytes, so the collection is first cut into short members:

1. Every window of ``length`` bytes has one anchor, its ``gram`` with the smallest hash.
   Windows with one anchor follow one another and make a piece. Equal windows have equal
   anchors at the same place in the window, so pieces line up by their anchors.
2. Grams that occur as an anchor once only cannot belong to a repeated window; the others' pieces
   are cut from the texts. Equal pieces are counted, then one of each goes on.
3. Pieces are dealt out and sorted by anchor. A task reads its sorted shuffle file once, front
   to back, and runs the rounds over all anchors it holds in blocks of bounded size. Neighbours
   with a common prefix of ``length`` bytes or more mark both windows as repeated.

Only aligned columns are compared, since equal windows are aligned. Anchors with more different
pieces than a block holds are not gathered: their windows are grouped by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import discard, short_batches, stored
from gleaner.llm.words import _BASE, _INVERSE, _INVERSES, _POWERS, PIECE, bytes_of, mixed

#: Bytes of a repeated string, bytes of an anchor.
LENGTH, GRAM = 200, 32

#: Pieces of a block of rounds, and most pieces of one anchor that a task gathers.
BLOCK, HOT = 4_000, 20_000

_VALUE = mixed(np.arange(1000, 1256, dtype=np.uint64) * _BASE)
_PLACE = np.uint64((1 << 20) - 1)


def anchors(data: np.ndarray, rows: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(hash, row, anchor, first window, last window) of every piece of every row; positions count from the row's start."""
    out = []
    span = length - gram + 1
    ends = rows[1:]
    for a in range(0, max(len(data) - length + 1, 0), PIECE):
        part = data[a : a + PIECE + length - 1]
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[part] * _wide(n)[0][:n], out=sums[1:])
        hashes = mixed((sums[gram:] - sums[:-gram]) * _wide(n)[1][: n - gram + 1])
        least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        reach = 1
        while reach * 2 <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: len(least) - span + reach], least[span - reach :])
        where = (least & _PLACE).astype(np.int64)
        start = np.arange(a, a + len(where))
        row = np.searchsorted(ends, start, side="right")
        valid = start + length <= ends[np.minimum(row, len(ends) - 1)]
        start, where, row = start[valid], where[valid], row[valid]
        if not len(start):
            continue
        fresh = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
        last = np.r_[fresh[1:], len(start)] - 1
        base = rows[row[fresh]]
        out.append((hashes[where[fresh]].view(np.int64), row[fresh], where[fresh] + a - base, start[fresh] - base, start[last] - base))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def _wide(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for at least ``n`` places, a little more than a piece."""
    global _POWERS_WIDE, _INVERSES_WIDE
    while len(_POWERS_WIDE) < n:
        m = len(_POWERS_WIDE) - 1
        _POWERS_WIDE = np.concatenate([_POWERS_WIDE, _POWERS_WIDE[1:] * _POWERS_WIDE[m]])
        _INVERSES_WIDE = np.concatenate([_INVERSES_WIDE, _INVERSES_WIDE[1:] * _INVERSES_WIDE[m]])
    return _POWERS_WIDE, _INVERSES_WIDE


_POWERS_WIDE, _INVERSES_WIDE = _POWERS, _INVERSES


def _found(length: int, gram: int):
    """Arrow function: texts to anchors. ``place`` holds the first window, the anchor's distance and the number of further windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, row, at, first, last = anchors(*bytes_of(batch.column("text")), length, gram)
            keys = batch.column("key").to_numpy()
            place = (first << 20) | ((at - first) << 10) | (last - first)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(keys[row], pa.int64()), pa.array(place)], ["h", "key", "place"])

    return run


_PARTS = "kind int, doc_id long, key long, n_bytes long, kept_sha256 string, body binary, h long, sid binary, off int, lo long, seg binary"


def _cut_out(length: int):
    """Arrow function: documents with their repeated anchors to finished rows (kind 0), or to the text (1) and its pieces (2)."""
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]
    names = [c.split(" ")[0] for c in _PARTS.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, key, text, found in zip(*[batch.column(c) for c in ("doc_id", "key", "text", "found")]):
                doc_id, key, body = doc_id.as_py(), key.as_py(), text.as_py().encode()
                if not found.is_valid:
                    rows.append((0, doc_id, key, len(body), hashlib.sha256(body).hexdigest(), *[None] * 6))
                    continue
                rows.append((1, doc_id, key, len(body), None, body, *[None] * 5))
                held += len(body)
                own = found.values
                for h, place in zip(own.field("h").to_pylist(), own.field("place").to_pylist()):
                    lo, off, more = place >> 20, (place >> 10) & 1023, place & 1023
                    seg = body[lo : lo + more + length]
                    if len(seg) == more + length:
                        rows.append((2, doc_id, key, None, None, None, h, xxhash.xxh3_128_digest(seg, off), off, lo, seg))
                        held += len(seg)
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return run


def repeated_windows(group: np.ndarray, off: np.ndarray, segs: list[bytes], length: int, span: int) -> np.ndarray:
    """Table (piece, column): the window that begins there also begins in another piece of its group.

    ``group`` is ascending. Column ``span - 1`` is the anchor of every piece.
    """
    n, width = len(segs), span - 1 + length
    sizes = np.array([len(s) for s in segs])
    begin = span - 1 - off
    symbols = np.zeros((width, n), np.int64)
    flat = np.frombuffer(b"".join(segs), np.uint8)
    of = np.repeat(np.arange(n), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[of]
    symbols[column, of] = flat.astype(np.int64) + 1
    base = group.astype(np.int64) * 257
    repeated = np.zeros((width, n), bool)
    order, common = np.arange(n), np.zeros(n + 1, np.int32)
    for c in range(width - 1, -1, -1):
        inserted = symbols[c][order]  # this column of the transform
        rank = base[order] + inserted
        moved = np.argsort(rank, kind="stable")
        rank = rank[moved]
        same = np.flatnonzero((rank[1:] == rank[:-1]) & (inserted[moved[1:]] > 0))
        grown = np.zeros(n + 1, np.int32)
        if len(same):
            pairs = np.empty(2 * len(same), np.int64)
            pairs[0::2], pairs[1::2] = moved[same] + 1, moved[same + 1] + 1
            grown[same + 1] = np.minimum.reduceat(common, pairs)[0::2] + 1
        order, common = order[moved], grown
        deep = np.flatnonzero(common[:n] >= length)
        if len(deep):
            repeated[c, order[deep]] = True
            repeated[c, order[deep - 1]] = True
    return repeated.T


def _columns(length: int, gram: int):
    """Arrow function over pieces sorted by anchor: runs of repeated windows of each piece."""
    span = length - gram + 1

    def runs(rows: list[tuple]) -> pa.RecordBatch:
        h = np.array([r[0] for r in rows], np.int64)
        off = np.array([r[2] for r in rows], np.int64)
        often = np.array([r[4] for r in rows], np.int64)
        count = np.array([len(r[3]) for r in rows]) - length + 1
        group = np.r_[0, np.cumsum(h[1:] != h[:-1])]
        flags = np.zeros((len(rows), span - 1 + length), bool)
        company = np.flatnonzero(np.bincount(group)[group] > 1)
        if len(company):
            flags[company] = repeated_windows(group[company], off[company], [rows[i][3] for i in company], length, span)
        for i in np.flatnonzero(often > 1):
            flags[i, span - 1 - off[i] : span - 1 - off[i] + count[i]] = True
        edges = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, first = np.nonzero(edges == 1)
        _, after = np.nonzero(edges == -1)
        shift = (span - 1 - off)[row]
        return pa.RecordBatch.from_arrays(
            [pa.array(h[row]), pa.array([rows[i][1] for i in row], pa.binary()), pa.array(first - shift), pa.array(after - 1 - shift)],
            ["h", "sid", "first", "last"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("h", "sid", "off", "seg", "n")]):
                if len(rows) >= BLOCK and row[0] != rows[-1][0]:
                    yield runs(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield runs(rows)

    return run


def _without_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, body, spans in zip(*[batch.column(c) for c in ("doc_id", "body", "spans")]):
            body, merged = body.as_py(), []
            if spans.is_valid:
                own = spans.values
                for a, b in sorted(zip(own.field("a").to_pylist(), own.field("b").to_pylist())):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
            digest, at = hashlib.sha256(), 0
            for a, b in merged:
                digest.update(body[at:a])
                at = b
            digest.update(body[at:])
            out.append((doc_id.as_py(), len(body), sum(b - a for a, b in merged), len(merged), digest.hexdigest()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _hot_windows(pieces: DataFrame, length: int) -> DataFrame:
    """Runs of one window each for anchors with too many pieces to gather: windows meet by their bytes."""
    each = pieces.withColumn("first", F.explode(F.sequence(F.lit(0), F.length("seg") - length)))
    each = each.select("h", "sid", "n", F.col("first").cast("long").alias("first"), F.expr(f"substring(seg, CAST(first AS INT) + 1, {length})").alias("window"))
    often = stored(each.groupBy("window").agg(F.sum("n").alias("often")).filter("often > 1").select("window"), "suffix-hot")
    return each.join(often, "window").select("h", "sid", "first", F.col("first").alias("last"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs`` (``doc_id``, ``text``).

    A text is its UTF-8 bytes, null is empty. A byte goes where a string of
    ``length`` bytes covers it that also starts elsewhere in the table, in the same
    row or another, repeated rows included; no string crosses rows. Shorter texts stay
    whole. ``gram < length <= 1000``.
    """
    spark = docs.sparkSession
    short_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.xxhash64(F.col("doc_id"), text)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), text.alias("text"))
    found = stored(plain.mapInArrow(_found(length, gram), "h long, key long, place long"), "suffix-anchors")
    often = stored(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "suffix-often")
    listed = found.join(often, "h").groupBy("key").agg(F.collect_set(F.struct("h", "place")).alias("found"))
    listed = stored(listed, "suffix-listed")
    discard(found, often)
    # Rows that share a key by chance get each other's anchors too, which only adds pieces to compare.
    parts = stored(plain.join(listed, "key", "left").mapInArrow(_cut_out(length), _PARTS), "suffix-parts")
    discard(listed)
    pieces = parts.filter("kind = 2")
    distinct = stored(pieces.groupBy("h", "sid", "off", "seg").agg(F.count("*").alias("n")), "suffix-pieces")
    hot = stored(distinct.groupBy("h").agg(F.count("*").alias("m")).filter(F.col("m") > HOT).select("h"), "suffix-heavy")
    usual = distinct
    some_hot = not hot.isEmpty()
    if some_hot:
        usual = distinct.join(hot, "h", "left_anti")
    ordered = usual.repartition("h").sortWithinPartitions("h")
    runs = ordered.mapInArrow(_columns(length, gram), "h long, sid binary, first long, last long")
    if some_hot:
        runs = runs.unionByName(_hot_windows(distinct.join(hot, "h", "left_semi"), length))
    runs = stored(runs, "suffix-runs")
    discard(distinct, hot)
    spans = pieces.select("doc_id", "key", "h", "sid", "lo").join(runs, ["h", "sid"])
    span = F.struct((F.col("lo") + F.col("first")).alias("a"), (F.col("lo") + F.col("last") + length).alias("b"))
    spans = spans.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_set(span).alias("spans"))
    bodies = parts.filter("kind = 1").select("doc_id", "key", "body")
    cut = bodies.join(spans, bodies["doc_id"].eqNullSafe(spans["_id"]) & (bodies["key"] == spans["_key"]), "left")
    cut = cut.select("doc_id", "body", "spans").mapInArrow(_without_spans, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    whole = parts.filter("kind = 0").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256")
    return whole.unionByName(cut)
