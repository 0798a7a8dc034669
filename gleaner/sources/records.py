"""Records of CSV files whose quotes hold line breaks, read range by range.

A range of a file cannot tell by itself whether it begins inside quotes. So every
range is read once as a map: the state it ends in, for each of the two it may begin in.
The maps (one row per range) are followed file by file, which tells the ranges that begin
inside quotes, and in a second pass each range cuts its own records. A record that runs over
the end of a range comes in pieces and is put together by the range it begins in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators.sizes import broadcast_if_small
from gleaner.session import stage

# From inside quotes to behind the closing one; a doubled quote is a character.
_CLOSING = re.compile(rb'(?:[^"]++|"")*+"')

# A record inside a range, one that begins there and goes on, its last piece, a range in the middle of it.
WHOLE, BEGINS, ENDS, BETWEEN = range(4)

_HELD = 4 << 20
_PARALLEL = "spark.sql.files.minPartitionNum"


def ends_open(line: bytes, inside: bool) -> bool:
    """Whether quotes are open behind ``line``, which begins inside quotes or with a new record.

    Only a quote that a field begins with opens; what follows a closing quote
    up to the next comma is text.
    """
    at = 0
    while True:
        if inside or line[at : at + 1] == b'"':
            close = _CLOSING.match(line, at if inside else at + 1)
            if close is None:
                return True
            inside, at = False, line.find(b",", close.end()) + 1
            if not at:
                return False
        else:
            at = line.find(b',"', at) + 1
            if not at:
                return False


def _lines(value: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Lines of what stands between two line feeds, with their ends; a carriage return ends one as well."""
    if b"\r" not in value:
        yield value, b"\n"
        return
    *head, last = value.split(b"\r")
    for line in head if last else head[:-1]:
        yield line, b"\r"
    yield (last, b"\n") if last else (head[-1], b"\r\n")


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, start, from_text, from_quotes`` of every range: whether it ends inside quotes."""
    key, states, out = None, (False, True), []

    def emitted() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["path", "start", "from_text", "from_quotes"])

    for batch in batches:
        for path, start, value in zip(*[batch.column(c).to_pylist() for c in ("path", "start", "value")]):
            if (path, start) != key:
                if key is not None:
                    out.append((*key, *states))
                key, states = (path, start), (False, True)
            if b'"' in value:
                for line, _ in _lines(value):
                    first = ends_open(line, states[0])
                    states = first, first if states[0] == states[1] else ends_open(line, states[1])
    if key is not None:
        out.append((*key, *states))
    if out:
        yield emitted()


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges in file order to ``path, start`` of those that begin inside quotes."""
    file, inside = None, False
    for batch in batches:
        out = []
        for path, start, *ends in zip(*[batch.column(c).to_pylist() for c in ("path", "start", "from_text", "from_quotes")]):
            if path != file:
                file, inside = path, False
            if inside:
                out.append((path, start))
            inside = ends[inside]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64())], ["path", "start"])


def _cut(begin_inside: set[tuple[str, int]]):
    """Arrow function: lines of ranges to ``path, start, n, kind, record``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, going_on, held, n = None, False, False, [], 0
        out: list[tuple] = []
        size = 0

        def put(kind: int, record: bytes) -> None:
            nonlocal n, size
            out.append((*key, n, kind, record.decode("utf-8", "replace")))
            n, size = n + 1, size + len(record)

        def leave() -> None:
            if inside and held:
                put(BETWEEN if going_on else BEGINS, b"".join(held))

        def emitted() -> pa.RecordBatch:
            nonlocal out, size
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["path", "start", "n", "kind", "record"])
            out, size = [], 0
            return batch

        for batch in batches:
            for path, start, value in zip(*[batch.column(c).to_pylist() for c in ("path", "start", "value")]):
                if (path, start) != key:
                    if key is not None:
                        leave()
                    key, held, n = (path, start), [], 0
                    inside = going_on = key in begin_inside
                    if start == 0:
                        value = value.removeprefix(b"\xef\xbb\xbf")
                for line, end in _lines(value):
                    # Without a quote in the line nothing changes.
                    inside = ends_open(line, inside) if b'"' in line else inside
                    held.append(line)
                    if inside:
                        held.append(end)
                        continue
                    if going_on or len(held) > 1 or line:
                        put(ENDS if going_on else WHOLE, b"".join(held))
                    going_on, held = False, []
                if size > _HELD:
                    yield emitted()
        if key is not None:
            leave()
        if out:
            yield emitted()

    return run


@contextmanager
def _same_ranges(spark: SparkSession):
    """Both passes cut the files alike, also when executors come or go between them."""
    before = spark.conf.get(_PARALLEL, None)
    if before is None:
        spark.conf.set(_PARALLEL, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PARALLEL)


def quoted_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, start, n, record, header``: the records of CSV files as text; ``(start, n)`` rises in file order, a file's first record is its header.

    ``path`` is as Spark names it. Empty lines between records are left out;
    a carriage return ends a line as a line feed does. A quote that is never closed takes the rest of
    its file, as one record. Bytes that are not UTF-8 are replaced. Only names and places of ranges
    that begin inside quotes pass the driver.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value")
    )
    with _same_ranges(spark):
        maps = lines.mapInArrow(_maps, "path string, start long, from_text boolean, from_quotes boolean")
        ordered = maps.repartition("path").sortWithinPartitions("path", "start")
        begin = {tuple(r) for r in ordered.mapInArrow(_followed, "path string, start long").collect()}
        cut = stage(lines.mapInArrow(_cut(begin), "path string, start long, n long, kind int, record string"), "records", compression="zstd")
    # One row per file, from the places alone.
    heads = cut.where(F.col("kind").isin(WHOLE, BEGINS)).groupBy(F.col("path").alias("_file")).agg(F.min(F.struct("start", "n")).alias("_head"))
    own = Window.partitionBy("path").orderBy("start", "n")
    pieces = cut.where(F.col("kind") != WHOLE)
    first = F.max(F.when(F.col("kind") == BEGINS, F.struct("start", "n"))).over(own)
    pieces = pieces.withColumn("first", first).groupBy("path", "first").agg(F.sort_array(F.collect_list(F.struct("start", "n", "record"))).alias("pieces"))
    joined = F.array_join(F.transform("pieces", lambda p: p["record"]), "")
    pieces = pieces.select("path", "first.start", "first.n", joined.alias("record"))
    whole = cut.where(F.col("kind") == WHOLE).select("path", "start", "n", "record").unionByName(pieces)
    marked = whole.join(broadcast_if_small(heads), F.col("path") == F.col("_file"))
    return marked.select("path", "start", "n", "record", (F.struct("start", "n") == F.col("_head")).alias("header"))
