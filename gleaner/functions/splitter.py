"""Overlapping text chunks with start offsets.

A text is cut at the coarsest separator it contains; every separator stays at
the start of the piece it precedes, so pieces tile the text without gaps.
Neighbouring short pieces are packed into windows of at most ``size``
characters that share up to ``overlap`` characters with the window before; a
piece of ``size`` or more is cut again with the finer separators. Everything is
kept as ``(start, end)`` offsets into the one text, strings are cut only at the
end. Spark sees one Arrow function: text column in, array of chunks out.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import schemas as S
from gleaner.functions.text import WHITESPACE
from gleaner.session import bound_batches

# --- Fixed values -----------------------------------------------------------
SEPARATORS = ("\n\n", "\n", " ", "")
# ----------------------------------------------------------------------------

CHUNK_TYPE = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("chunk", T.StringType())])
)
_ARROW_ITEM = pa.struct([("start", pa.int64()), ("chunk", pa.string())])


def _edges(text: str, lo: int, hi: int, separator: str) -> Iterator[int]:
    """Ends of the pieces of ``text[lo:hi]``, each separator opening a piece."""
    at = text.find(separator, lo, hi)
    while at >= 0:
        if at > lo:
            yield at
        at = text.find(separator, at + len(separator), hi)
    yield hi


def _characters(lo: int, hi: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Windows over single characters, without listing them."""
    keep = min(overlap, size - 1)
    while hi - lo > size:
        yield lo, lo + size
        lo += size - keep
    yield lo, hi


def _ranges(
    text: str, lo: int, hi: int, separators: tuple[str, ...], size: int, overlap: int
) -> Iterator[tuple[int, int]]:
    """Ranges of the chunks; only the edges of the open window are held."""
    level = next((i for i, s in enumerate(separators) if s == "" or text.find(s, lo, hi) >= 0), len(separators) - 1)
    separator, finer = separators[level], separators[level + 1 :]
    if separator == "":
        yield from _characters(lo, hi, size, overlap)
        return
    window = deque([lo])
    left = lo
    for right in _edges(text, lo, hi, separator):
        if right - left < size:
            if right - window[0] > size and len(window) > 1:
                yield window[0], left
                while len(window) > 1 and (left - window[0] > overlap or right - window[0] > size):
                    window.popleft()
            window.append(right)
        else:
            if len(window) > 1:
                yield window[0], left
            if finer:
                yield from _ranges(text, left, right, finer, size, overlap)
            else:
                yield left, right
            window = deque([right])
        left = right
    if len(window) > 1:
        yield window[0], hi


def split_text(
    text: str | None,
    size: int = S.CHUNK_SIZE,
    overlap: int = S.CHUNK_OVERLAP,
    separators: tuple[str, ...] = SEPARATORS,
) -> list[tuple[int, str]]:
    """``(start, chunk)`` pairs; chunks are stripped and never blank."""
    if not text:
        return []
    out = []
    for lo, hi in _ranges(text, 0, len(text), separators, size, overlap):
        body = text[lo:hi].lstrip(WHITESPACE)
        start = hi - len(body)
        body = body.rstrip(WHITESPACE)
        if body:
            out.append((start, body))
    return out


class Stretch:
    """A stretch of a long text, with enough around it to cut it as the whole text would be cut.

    ``text`` starts at ``offset`` of the whole and at a line break or at its start.
    ``blank_lines`` tells whether the whole contains the coarsest separator. Pieces
    of the whole text are known here once ``size`` characters around them are: those
    between blank lines that are shorter than ``size`` stay whole, longer ones are cut
    into lines. A window never crosses from one of these kinds to the other, and where
    it starts decides where the next one starts.
    """

    def __init__(self, text: str, offset: int, ends: bool, blank_lines: bool, size: int = S.CHUNK_SIZE, overlap: int = S.CHUNK_OVERLAP):
        self.text, self.offset, self.ends, self.size, self.overlap = text, offset, ends, size, overlap
        self.starts: list[int] = []
        self.fresh: list[bool] = []
        outer = [0, *_edges(text, 0, len(text), SEPARATORS[0])] if blank_lines else [0, len(text)]
        long_before = True
        for i, (lo, hi) in enumerate(zip(outer, outer[1:])):
            cut_off = not blank_lines or (i == 0 and offset > 0) or (i == len(outer) - 2 and not ends)
            is_long = cut_off or hi - lo >= size
            inside = [lo, *_edges(text, lo, hi, SEPARATORS[1])][:-1] if is_long else [lo]
            for n, at in enumerate(inside):
                self.starts.append(at)
                self.fresh.append(n == 0 and (is_long or long_before))
            long_before = is_long
        self.stops = [*self.starts[1:], len(text)]

    def step(self, i: int) -> tuple[int, tuple[int, int] | None, int | None]:
        """From the window that starts at piece ``i``: where the next starts, the window's range, a piece to cut finer."""
        n = len(self.starts)
        j = i
        while j < n:
            if j > i and self.fresh[j]:
                return j, (self.starts[i], self.starts[j]), None
            if self.stops[j] - self.starts[j] >= self.size:
                return j + 1, (self.starts[i], self.starts[j]) if j > i else None, j
            if j > i and self.stops[j] - self.starts[i] > self.size:
                first = i
                while first < j and (
                    self.starts[j] - self.starts[first] > self.overlap or self.stops[j] - self.starts[first] > self.size
                ):
                    first += 1
                return first, (self.starts[i], self.starts[j]), None
            j += 1
        return n, (self.starts[i], len(self.text)), None

    def chunks_from(self, i: int) -> tuple[int, list[str]]:
        """Where the next window starts, and the stripped chunks before that."""
        after, window, long = self.step(i)
        ranges = [window] if window else []
        if long is not None:
            ranges += _ranges(self.text, self.starts[long], self.stops[long], SEPARATORS[2:], self.size, self.overlap)
        bodies = [self.text[lo:hi].strip(WHITESPACE) for lo, hi in ranges]
        return after, [b for b in bodies if b]


def chunks(
    col: Column | str, size: int = S.CHUNK_SIZE, overlap: int = S.CHUNK_OVERLAP, spark: SparkSession | None = None
) -> Column:
    """Array of ``struct(start, chunk)`` for a text column, in Arrow batches that are bounded in rows and bytes.

    ``spark`` is the session of the rows: its settings size the batches, and it need not be the active one.
    """
    bound_batches(spark or SparkSession.active())

    @F.arrow_udf(CHUNK_TYPE)
    def split_batch(texts: pa.Array) -> pa.Array:
        offsets, starts, bodies = [0], [], []
        for value in texts:
            for start, body in split_text(value.as_py(), size, overlap):
                starts.append(start)
                bodies.append(body)
            offsets.append(len(starts))
        items = pa.StructArray.from_arrays(
            [pa.array(starts, pa.int64()), pa.array(bodies, pa.string())], fields=list(_ARROW_ITEM)
        )
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)

    return split_batch(F.col(col) if isinstance(col, str) else col)
