"""Token sequences of bounded length, packed by bounded-space online best-fit."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import mark, short_batches
from gleaner.session import stage

#: Tokens of a sequence, bins kept open by a packer, pieces a packer gets.
LENGTH, OPEN_BINS, PACKER_PIECES = 2048, 4096, 200_000

#: Id that ends a document.
END = 0

#: The tokenizer, and the rank file of its vocabulary.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def encoder(ranks: str | None = None, tokenizer: str | None = None):
    """The byte-level tokenizer with 50,257 ids, three times as fast by its rank file.

    ``tokenizer`` and ``ranks``: paths of the two files, by default those of the installed ones. The ids
    are those of ``tokenizer`` with ``add_special_tokens=False``: nothing is added to a text, and where a
    text holds the string of an added token, that is one id.
    """
    import public_tokenizers
    import tiktoken

    with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
        table = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    with open(tokenizer or public_tokenizers.path(TOKENIZER), encoding="utf-8") as described:
        added = {t["content"]: t["id"] for t in json.load(described)["added_tokens"]}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: only longer ones are cut, the rest of the division comes first."""
    if n <= length:
        return [(0, n)]
    first = n % length
    return ([(0, first)] if first else []) + [(at, length) for at in range(first, n, length)]


def pieces_of(length: int, ranks: str | None):
    """Arrow function: documents to pieces, with the CRC of the ids of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks)
        for batch in batches:
            names, marks, texts = batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), batch.column("text")
            rows: list[tuple] = []
            for i, text in enumerate(texts):
                value = text.as_py()
                ids = np.append(own.encode_to_numpy(value, allowed_special="all") if value else np.zeros(0, np.uint32), np.uint32(END))
                ids = ids.astype("<u4", copy=False)
                for number, (start, n) in enumerate(cut(len(ids), length)):
                    rows.append((names[i], marks[i], number, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "mark", "piece", "start", "length", "ids_crc32"]
            )

    return run


class Bins:
    """A fixed number of open bins. Bit ``f`` of ``free`` is set while a bin with ``f`` tokens of room is open."""

    def __init__(self, length: int, most: int) -> None:
        self.length, self.most, self.free, self.open, self.count = length, most, 0, 0, 0
        self.with_room: dict[int, list[int]] = {}

    def _take(self, room: int) -> int:
        bins = self.with_room[room]
        number = bins.pop()
        if not bins:
            self.free &= ~(1 << room)
        self.open -= 1
        return number

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset) of the next piece: the fullest bin that still takes it, else a new one."""
        fits = self.free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            number = self._take(room)
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            number, room = self.count, self.length
            self.count += 1
        left = room - n
        if left:
            self.with_room.setdefault(left, []).append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.length - room


def packed(length: int, most: int):
    """Arrow function: the pieces of one task to places in sequences of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = Bins(length, most), (TaskContext.get().partitionId() + 1) << 40
        for batch in batches:
            places = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + b for b, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, packer_pieces: int = PACKER_PIECES, ranks: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row of ``docs`` (``doc_id``, ``text``).

    A document is the ids of its whole text and id 0; null is an empty text, so
    its id 0 alone. Only documents longer than ``length`` are cut, the shorter
    piece first. Full pieces are sequences of their own. The others go to
    packers of about ``packer_pieces`` pieces, in seeded waves of about ``open_bins``
    pieces, the longest of a wave first; a packer holds at most ``open_bins``
    open bins and puts a piece into the fullest that takes it. A
    row that is repeated is packed as often as it occurs; of equal ids and texts
    the pieces are interchangeable.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    types = "doc_id long, mark long, piece int, start long, length long, ids_crc32 long"
    pieces = stage(rows.mapInArrow(pieces_of(length, ranks), types), "pack-pieces")
    # Full pieces count down from -1, packers up from 2^40.
    full = pieces.filter(F.col("length") == length).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    part = pieces.filter(F.col("length") < length)
    count = part.count()
    waves, tasks = count // open_bins + 1, count // packer_pieces + 1
    order = F.xxhash64("doc_id", "piece", "mark")
    dealt = part.withColumn("_order", order).withColumn("_wave", F.pmod("_order", F.lit(waves))).repartition(tasks, "_wave")
    dealt = dealt.sortWithinPartitions("_wave", F.desc("length"), "_order", "doc_id", "piece").drop("_order", "_wave")
    placed = dealt.mapInArrow(packed(length, open_bins), types + ", sequence_id long, offset long")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "mark"]
    return stage(full.select(*columns).unionByName(placed.select(*columns)), "pack-placed")
