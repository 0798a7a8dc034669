"""Hashes of the words and shingles of whole batches of texts, by array operations."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; words may cross the border.
PIECE = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ODD = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each of ``x``."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(base: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE, base, np.uint64)]), dtype=np.uint64)


_POWERS, _INVERSES = _powers(_BASE), _powers(_INVERSE)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after another, and where each row begins (one entry more than rows)."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    starts = np.frombuffer(where, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def word_hashes(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every row and the end), words being runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lowered.

    A word's hash is a polynomial in its bytes; prefix sums over pieces of fixed
    length give all of them at once, so memory does not grow with a word.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    begins, ends, at_begin, at_end, turns = [], [], [], [], []
    total, power, inverse, before = np.uint64(0), np.uint64(1), np.uint64(1), True
    with np.errstate(over="ignore"):
        for a in range(0, n, PIECE):
            piece = _LOWER[data[a : a + PIECE]]
            m = len(piece)
            blank = _BLANK[piece]
            previous = np.empty(m, bool)
            previous[0], previous[1:] = before, blank[:-1]
            before = blank[-1]
            sums = np.empty(m + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_VALUE[piece] * _POWERS[:m], out=sums[1:])
            sums = sums * power + total
            cut = edge[a : a + m]
            begin = np.flatnonzero(~blank & (previous | cut))
            end = np.flatnonzero(~previous & (blank | cut))
            if a == 0:
                end = end[end > 0]
            begins.append(begin + a)
            ends.append(end + a)
            at_begin.append(sums[begin])
            at_end.append(sums[end])
            turns.append(_INVERSES[begin] * inverse)
            total, power, inverse = sums[m], power * _POWERS[m], inverse * _INVERSES[m]
        if n and not before:
            ends.append(np.array([n]))
            at_end.append(np.array([total], np.uint64))
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
        begin, end = np.concatenate(begins), np.concatenate(ends)
        hashes = (np.concatenate(at_end) - np.concatenate(at_begin)) * np.concatenate(turns)
        hashes = mixed(hashes + (end - begin).astype(np.uint64) * _ODD[0])
    return hashes, np.searchsorted(begin, rows)


#: Masks for the first 0 to 8 bytes of a little-endian lane; key of the hash of words that two lanes do not hold.
_ENDS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_WORD_KEY = b"gleaner words"


def word_digests(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`word_hashes`, by a hash that words built alike do not share.

    Up to 16 bytes a word's bytes are mixed as two lanes of eight; longer words go through a keyed hash of all their bytes.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    low = np.zeros(n + 16, np.uint8)
    low[:n] = _LOWER[data]
    blank = _BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    begin = np.flatnonzero(~blank & (np.r_[True, blank[:-1]] | edge[:n]))
    end = np.flatnonzero(~blank & (np.r_[blank[1:], True] | edge[1:])) + 1
    length = end - begin
    lanes = np.ndarray((n + 9,), np.dtype("<u8"), low, strides=(1,))
    with np.errstate(over="ignore"):
        first = lanes[begin] & _ENDS[np.minimum(length, 8)]
        second = lanes[begin + 8] & _ENDS[np.clip(length - 8, 0, 8)]
        hashes = mixed(mixed(mixed(first + _ODD[1]) ^ second) + length.astype(np.uint64) * _ODD[0])
    for i in np.flatnonzero(length > 16).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(low[begin[i] : end[i]].tobytes(), digest_size=8, key=_WORD_KEY).digest(), "little")
    return hashes, np.searchsorted(begin, rows)


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles of ``words`` words (at most six).

    A row with fewer words has one shingle, the whole sequence; without words it has none.
    """
    hashes, first = word_digests(*bytes_of(column))
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - words + 1)
        whole = np.zeros(n, np.uint64)
        for i in range(words):
            whole += hashes[i : i + n] * _ODD[i]
        whole = mixed(whole + np.uint64(words))
        sets = []
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= words:
                sets.append(np.unique(whole[a : b - words + 1]))
            elif b > a:
                sets.append(mixed((hashes[a:b] * _ODD[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets
