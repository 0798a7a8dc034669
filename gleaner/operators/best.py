"""The best rows per question among batches of vectors, in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distances computed at once, places they are rounded to, what rounding may add to a distance that is only estimated.
CELLS = 4_000_000
PLACES = 9
SLACK = 1e-8


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column to a 2-d double matrix."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 0)


class Best:
    """Best ``k`` rows per (question, slot) seen by one task."""

    def __init__(self, questions: np.ndarray, k: int):
        self.questions = questions
        self.squares = (questions**2).sum(axis=1)
        self.k = k
        self.kept: dict[int, list[tuple]] = {}
        # Distance of the current k-th row of each question.
        self.limits = np.full(len(questions), np.inf)

    def offer(self, asked, vectors, ranks, names, ids, sources) -> None:
        """Offer a batch of rows to the asked questions."""
        step = max(1, CELLS // max(1, len(asked)))
        for lo in range(0, len(vectors), step):
            part = slice(lo, lo + step)
            self._offer(asked, vectors[part], ranks[part], names[part], ids[part], sources[part])

    def _offer(self, asked, vectors, ranks, names, ids, sources) -> None:
        rows = (vectors**2).sum(axis=1)
        about = rows[None, :] + self.squares[asked][:, None] - 2.0 * (self.questions[asked] @ vectors.T)
        slack = SLACK * (1.0 + rows.max(initial=0.0) + self.squares[asked])
        bound = self.limits[asked]
        if vectors.shape[0] > self.k:
            bound = np.minimum(bound, np.partition(about, self.k - 1, axis=1)[:, self.k - 1])
        bound = bound + slack
        nearest = about.min(axis=1)
        for i in np.flatnonzero((nearest <= bound) & np.isfinite(nearest)):
            question = int(asked[i])
            near = np.flatnonzero((about[i] <= bound[i]) & np.isfinite(about[i]))
            exact = np.round(((vectors[near] - self.questions[question]) ** 2).sum(axis=1), PLACES)
            # Rows come in tie order, so a stable sort settles any number of equal distances.
            first = np.argsort(exact, kind="stable")[: self.k]
            found = [
                (float(exact[f]), int(ranks[r]), ids[int(r)].as_py() or "", names[int(r)].as_py(), sources[int(r)].as_py())
                for f, r in zip(first, near[first])
            ]
            kept = sorted(self.kept.get(question, []) + found, key=lambda row: row[:3])[: self.k]
            self.kept[question] = kept
            if len(kept) == self.k:
                self.limits[question] = kept[-1][0]


def widths(column: pa.Array) -> np.ndarray:
    """Length of each vector; 0 for one that is null or holds a null or non-finite element."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.flatnonzero(~np.isfinite(flat))
    if len(bad):
        lengths[np.searchsorted(np.cumsum(lengths), bad, side="right")] = 0
    return lengths
