"""Whitening of embeddings by the covariance of their distinct integer vectors.

Vectors are rounded down to integers; identical ones are met once, with their number as weight or with
weight one. Sums over the fit list are exact integers. The covariance is a product of centred blocks,
added up over tasks in two steps; its eigenvectors are taken in one small task, since it is as wide as the
vectors, whatever the number of rows. Each distinct vector is whitened once and joined back to its rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import short_batches
from gleaner.session import stage

#: Entries become ``floor(SCALE * c) + SHIFT``. Entries that leave ``LARGEST`` either way count as it.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 52

#: Components returned at most.
COMPONENTS = 16

#: Numbers of the covariances fitted together, 512 MB: widths beyond that are fitted in further lots. Partial sums are added in so many tasks first.
LOT_NUMBERS, FIRST_SUMS = 1 << 26, 64

_TOP = float(1 << 63)


def integers(vectors: DataFrame) -> DataFrame:
    """``vec_id, x, width`` of the rows whose vector is present and holds no null or non-finite entry."""
    e = F.col("embedding")
    good = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    moved = F.transform(e, lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.lit(float(SCALE)) * c.cast("double")))) + F.lit(SHIFT))
    return vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), moved.cast("array<long>").alias("x")).withColumn("width", F.size("x"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(width, row numbers, integer matrix, weights) of a batch, by width."""
    lists, weights = batch.column("x"), batch.column("weight").to_numpy()
    lengths = lists.value_lengths().to_numpy()
    flat, starts = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lengths)][:-1]
    for width in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == width)
        yield width, own, flat[starts[own][:, None] + np.arange(width)], weights[own]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task: for each width the weight and the sum of every dimension, as decimal text (no sum overflows)."""
    sums: dict = defaultdict(lambda: [0, None])
    for batch in batches:
        for width, _, x, weight in _matrices(batch):
            own = sums[width]
            own[0] += int(weight.sum())
            wide = np.abs(x).max() > (1 << 40) or weight.max() > 1 << 10  # a batch is short; else its sums may not fit 64 bits
            part = (x.astype(object) * weight.astype(object)[:, None]).sum(axis=0) if wide else (x * weight[:, None]).sum(axis=0).astype(object)
            own[1] = part if own[1] is None else own[1] + part
    for width, (n, total) in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([width], pa.int32()), pa.array([str(n)]), pa.array([[str(v) for v in total]], pa.list_(pa.string()))], ["width", "n", "sums"]
        )


class Centre:
    """Mean of the fit list as an integer and the rest of the division, so that centring loses nothing to the size of the mean."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        whole = [(2 * s + n) // (2 * n) for s in sums]
        self.whole = np.array(whole, np.int64)
        self.rest = [s - n * w for s, w in zip(sums, whole)]
        self.part = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S/n`` in double precision."""
        return (x - self.whole).astype(np.float64) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n*x - S)**2``, exact; None where it does not fit a long.

        Arithmetic modulo 2**64 is exact wherever the sum fits; an estimate in double precision tells where it does,
        and next to the limit Python's integers decide.
        """
        size = ((self.centred(x) * float(self.n)) ** 2).sum(axis=1)
        with np.errstate(over="ignore"):
            rest = np.array([r % (1 << 64) for r in self.rest], np.uint64)
            y = (x - self.whole).view(np.uint64) * np.uint64(self.n % (1 << 64)) - rest
            found = (y * y).sum(axis=1, dtype=np.uint64)
        out: list[int | None] = []
        for row, estimate, value in zip(x, size.tolist(), found.tolist()):
            if abs(estimate - _TOP) < _TOP * 1e-6:
                value = sum((self.n * (int(v) - int(w)) - r) ** 2 for v, w, r in zip(row, self.whole, self.rest))
                estimate = float(value)
            out.append(value if estimate < _TOP and value < 1 << 63 else None)
        return out


def _products(centres: dict[int, Centre]):
    """Arrow function: rows of the weighted products of centred vectors, added up over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for width, _, x, weight in _matrices(batch):
                y = centres[width].centred(x)
                own = (y * weight[:, None]).T @ y
                sums[width] = sums[width] + own if width in sums else own
        for width, own in sums.items():
            yield _lines([(width, i, own[i]) for i in range(width)])

    return run


def _lines(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))],
        ["width", "i", "values"],
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one width and number added up; a task holds one covariance of each of its widths at most."""
    sums: dict = {}
    for batch in batches:
        for width, i, values in zip(batch.column("width").to_pylist(), batch.column("i").to_pylist(), batch.column("values")):
            own = values.values.to_numpy()
            sums[width, i] = sums[width, i] + own if (width, i) in sums else own.copy()
    if sums:
        yield _lines([(w, i, v) for (w, i), v in sums.items()])


_LINES = "width int, i int, values array<double>"


def _sum_lines(lines: DataFrame) -> DataFrame:
    """One line for each width and number. In two steps, so that no task adds up the lines of all tasks."""
    first = lines.withColumn("lot", F.spark_partition_id() % FIRST_SUMS).repartition("lot").drop("lot").mapInArrow(_added, _LINES)
    return first.repartition("width", "i").mapInArrow(_added, _LINES)


def eigen(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) by falling eigenvalue, ``count`` of them; the largest entry of a vector is positive.

    Values that rounding alone explains are 0.
    """
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:count]
    values, vectors = values[order], vectors[:, order]
    # One step of refinement: the quotient is far closer than the value that came with the vector.
    values = np.einsum("ij,ij->j", vectors, covariance @ vectors)
    values = np.where(values > max(values.max(initial=0), 0) * len(covariance) * np.finfo(float).eps, values, 0.0)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values, vectors * np.where(sign == 0, 1, sign)


def _decomposed(counts: dict[int, int], components: int):
    """Arrow function over all lines of a width, one width after another: its components."""

    def solved(width: int, lines: dict[int, np.ndarray]) -> pa.RecordBatch:
        covariance = np.stack([lines[i] for i in range(width)]) / counts[width]
        values, vectors = eigen(covariance, min(components, width))
        trace = float(np.trace(covariance))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([width] * len(values), pa.int32()), pa.array(np.arange(1, len(values) + 1), pa.int32()), pa.array(values),
                pa.array([v / trace if trace > 0 else None for v in values.tolist()], pa.float64()),
                pa.array(list(np.ascontiguousarray(vectors.T)), pa.list_(pa.float64())),
            ],
            ["width", "component", "value", "explained", "vector"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lines = None, {}
        for batch in batches:
            for width, i, values in zip(batch.column("width").to_pylist(), batch.column("i").to_pylist(), batch.column("values")):
                if width != own:
                    if lines:
                        yield solved(own, lines)
                    own, lines = width, {}
                lines[i] = values.values.to_numpy().copy()
        if lines:
            yield solved(own, lines)

    return run


def _whitened(centres: dict[int, Centre], models: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Arrow function: each distinct vector with its exact deviation and its whitened components (null where a component has no variance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, out = [None] * batch.num_rows, [None] * batch.num_rows
            for width, own, x, _ in _matrices(batch):
                values, vectors = models[width]
                flat = values <= 0
                white = (centres[width].centred(x) @ vectors) / np.sqrt(np.where(flat, 1, values))
                for row, deviation, w in zip(own.tolist(), centres[width].deviations(x), white.tolist()):
                    far[row], out[row] = deviation, [None if f else v for f, v in zip(flat, w)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("x"), batch.column("weight"), pa.array(far, pa.int64()), pa.array(out, pa.list_(pa.float64()))], ["x", "weight", "deviation", "white"]
            )

    return run


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums and products of whitened vectors over a task; line 0 holds weight and sums, the others the products."""
    sums: dict = {}
    for batch in batches:
        widths, lists, weights = batch.column("width").to_numpy(), batch.column("white"), batch.column("weight").to_numpy()
        for width in np.unique(widths).tolist():
            own = np.flatnonzero(widths == width)
            white = np.array([lists[i].as_py() for i in own.tolist()], np.float64).reshape(len(own), -1)
            white = np.c_[np.ones(len(own)), np.where(np.isnan(white), 0, white)]
            part = (white * weights[own][:, None]).T @ white
            sums[width] = sums[width] + part if width in sums else part
    for width, own in sums.items():
        yield _lines([(width, i, own[i]) for i in range(len(own))])


def _fit_lot(classes: DataFrame, centres: dict[int, Centre], components: int) -> DataFrame:
    """``x, n, deviation, white, explained, identity_error`` for the vectors of one lot of widths."""
    spark = classes.sparkSession
    counts = {w: c.n for w, c in centres.items()}
    lines = _sum_lines(classes.select("x", "weight").mapInArrow(_products(centres), _LINES))
    solved = stage(
        lines.repartition("width").sortWithinPartitions("width")
        .mapInArrow(_decomposed(counts, components), "width int, component int, value double, explained double, vector array<double>"),
        "white-models",
    )
    # At most ``components`` short vectors a width; a lot of widths is bounded.
    found: dict[int, list] = defaultdict(list)
    for r in solved.orderBy("width", "component").collect():
        found[r["width"]].append(r)
    models = {w: (np.array([r["value"] for r in rows]), np.array([r["vector"] for r in rows]).T) for w, rows in found.items()}
    white = stage(
        classes.select("x", "weight").mapInArrow(_whitened(centres, models), "x array<long>, weight long, deviation long, white array<double>")
        .withColumn("width", F.size("x")),
        "white-classes",
    )
    errors: dict[int, list] = defaultdict(list)
    for r in _sum_lines(white.select("width", "white", "weight").mapInArrow(_moments, _LINES)).collect():  # one small square a width
        errors[r["width"]].append((r["i"], r["values"]))
    about = []
    for width, rows in found.items():
        product = np.array([v for _, v in sorted(errors[width])])
        mean = product[0, 1:] / product[0, 0]
        own = product[1:, 1:] / product[0, 0] - np.outer(mean, mean) - np.eye(len(rows))
        real = models[width][0] > 0
        worst = float(np.abs(own[np.ix_(real, real)]).max()) if real.any() else None
        about.append((width, counts[width] if counts[width] < 1 << 63 else None, [r["explained"] for r in rows], worst))
    told = spark.createDataFrame(about, "width int, n long, explained array<double>, identity_error double")
    return white.join(F.broadcast(told), "width").select("x", "n", "deviation", "white", "explained", "identity_error")


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every row of ``vectors`` (``vec_id``, ``embedding``).

    Rows whose vector is null or holds null or non-finite entries are left out; rows with null or repeated
    ids stay, each with its own answer. An empty vector has no components and so no rows. Entries become
    integers first. ``weights`` is ``one`` (each distinct vector counts once) or ``count`` (as often as it
    stands); ``n`` is the weight of the fit list. Vectors of one width are a fit of their own. ``deviation`` is null
    where it does not fit a long. A component without variance (rounding aside) has a null ``whitened`` and is
    left out of ``identity_error``; ``explained`` is null where nothing varies. Other columns are not read.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights is 'one' or 'count'")
    spark = vectors.sparkSession
    short_batches(spark)
    rows = stage(integers(vectors), "white-rows")
    weight = F.count("*") if weights == "count" else F.lit(1).cast("long")
    classes = stage(rows.groupBy("x").agg(weight.alias("weight")).withColumn("width", F.size("x")), "white-distinct")
    partial = classes.select("x", "weight").mapInArrow(_totals, "width int, n string, sums array<string>")
    # A row for each width and task, and then one a width: as many numbers as the vectors are wide.
    each = partial.select("width", F.col("n").cast("decimal(38,0)").alias("n"), F.posexplode("sums").alias("i", "s"))
    added = each.groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    centres: dict[int, dict] = defaultdict(dict)
    n_of = {}
    for r in added.collect():
        centres[r["width"]][r["i"]] = int(r["s"])
        n_of[r["width"]] = int(r["n"])
    lots, size = [[]], 0
    for width in sorted(centres):
        if lots[-1] and size + width * width > LOT_NUMBERS:
            lots.append([])
            size = 0
        lots[-1].append(width)
        size += width * width
    fitted = None
    for lot in lots:
        own = {w: Centre(n_of[w], [centres[w][i] for i in range(w)]) for w in lot}
        part = _fit_lot(classes.filter(F.col("width").isin(lot)), own, components) if lot else None
        fitted = part if fitted is None else fitted.unionByName(part)
    if fitted is None:
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], schema)
    # The hash is sorted first, the vector decides.
    key = F.xxhash64("x").alias("h")
    back = rows.select("vec_id", key, "x").join(fitted.select(key, "x", "n", "deviation", "white", "explained", "identity_error").hint("merge"), ["h", "x"])
    each = back.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("white", "explained")).alias("at", "of"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("of.white").alias("whitened"),
        F.col("of.explained").alias("explained"), "identity_error",
    )
