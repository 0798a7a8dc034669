"""Quality of texts by a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse row: its distinct words, hashed to ``2**WORD_BITS`` places and
scaled to length one together, then statistics of its bytes, words and lines and
the given length. The score of a row is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so all pairs of features interact through ``FACTORS`` numbers each, in time linear
in the row. Features are made where the texts are; the model is fitted in one task
on a bounded sample of labelled rows and goes out with the scoring function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import boxed, mark, short_batches, unboxed
from gleaner.llm.words import bytes_of, word_hashes
from gleaner.session import stage

#: Labelled rows that the model is fitted on at most, places for words, interaction factors, seed.
SAMPLE_ROWS, WORD_BITS, FACTORS, SEED = 20_000, 16, 8, 7

#: Rows of a step, passes over the sample, steps at least.
STEP_ROWS, EPOCHS, LEAST_STEPS = 128, 8, 1000

#: A row is predicted good from this score on; labelled rows with this remainder of the id's CRC are held out.
THRESHOLD, FOLDS, HELD_FOLD = 0.3, 5, 0

_PUNCTUATION = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_STATISTICS = 14 + len(_PUNCTUATION)


def held_out():
    """Column: the row's label is never learnt from. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_FOLD


def _statistics(data: np.ndarray, hashes: np.ndarray, distinct: int, given: float | None) -> np.ndarray:
    """Shares and logarithms, all of the order of one."""
    n, words = len(data), len(hashes)
    counts = np.bincount(data, minlength=256)
    letters = counts[65:91].sum() + counts[97:123].sum()
    lines = data.tobytes().split(b"\n") if n else []
    filled = [x for x in lines if x.strip()]
    most = np.unique(hashes, return_counts=True)[1].max() if words else 0
    base = max(n, 1)
    own = [
        np.log1p(n) / 10, np.log1p(words) / 10, n / max(words, 1) / 10, distinct / max(words, 1), most / max(words, 1),
        counts[65:91].sum() / max(letters, 1), letters / base, counts[48:58].sum() / base, counts[128:].sum() / base,
        counts[_PUNCTUATION].sum() / base, len(filled) / max(words, 1), 1 - len(set(filled)) / max(len(filled), 1),
        np.log1p(max(given or 0.0, 0.0)) / 10, float(given is None),
    ]
    return np.concatenate([np.array(own), np.minimum(counts[_PUNCTUATION] / base * 10, 1)]).astype(np.float32)


def features(texts: pa.Array, given: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of words row by row, where each row begins, statistics as a table)."""
    data, rows = bytes_of(texts)
    hashes, first = word_hashes(data, rows)
    places = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    kept, starts, table = [], [0], np.zeros((len(rows) - 1, _STATISTICS), np.float32)
    for i, n in enumerate(given.to_pylist()):
        own = places[first[i] : first[i + 1]]
        distinct = np.unique(own)
        kept.append(distinct)
        starts.append(starts[-1] + len(distinct))
        table[i] = _statistics(data[rows[i] : rows[i + 1]], own, len(distinct), n)
    return np.concatenate(kept) if kept else np.zeros(0, np.int64), np.array(starts), table


def sparse(places: np.ndarray, starts: np.ndarray, table: np.ndarray, centre: np.ndarray, scale: np.ndarray):
    """(index, value, first entry of each row): words scaled to length one, then standardised statistics, then nothing is empty."""
    rows, width = table.shape
    counts = np.diff(starts)
    begin = starts[:-1] + np.arange(rows) * width
    index = np.empty(len(places) + rows * width, np.int64)
    value = np.empty(len(index), np.float32)
    tail = (begin + counts)[:, None] + np.arange(width)
    word = np.ones(len(index), bool)
    word[tail.ravel()] = False
    index[word] = places
    value[word] = np.repeat(1 / np.sqrt(np.maximum(counts, 1)), counts)
    index[tail] = (1 << WORD_BITS) + np.arange(width)
    value[tail] = np.clip((table - centre) / scale, -6, 6) / np.sqrt(width)
    return index, value, begin


def raw_score(model: dict, index: np.ndarray, value: np.ndarray, begin: np.ndarray):
    """(score before the logistic, sum of factors per row) by the sum-of-squares identity."""
    weighted = model["v"][index] * value[:, None]
    sums = np.add.reduceat(weighted, begin, axis=0)
    squares = np.add.reduceat((weighted * weighted).sum(axis=1), begin)
    linear = np.add.reduceat(model["w"][index] * value, begin)
    return model["w0"] + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5) -> dict:
    """The model of (places, statistics, label) rows by AdaGrad on the log loss. Without rows every score is one half."""
    size = (1 << WORD_BITS) + _STATISTICS
    draw = np.random.default_rng(SEED)
    model = {
        "w0": np.float32(0), "w": np.zeros(size, np.float32), "v": draw.normal(0, 0.05, (size, FACTORS)).astype(np.float32),
        "centre": np.zeros(_STATISTICS, np.float32), "scale": np.ones(_STATISTICS, np.float32),
    }
    if not rows:
        model["v"][:] = 0
        return model
    table = np.stack([r[1] for r in rows])
    model["centre"], model["scale"] = table.mean(axis=0), np.maximum(table.std(axis=0), 1e-3)
    label = np.array([r[2] for r in rows], np.float32)
    rate_of_good = np.clip(label.mean(), 0.01, 0.99)
    model["w0"] = np.float32(np.log(rate_of_good / (1 - rate_of_good)))
    seen_w, seen_v = np.full(size, 1e-2, np.float32), np.full((size, FACTORS), 1e-2, np.float32)
    steps = -(-len(rows) // STEP_ROWS)
    for _ in range(max(epochs, -(-LEAST_STEPS // steps))):
        order = draw.permutation(len(rows))
        for at in range(0, len(order), STEP_ROWS):
            own = order[at : at + STEP_ROWS]
            starts = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in own])])
            index, value, begin = sparse(np.concatenate([rows[i][0] for i in own]), starts, table[own], model["centre"], model["scale"])
            score, sums = raw_score(model, index, value, begin)
            error = (logistic(score) - label[own]).astype(np.float32)
            per = np.repeat(np.arange(len(own)), np.diff(np.append(begin, len(index))))
            pull = error[per] * value
            step_v = pull[:, None] * (sums[per] - model["v"][index] * value[:, None])
            sort = np.argsort(index, kind="stable")
            place, first = np.unique(index[sort], return_index=True)
            grad_w = np.add.reduceat(pull[sort], first) + decay * model["w"][place]
            grad_v = np.add.reduceat(step_v[sort], first, axis=0) + decay * model["v"][place]
            seen_w[place] += grad_w * grad_w
            seen_v[place] += grad_v * grad_v
            model["w"][place] -= rate * grad_w / np.sqrt(seen_w[place])
            model["v"][place] -= rate * grad_v / np.sqrt(seen_v[place])
            model["w0"] -= np.float32(0.01 * error.mean())
    return model


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, starts, table = features(batch.column("text"), batch.column("given"))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("draw"), batch.column("label"),
                pa.array([places[a:b] for a, b in zip(starts[:-1], starts[1:])], pa.list_(pa.int64())),
                pa.array(list(table), pa.list_(pa.float32())),
            ],
            ["draw", "label", "places", "statistics"],
        )


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        columns = [batch.column(c) for c in ("draw", "label", "places", "statistics")]
        rows += [(d.as_py(), p.values.to_numpy(), s.values.to_numpy(), y.as_py()) for d, y, p, s in zip(*columns)]
    rows.sort(key=lambda r: r[0])
    model = fit([r[1:] for r in rows])
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(model)), pa.array([np.asarray(x, np.float32).tobytes() for x in model.values()], pa.binary())], ["name", "data"]
    )


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """The model of ``labels`` (``doc_id``, ``quality``) for ``docs``, fitted on at most ``sample_rows`` labelled rows.

    Held-out rows, null labels and ids with contradictory labels are left out; of
    several texts of an id the one with the smallest mark counts; the sample is the smallest digests of the ids, so it does not depend on
    partitions. Nothing but text and ``n_chars`` becomes a feature.
    """
    short_batches(docs.sparkSession)
    own = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    own = own.agg(F.min("quality").alias("label"), F.max("quality").alias("other")).filter("label = other").filter(~held_out())
    chosen = own.select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("draw")).orderBy("draw").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"), *_inputs(docs))
    least = F.min(F.struct("mark", "given", "text", "label", "draw")).alias("row")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(least).select("doc_id", "row.*")
    made = stage(rows.mapInArrow(_sample_features, "draw long, label int, places array<long>, statistics array<float>"), "quality-sample")
    parts = {r["name"]: np.frombuffer(r["data"], np.float32).copy() for r in made.coalesce(1).mapInArrow(_fitted, "name string, data binary").collect()}
    if not parts:
        return fit([])
    return parts | {"w0": parts["w0"][0] if parts["w0"].ndim else parts["w0"], "v": parts["v"].reshape(-1, FACTORS)}


def _inputs(docs: DataFrame) -> list:
    given = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return [F.coalesce("text", F.lit("")).alias("text"), given.alias("given")]


def scores_of(model: dict, texts: pa.Array, given: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.zeros(0)
    return logistic(raw_score(model, *sparse(*features(texts, given), model["centre"], model["scale"]))[0]).astype(np.float64)


def _scored(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array(scores_of(model, batch.column("text"), batch.column("given")), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), own], ["doc_id", "mark", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted, mark`` for every row of ``docs`` (``doc_id``, ``text``, ``n_chars`` if there is one).

    ``score`` lies in 0 to 1, higher where ``quality`` 1 is likelier; null and
    empty texts are scored by their statistics alone. ``predicted`` is 1 from
    ``THRESHOLD`` on.
    """
    model = train(docs, labels, sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"), *_inputs(docs))
    scored = rows.mapInArrow(_scored(model), "doc_id long, mark long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "mark")


def _good(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("row").field("text")
            keep = scores_of(model, pc.fill_null(texts, ""), batch.column("given")) >= THRESHOLD
            yield batch.filter(pa.array(keep, pa.bool_())).drop_columns(["given"])

    return run


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that are predicted good, columns unchanged whatever their names; one pass without a shuffle."""
    model = train(docs, labels, sample_rows)
    rows = boxed(docs, _inputs(docs)[1]).select("row", "given")
    return unboxed(rows.mapInArrow(_good(model), T.StructType([rows.schema["row"]])), docs.columns)
