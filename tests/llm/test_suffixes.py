from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from gleaner.llm import suffixes
from helpers import DOCUMENTS, SMALL, corpus


def brute(rows, length):
    seen = Counter()
    bodies = [(t or "").encode() for _, t in rows]
    for b in bodies:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for (doc_id, _), b in zip(rows, bodies):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def answer(df):
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted([tuple(r) for r in df.collect()], key=repr)


def noise(seed, n, letters="ab cdé\n"):
    draw = random.Random(seed)
    return "".join(draw.choice(letters) for _ in range(n))


def cases():
    passage, other = noise(1, 260), noise(2, 199)
    rows = [(i, noise(10 + i, 300 + i) + passage[: 150 + 10 * i] + noise(40 + i, 90)) for i in range(12)]
    rows += [(20, "a" * 900), (21, "b" + "a" * 350), (22, None), (23, ""), (24, other + "x" + other), (25, "ab" * 300), (None, passage)]
    rows += [(26, noise(77, 500)), (26, noise(77, 500)), (27, noise(77, 500) + "!"), (28, "é" * 150 + noise(5, 20)), (29, "é" * 150)]
    return rows


@pytest.mark.parametrize("hot", [20_000, 3])
def test_against_counting_all_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "BLOCK", 8)
    rows = cases()
    assert answer(suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 200)


def test_shorter_strings(spark):
    rows = cases()
    got = answer(suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50, 12))
    assert got == brute(rows, 50)


def test_extra_columns_and_given_documents(spark):
    from pyspark.sql import functions as F

    rows = corpus()
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumn("key", F.lit("own")).withColumn("h", F.lit(1))
    assert answer(suffixes.remove_repeats(docs)) == brute([r[:2] for r in rows], 200)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert answer(suffixes.remove_repeats(docs)) == brute(rows, 200)


def test_empty(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], DOCUMENTS)).count() == 0
