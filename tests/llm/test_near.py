from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleaner.llm import minhash
from gleaner.llm.components import components
from helpers import DOCUMENTS, SMALL, corpus, edited, near_components, prose


def answer(df):
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()], key=repr)


@pytest.mark.parametrize("words", [4, 5])
def test_against_all_pairs(spark, words):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumn("mark", F.lit("own")).withColumn("n", F.lit(1))
    assert answer(minhash.groups(docs, words)) == near_components([r[:2] for r in rows], words, 80)


@pytest.mark.parametrize("together", [8192, 10])
def test_many_versions_in_small_blocks(spark, monkeypatch, together):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "TOGETHER", together)
    base = prose(1, 150)
    rows = [(i, edited(base, i, 14 + i % 40)) for i in range(120)]
    rows += [(1000 + i, prose(2, 60) + " " + prose(3000 + i, 40)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(minhash.groups(docs, 4)) == near_components(rows, 4, 80)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert answer(minhash.groups(docs, 4)) == near_components(rows, 4, 80)


def test_empty(spark):
    assert minhash.groups(spark.createDataFrame([], DOCUMENTS)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300) if i != 150], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {i: 0 if i <= 150 else 151 for i in range(1, 301) if i != 151}


def test_drop_keeps_columns_and_singles(spark):
    docs = spark.createDataFrame(corpus(), DOCUMENTS)
    left = minhash.drop_near(docs)
    assert left.columns == docs.columns
    ids = {r["doc_id"] for r in left.collect()}
    assert {1, 2, 3, 4, 6, 7, 10, 16, 17, 19, 100, 300} <= ids and not ids & {8, 5, 11, 18, 101, 301}
    assert len([i for i in ids if i and 200 <= i < 300]) == 40


def test_long_words_built_alike_stay_apart(spark):
    """Words that alternate two letters in step with the parity of their position's bits, and their complements, share nothing."""
    rows = []
    for n, size in enumerate((8, 16, 17, 64, 1024, 4096)):
        bits = [i.bit_count() % 2 for i in range(size)]
        rows += [(10 * n, "".join("ab"[b] for b in bits)), (10 * n + 1, "".join("ba"[b] for b in bits))]
    rows += [(100, "x" * 7 + "\0"), (101, "x" * 7), (102, "x" * 16), (103, "x" * 16 + "\0"), (104, "X" * 17), (105, "x" * 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = answer(minhash.groups(docs, 4))
    assert got == near_components(rows, 4, 80)
    assert [c for i, _, c in got if i < 104] == [i for i, _, _ in got if i < 104]
