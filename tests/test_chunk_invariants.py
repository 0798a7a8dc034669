"""What `chunk_invariants` says of good and of wrong chunks, held against plain Python over the whole text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleaner import schemas as S
from gleaner.functions import splitter
from gleaner.functions.text import WHITESPACE
from gleaner.queries.text import BLOCK_CHARS, chunk_invariants

PART = "array<struct<start:bigint,chunk:string>>"
TEXTS = [
    "", " \n\t ", "\n" * (3 * BLOCK_CHARS), "one", " one ", "x" * BLOCK_CHARS, "ab" * BLOCK_CHARS,
    "word " * 2000, "\U0001f600 é wörd, " * 900, "para one\r\n\r\n" * 400, "head" + " " * (5 * BLOCK_CHARS) + "tail",
    "\n" * 2500 + "late start\n" + "line of text\n" * 500 + " " * 2500,
]
#: Ways to spoil the chunks of a text; all but the first say something wrong of some text.
SPOILED = {
    "good": lambda p: p,
    "late": lambda p: F.transform(p, lambda x: F.struct((x["start"] + 1).alias("start"), x["chunk"])),
    "far": lambda p: F.transform(p, lambda x: F.struct((x["start"] + 1_000_000).alias("start"), x["chunk"])),
    "before": lambda p: F.transform(p, lambda x: F.struct((x["start"] - 1_000_000).alias("start"), x["chunk"])),
    "other": lambda p: F.transform(p, lambda x, i: F.struct(x["start"], F.when(i == 2, F.reverse(x["chunk"])).otherwise(x["chunk"]).alias("chunk"))),
    "hole": lambda p: F.filter(p, lambda x, i: i % 7 != 3),
    "headless": lambda p: F.slice(p, 2, 1_000_000),
    "cut off": lambda p: F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))),
    "none": lambda p: F.filter(p, lambda x: F.lit(False)),
    "long": lambda p: F.when(F.size(p) > 1, F.array(F.struct(p[0]["start"], F.array_join(F.transform(p, lambda x: x["chunk"]), "").alias("chunk")))).otherwise(p),
}


def plain(text, parts):
    covered, end = True, 0
    for start, chunk in parts:
        covered = covered and (start <= end or not text[max(end, 0) : start].strip(WHITESPACE))
        end = start + len(chunk)
    covered = covered and not text[max(end, 0) :].strip(WHITESPACE)
    in_place = all(start >= 0 and text[start : start + len(chunk)] == chunk for start, chunk in parts)
    return all(len(chunk) <= S.CHUNK_SIZE for _, chunk in parts), in_place, covered


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("chunks"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_blank_documents_have_nothing_to_check(spark, tmp_path):
    texts = ["", " \n\t\x0b", "\n" * 5000, "text", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in chunk_invariants(spark, str(tmp_path)).collect()}
    assert got == {i: (True, True, True) for i in range(4)} | {4: (True, True, None)}


@pytest.mark.parametrize("kind", SPOILED)
def test_wrong_chunks_are_told(spark, root, monkeypatch, kind):
    whole = splitter.chunks

    def spoiled(col, spark=None):
        return SPOILED[kind](whole(col, spark=spark)).cast(PART)

    docs = spark.read.parquet(f"{root}/documents.parquet")
    parts = {r["doc_id"]: [tuple(p) for p in r["p"]] for r in docs.select("doc_id", spoiled("text", spark).alias("p")).collect()}
    want = {i: plain(text, parts[i]) for i, text in enumerate(TEXTS)}
    monkeypatch.setattr(splitter, "chunks", spoiled)
    got = {r["doc_id"]: tuple(r)[1:] for r in chunk_invariants(spark, root).collect()}
    assert got == want
    assert (set(want.values()) == {(True, True, True)}) == (kind == "good")


def test_places_of_a_long_text_are_not_counted_from_its_start(spark, tmp_path):
    """16 million characters: some 23,000 chunks, seconds in blocks and hours by whole text."""
    line = "wörd and more text, here.\n"
    rows = spark.range(1).select(F.lit(1).cast("bigint").alias("doc_id"), F.repeat(F.lit(line), 16_000_000 // len(line)).alias("text"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    assert tuple(chunk_invariants(spark, str(tmp_path)).first()) == (1, True, True, True)
