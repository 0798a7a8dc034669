from __future__ import annotations

import base64
import glob
import gzip
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import exact, packing, warc
from helpers import DOCUMENTS, corpus, lowered


def brute_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        real = [i for i in ids if i is not None]
        keep = max(real) if real else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("first", [1, 32])
def test_copies_against_grouping(spark, monkeypatch, first):
    monkeypatch.setattr(exact, "FIRST_BYTES", first)
    monkeypatch.setattr(exact, "WIDEST_BYTES", 1000)
    rows = corpus() + [(900, "x" * 2999 + "y", "en", "a", 1), (901, "X" * 3000, "en", "a", 1), (902, "É", "en", "a", 1), (903, "é", "en", "a", 1)]
    frame = spark.createDataFrame(rows, DOCUMENTS).withColumn("head", F.lit(1)).withColumn("row", F.lit(1))
    got = exact.copies(frame).drop("mark")
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_copies([r[:2] for r in rows])


def test_copies_of_nothing(spark):
    assert exact.copies(spark.createDataFrame([], DOCUMENTS)).count() == 0


def test_drop_copies_leaves_one_of_each(spark):
    frame = spark.createDataFrame(corpus(), DOCUMENTS)
    left = exact.drop_copies(frame)
    assert left.columns == frame.columns
    got = Counter(lowered(r["text"]) for r in left.collect())
    assert set(got) == {lowered(r[1]) for r in corpus()} and max(got.values()) == 1


PAGES = "page_id long, url string, html string"


def brute_records(rows, least=0):
    groups = defaultdict(list)
    for page_id, _, html in rows:
        body = (html or "").encode()
        if len(body) >= least and page_id is not None:
            groups[body].append(page_id)
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        keep = max(groups.get(body, [page_id or 0])) if page_id is not None and body in groups else page_id
        revisit = page_id is not None and keep != page_id
        out.append((page_id, len(body), digest, "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=repr)


def page_rows():
    draw = random.Random(3)
    rows = [(i, f"http://a/{i}", "".join(draw.choice("ab<é\n\x1f") for _ in range(draw.randrange(0, 3000)))) for i in range(60)]
    rows += [(100 + i, "http://same", "<p>one</p>") for i in range(30)] + [(200, None, None), (201, "u\r\nWARC-Type: x", ""), (-5, "n", "<p>one</p>")]
    rows += [(None, "x", "<p>one</p>"), (None, "y", "only"), (300, "d", "twice"), (300, "d", "twice"), (300, "d", "other"), (400, "long", "z\r\n\r\n" * 400_000)]
    return rows


@pytest.mark.parametrize("size", [700, 64 << 20])
def test_archives_come_back(spark, size):
    rows = page_rows()
    frame = spark.createDataFrame(rows, PAGES).withColumn("bytes", F.lit("own")).repartition(3)
    got = warc.round_trip(frame, range_bytes=size)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_records(rows)


def test_least_size_of_revisits(spark):
    rows = page_rows()
    got = warc.round_trip(spark.createDataFrame(rows, PAGES), revisit_bytes=20)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_records(rows, 20)


def test_payloads_and_files(spark, tmp_path):
    rows = page_rows()
    warc.write(spark.createDataFrame(rows, PAGES), str(tmp_path / "a"))
    files = glob.glob(str(tmp_path / "a" / "part-*"))
    plain = b"".join(gzip.decompress(open(f, "rb").read()) for f in files if os.path.getsize(f))
    assert plain.count(b"WARC/1.1\r\n") == len(rows)
    back = warc.read(spark, str(tmp_path / "a"), 5000).filter("record_type = 'response' AND url = 'http://a/7'").collect()
    assert [bytes(r["payload"]).decode() for r in back] == [rows[7][2]]
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_chance_magic_inside_a_member_is_skipped(spark, tmp_path):
    inner = warc.member(b"no record")
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    record = warc.record(7, "u", inner * 50, warc.digest_of(inner * 50), None)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc.gz").write_bytes(stored.compress(record) + stored.flush() + warc.member(warc.record(8, "v", b"w", "D", None)))
    for size in (40, 333, 1 << 20):
        got = warc.read(spark, str(tmp_path / "b"), size).select("record_id", "payload").collect()
        assert sorted((r["record_id"], bytes(r["payload"])) for r in got) == [("<urn:page:7>", inner * 50), ("<urn:page:8>", b"w")]


def check_packing(rows, got, length=2048):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = sorted({r[1] or "" for r in rows})
    ids = dict(zip(texts, [e.ids + [0] for e in own.encode_batch(texts, add_special_tokens=False)]))
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for doc_id, text in rows:
        whole, start = ids[text or ""], 0
        cuts = [len(whole)] if len(whole) <= length else [len(whole) % length] * (len(whole) % length > 0) + [length] * (len(whole) // length)
        for i, n in enumerate(cuts):
            data = b"".join(x.to_bytes(4, "little") for x in whole[start : start + n])
            want[doc_id].append((i, start, n, zlib.crc32(data)))
            start += n
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    total = sum(n for p in bins.values() for _, n in p)
    return len(bins), -(-total // length)


def test_packing(spark):
    end = "<|endoftext|>"
    odd = [(510, end), (511, "a" + end), (512, "a" + end + "b"), (513, end + end), (514, "a b " * 1500 + end + " tail" * 1200), (515, "word " * 2046 + end + end + "x" * 50)]
    odd = [(i, t, "en", "a", 1) for i, t in odd] + [(516, "<|endoftext|", "en", "a", 1), (517, " <|endoftext|> \n<|ENDOFTEXT|>", "en", "a", 1)]
    odd += [(500, "<|endoftext|> a\u0085b  \x1c c", "en", "a", 1), (501, "don't we'LL 12½ ४२ 漢字かな ​ x", "en", "a", 1), (502, " \n\n  \t x", "en", "a", 1)]
    rows = corpus() + odd
    frame = spark.createDataFrame(rows, DOCUMENTS).withColumn("length", F.lit(1)).withColumn("piece", F.lit(1))
    got = packing.pack(frame).drop("mark")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check_packing([r[:2] for r in rows], got.collect())
    assert packing.pack(frame.limit(0)).count() == 0


def test_packing_is_tight_on_given_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    used, least = check_packing(rows, packing.pack(frame).collect())
    assert used <= 1.003 * least + 1


def test_bins_close_the_fullest_first():
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (7, 5, 4, 3, 8)] == [(0, 0), (1, 0), (1, 5), (0, 7), (2, 0)]
    assert bins.open == 2 and bins.place(9) == (3, 0)  # bin 1, the fullest of the open ones, has closed
    assert bins.place(1) == (3, 9) and bins.place(1) == (2, 8)

