from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gleaner.llm import mixing, sharding
from helpers import DOCUMENTS, SMALL, corpus, words


def docs(spark):
    return spark.createDataFrame(corpus(), DOCUMENTS).withColumn("stratum", F.lit("own")).withColumn("shard", F.lit(9)).withColumn("size", F.lit(9))


def check_shards(rows, got, count):
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == sorted((r[0] is None, r[0]) for r in rows)
    sizes = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sizes
    shards = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        shards[r["shard"]].append(r["slot"])
    counts = [len(shards[s]) for s in range(count)]
    assert max(counts) - min(counts) <= 1
    for slots in shards.values():
        assert sorted(slots) == list(range(len(slots)))


def test_shards_hold_the_law_and_the_mixture(spark):
    rows = corpus()
    got = sharding.shards(docs(spark)).collect()
    assert sharding.shards(docs(spark)).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check_shards(rows, got, 8)
    source = {r[0]: r[3] for r in rows}
    per = Counter((r["shard"], source[r["doc_id"]]) for r in got)
    for name, n in Counter(r[3] for r in rows).items():
        assert all(abs(per[(s, name)] - n / 8) <= 2 for s in range(8))


def test_given_documents_and_reruns(spark):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    got = sharding.shards(frame).collect()
    check_shards(rows, got, 8)
    again = sharding.shards(frame.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_shards_of_few_rows_and_none(spark):
    few = spark.createDataFrame(corpus()[:3], DOCUMENTS)
    check_shards(corpus()[:3], sharding.shards(few).collect(), 8)
    assert sharding.shards(few.limit(0)).count() == 0


def brute_targets(sizes):
    """By repeated resharing of the excess."""
    names = sorted([n for n in sizes if n is not None]) + ([None] if None in sizes else [])
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[n] for n in full)
        open_ = sum(weight[n] for n in names if n not in full)
        target = {n: 3.0 * sizes[n] if n in full else left * weight[n] / open_ for n in names}
        above = {n for n in names if target[n] > 3 * sizes[n]}
        if not above:
            return target
        full |= above


def check_mix(rows, got):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target = brute_targets(sizes)
    source = {(r[0], len(words(r[1]))): r[3] for r in rows}
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        name = source[(r["doc_id"], r["size"])]
        assert r["source_size"] == sizes[name] and abs(r["target"] - target[name]) <= 1e-6 * max(1, target[name])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[name] += r["taken"]
        longest[name] = max(longest[name], r["size"])
    for name in sizes:
        assert abs(taken[name] - target[name]) <= 2 * longest[name] + 1


def test_mix_meets_targets(spark):
    got = mixing.mix(docs(spark)).collect()
    check_mix(corpus(), got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs(spark).repartition(7)).collect()))
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in frame.select("doc_id", "text", "lang", "source").collect()]
    check_mix(rows, mixing.mix(frame).collect())


def test_small_sources_stop_at_three_times(spark):
    rows = [(1, "a b c", "en", "a", 1), (2, "d " * 500, "en", "b", 1), (3, "e", "en", "c", 1), (4, None, "en", "d", 1)]
    got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert got[1]["taken"] == 9 and got[3]["taken"] == 3 and got[4]["taken"] == 0 and got[2]["target"] == 504 - 12


def test_applied_mix_repeats_rows(spark):
    frame = docs(spark)
    taken = Counter()
    for r in mixing.mix(frame).collect():
        taken[r["doc_id"]] += r["copies"]
    left = mixing.apply_mix(frame)
    assert left.columns == frame.columns
    assert Counter(r["doc_id"] for r in left.collect()) == +taken
    assert mixing.apply_mix(frame.limit(0)).count() == 0
