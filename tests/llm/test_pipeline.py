from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import corpus_pipeline
from gleaner.llm import quality
from helpers import DOCUMENTS, SMALL, corpus, near_components, words
from test_exact_warc_pack import brute_copies, check_packing
from test_shards_mix import brute_targets


def mixed(rows):
    """Rows as often as systematic sampling takes them, source by source."""
    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append(r)
    sizes = {s: sum(len(words(r[1])) for r in own) for s, own in sources.items()}
    target, out = brute_targets(sizes), []
    for s, own in sources.items():
        digest = hashlib.md5(f"mix:{'1' if s is None else '0' + s}".encode()).hexdigest()
        offset, each = int(digest[:3], 16) / 4096 + 1 / 8192, target[s] / sizes[s] if sizes[s] else 0.0
        own.sort(key=lambda r: (len(words(r[1])), hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()))
        for k, r in enumerate(own):
            out += [r] * (math.floor((k + 1) * each + offset) - math.floor(k * each + offset))
    return out


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r["doc_id"] for r in quality.score(docs, labels).filter("predicted = 1").collect()}
    rows = [tuple(r) for r in docs.collect() if r["doc_id"] in good]
    kept = {r[0] for r in brute_copies([r[:2] for r in rows]) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    kept = {r[0] for r in near_components([r[:2] for r in rows], 5, 80) if r[0] == r[2]}
    rows = mixed([r for r in rows if r[0] in kept])
    got = corpus_pipeline.run(spark, SMALL).collect()
    used, least = check_packing([r[:2] for r in rows], got)
    assert used <= 1.03 * least + 2


def test_stages_hand_on_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SMALL)
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        assert 0 < got.count()


def test_stages_on_odd_rows_and_none(spark):
    odd = spark.createDataFrame(corpus(), DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SMALL).count() > 0
        assert stage(spark, odd.limit(0), SMALL).count() == 0
