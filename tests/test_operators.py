from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner import schemas as S
from gleaner.functions.embedding import hash_embedder
from gleaner.operators import best as kernel
from gleaner.operators import coarse
from gleaner.operators import nearest as N
from gleaner.operators import numbering, stats, upsert
from gleaner.plans import chunking
from gleaner.plans.answer import answer_questions
from gleaner.plans.sql import ReadOnly, check_read_only, run_sql, try_sql

# --- numbering --------------------------------------------------------------


def hot_rows(spark):
    """One key holds half of the rows, order values are sparse and negative too."""
    rng = np.random.default_rng(5)
    orders = rng.choice(10**7, 600, replace=False) - 10**6
    return spark.createDataFrame(
        [("hot" if i % 2 else f"k{i % 7}", int(o), int(i % 5)) for i, o in enumerate(orders)], "k string, o long, v long"
    )


@pytest.mark.parametrize("partitions", [1, 8])
def test_prefix_sum(spark, partitions):
    df = hot_rows(spark).repartition(partitions)
    got = numbering.prefix_sum(df, ["k"], "o", "v", "before")
    want, seen = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r["k"], r["o"])):
        want[r["k"], r["o"]] = seen.get(r["k"], 0)
        seen[r["k"]] = seen.get(r["k"], 0) + r["v"]
    assert {(r["k"], r["o"]): r["before"] for r in got.collect()} == want


def test_number_rows_without_key(spark):
    got = numbering.number_rows(hot_rows(spark), [], "o", "n").orderBy("o").collect()
    assert [r["n"] for r in got] == list(range(600))


def test_next_row_crosses_buckets(spark):
    df = hot_rows(spark)
    got = {(r["k"], r["o"]): r["next_v"] for r in numbering.next_row(df, ["k"], "o", ["v"]).collect()}
    rows = sorted(df.collect(), key=lambda r: (r["k"], r["o"]))
    want = {
        (a["k"], a["o"]): (b["v"] if b is not None and b["k"] == a["k"] else None) for a, b in zip(rows, [*rows[1:], None])
    }
    assert got == want


# --- nearest ----------------------------------------------------------------


def corpus(spark, n=900, dim=6, partitions=8, seed=1):
    """Vectors with many exact copies: a third of all rows are one vector."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-2, 3, (n, dim)).astype(float)
    base[::3] = 1.0
    rows = [
        (S.RETRIEVAL_ORDER[i % 4], f"id{i:05d}", f"s{i % 5}" if i % 11 else "", "" if i % 13 == 0 else f"text {i}", v.tolist())
        for i, v in enumerate(base)
    ]
    schema = "collection string, id string, source string, document string, embedding array<float>"
    return spark.createDataFrame(rows, schema).repartition(partitions), rows


def questions(spark, n=12, dim=6):
    rng = np.random.default_rng(9)
    rows = [(i, f"q{i}", rng.integers(-2, 3, dim).astype(float).tolist()) for i in range(n - 1)]
    rows.append((n - 1, "copy", [1.0] * dim))
    return spark.createDataFrame(rows, "qid long, question string, vector array<double>"), rows


def brute(rows, vector, k, order):
    scored = [(round(sum((a - b) ** 2 for a, b in zip(r[4], vector)), 9), order.index(r[0]), r[1]) for r in rows]
    return [i for _, _, i in sorted(scored)[:k]]


@pytest.mark.parametrize("partitions", [1, 8])
def test_nearest_equals_brute_force(spark, partitions):
    chunks, rows = corpus(spark, partitions=partitions)
    asked, asked_rows = questions(spark)
    got = {}
    for r in N.nearest(chunks, asked, 7).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == {q: brute(rows, v, 7, S.RETRIEVAL_ORDER) for q, _, v in asked_rows}


def test_nearest_in_several_passes_and_cells(spark, monkeypatch):
    chunks, rows = corpus(spark)
    asked, asked_rows = questions(spark)
    monkeypatch.setattr(N, "BLOCK_ROWS", 3)
    got = {}
    for r in N.nearest(chunks, asked, 4).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == {q: brute(rows, v, 4, S.RETRIEVAL_ORDER) for q, _, v in asked_rows}


def test_best_takes_small_steps(monkeypatch):
    """Batches are cut so that questions x rows stays bounded; the result is the same."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    vectors, asked = rng.normal(size=(50, 4)), rng.normal(size=(3, 4))
    ids = pa.array([f"{i:03d}" for i in range(50)])
    names = pa.array(["c"] * 50)
    sources = pa.array(["s"] * 50)
    kept = []
    for cells in (10, 10**6):
        monkeypatch.setattr(kernel, "CELLS", cells)
        best = kernel.Best(asked, 5)
        best.offer(np.arange(3), vectors, np.zeros(50, int), names, ids, sources)
        kept.append(best.kept)
    assert kept[0] == kept[1]


def test_nearest_in_source_equals_brute_force(spark):
    chunks, rows = corpus(spark)
    asked, asked_rows = questions(spark)
    probes = asked.select(
        F.concat_ws("|", "qid", F.lit("s2")).alias("qid"), F.lit("s2").alias("source"), "vector"
    ).unionByName(asked.select(F.concat_ws("|", "qid", F.lit("none")).alias("qid"), F.lit("none").alias("source"), "vector"))
    got = {}
    for r in N.nearest_in_source(chunks, probes, 3).orderBy("qid", "snippet_no").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    want = {}
    for q, _, v in asked_rows:
        fetched = []
        for name in S.SNIPPET_ORDER:
            own = [r for r in rows if r[0] == name and r[2] == "s2"]
            fetched += [r for i in brute(own, v, 5, S.SNIPPET_ORDER) for r in own if r[1] == i]
        want[f"{q}|s2"] = brute([r for r in fetched if r[3].strip()], v, 3, S.SNIPPET_ORDER)
    assert got == want


def test_approx_recall_and_completeness(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(10, 8))
    rows = [("ti_urls", f"i{i:04d}", "s", "t", (centers[i % 10] + 0.05 * rng.normal(size=8)).tolist()) for i in range(600)]
    chunks = spark.createDataFrame(rows, "collection string, id string, source string, document string, embedding array<float>")
    asked = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "qid long, vector array<double>")
    exact = {(r["qid"], r["id"]) for r in N.nearest(chunks, asked, 5).collect()}
    found = {(r["qid"], r["id"]) for r in coarse.nearest_approx(chunks, asked, 5).collect()}
    assert len(found) == 50
    assert len(exact & found) >= 45


def test_no_hits(spark):
    chunks, _ = corpus(spark)
    asked, _ = questions(spark)
    rows = answer_questions(chunks.where("id = 'x'"), asked).collect()
    assert {r["answer"] for r in rows} == {"I couldn't find anything relevant in your indexed sources."}
    assert all(len(r["cites"]) == 0 for r in rows) and len(rows) == 12


def test_embedding_is_unit_length(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string")
    got = [r["v"] for r in hash_embedder(16)(df, "t", "v").select("v").collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-6
    assert set(got[1]) == {0.0} and len(got[2]) == 16


# --- upserts and the chunk table --------------------------------------------


def chunk_rows(spark, source, n, word, collection="ti_urls"):
    rows = [(collection, f"{source}#chunk={i}", source, i, f"{word}{i}") for i in range(n)]
    return chunking.conform(
        spark.createDataFrame(rows, "collection string, id string, source string, chunk_no long, document string")
    )


def stored(table):
    return sorted((r["id"], r["document"]) for r in table.read().collect())


def test_chunk_table_is_idempotent_and_drops_stale(spark, tmp_path):
    table = upsert.ChunkTable(spark, str(tmp_path / "t"), buckets=4)
    both = chunk_rows(spark, "a", 5, "x").unionByName(chunk_rows(spark, "b", 3, "y"))
    assert table.upsert(both) == 8
    first = stored(table)
    assert table.upsert(both) == 8
    assert stored(table) == first
    table.upsert(chunk_rows(spark, "a", 2, "z"))
    assert stored(table) == sorted([("a#chunk=0", "z0"), ("a#chunk=1", "z1")] + [r for r in first if r[0].startswith("b")])
    table.upsert(chunk_rows(spark, "b", 1, "w"), keep_stale=True)
    assert ("b#chunk=0", "w0") in stored(table) and ("b#chunk=2", "y2") in stored(table)


def test_add_new_counts_only_new(spark, tmp_path):
    table = upsert.ChunkTable(spark, str(tmp_path / "t"), buckets=4)
    embed = hash_embedder(8)
    assert table.add_new(chunk_rows(spark, "a", 3, "x"), embed) == 3
    assert table.add_new(chunk_rows(spark, "a", 5, "y"), embed) == 2
    assert [d for _, d in stored(table)] == ["x0", "x1", "x2", "y3", "y4"]
    assert table.add_new(chunk_rows(spark, "a", 5, "y"), embed) == 0


def test_last_write_wins(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("j", 1, "z")], "k string, v int, d string")
    assert sorted(map(tuple, upsert.last_write(rows, ["k"], ["v"]).collect())) == [("j", 1, "z"), ("k", 3, "c")]


def test_paged_numbers_run_over_the_source(spark):
    pages = spark.createDataFrame([("s", 1, "a" * 1500), ("s", 2, "short"), ("s", 9, "b" * 900), ("t", 0, "x")], "source string, page long, text string")
    got = {r["id"] for r in chunking.paged_chunks(pages).collect()}
    assert got == {"s#page=1_chunk=0", "s#page=1_chunk=1", "s#page=1_chunk=2", "s#page=2_chunk=3", "s#page=9_chunk=4", "s#page=9_chunk=5", "t#page=0_chunk=0"}


TABLE_ROWS = {
    "short": [(i, f'va"l,{i}' if i % 3 else None, i / 4) for i in range(150)],
    "long": [(i, "word " * (40 * (i % 9)) + "x" * (900 if i % 17 == 5 else 3), i / 4) for i in range(60)],
    "blank": [(i, ("a\n\nb" if i % 7 == 1 else "c\nd") * (i % 5 + 1) + ("y " * 500 if i % 13 == 4 else ""), i / 4) for i in range(120)],
    "few": [(1, "a", 0.5)],
}


@pytest.mark.parametrize("kind", list(TABLE_ROWS))
def test_table_chunks_equal_the_whole_text(spark, kind):
    from gleaner.functions.splitter import split_text

    df = spark.createDataFrame(TABLE_ROWS[kind], "k long, name string, x double")
    text = df.toPandas().to_csv(index=False)
    for block in (50, 700, 5_000, 1 << 20):
        cut = chunking.table_chunks(df, "f.csv", "k", block).orderBy("chunk_no").collect()
        assert [r["document"] for r in cut] == [c for _, c in split_text(text)], block
        assert [r["chunk_no"] for r in cut] == list(range(len(cut))) and {r["rows"] for r in cut} == {len(TABLE_ROWS[kind])}


def test_stats_of_absent_collections(spark):
    rows = stats.collection_stats(chunk_rows(spark, "a", 3, "x")).collect()
    assert {(r["collection"], r["chunks"], r["sources"]) for r in rows} == {("ti_urls", 3, 1), ("ti_pdfs", 0, 0), ("ti_images", 0, 0), ("ti_tabular_docs", 0, 0)}


# --- SQL text ---------------------------------------------------------------


@pytest.mark.parametrize("statement", ["select 1", "WITH x AS (SELECT 1) SELECT * FROM x", "VALUES (1)", "-- c\nSELECT 'insert into t'", "(select 1)", "SHOW TABLES", "EXPLAIN SELECT 1"])
def test_reading_statements(spark, statement):
    check_read_only(spark, statement)


@pytest.mark.parametrize("statement", ["insert into t values (1)", "DROP TABLE t", "with x as (select 1) insert into t select * from x", "update t set a = 1", "delete from t", "", "/* select */ create table t (a int)", "with c as (select 1) update t as x set a = 1", "merge into t using s on t.a = s.a when matched then delete", "from s insert into t select *", "set a = 1", "cache table t", "select 1; drop table t"])
def test_writing_statements(spark, statement):
    with pytest.raises(ReadOnly):
        check_read_only(spark, statement)


def test_sql_cap_and_error(spark):
    assert run_sql(spark, "SELECT id FROM range(200)").count() == 50
    assert run_sql(spark, "SELECT id FROM range(200)", rows=None).count() == 200
    assert str(try_sql(spark, "SELECT nope FROM range(1)")).startswith("SQL error: ")
    assert str(try_sql(spark, "DROP TABLE x")).startswith("SQL error: ")


def test_introspection(spark):
    spark.range(3).selectExpr("id", "CAST(id AS STRING) AS name").createOrReplaceTempView("shown")
    assert [tuple(r)[:2] for r in run_sql(spark, "DESCRIBE TABLE shown").collect()] == [("id", "bigint"), ("name", "string")]
    assert "Range" in run_sql(spark, "EXPLAIN FORMATTED SELECT * FROM shown").head()[0]
    assert "shown" in {r["tableName"] for r in run_sql(spark, "SHOW TABLES").collect()}


# --- retrieval on odd input -------------------------------------------------


def test_unusable_vectors_and_mixed_widths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("ti_pdfs", f"g{i}", "s", "t", [float(i), 0.0]) for i in range(6)] + [("ti_pdfs", f"w{i}", "s", "t", [float(i), 0.0, 1.0]) for i in range(3)]
    rows += [("ti_pdfs", "n", "s", "t", [nan, 0.0]), ("ti_pdfs", "z", "s", "t", [None, 0.0]), ("ti_pdfs", "i", "s", "t", [inf, 0.0]), ("ti_pdfs", "e", "s", "t", []), ("ti_pdfs", "x", "s", "t", None)]
    chunks = spark.createDataFrame(rows, "collection string, id string, source string, document string, embedding array<double>")
    asked = spark.createDataFrame([(1, [0.2, 0.0]), (2, [1.9, 0.0, 1.0]), (3, [nan, 0.0]), (4, None)], "qid long, vector array<double>")
    got = {}
    for r in N.nearest(chunks, asked, 3).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == {1: ["g0", "g1", "g2"], 2: ["w2", "w1", "w0"]}
    probes = asked.select(F.col("qid").cast("string").alias("qid"), F.lit("s").alias("source"), "vector")
    found = sorted((r["qid"], r["snippet_no"], r["id"]) for r in N.nearest_in_source(chunks, probes, 2).collect())
    assert found == [("1", 1, "g0"), ("1", 2, "g1"), ("2", 1, "w2"), ("2", 2, "w1")]


def test_one_id_under_two_sources_and_blank_texts(spark):
    rows = [("ti_pdfs", "a", "s", "right", [0.0]), ("ti_pdfs", "a", "t", "other", [5.0]), ("ti_pdfs", "b", "s", " \t\n", [1.0])]
    chunks = spark.createDataFrame(rows, "collection string, id string, source string, document string, embedding array<double>")
    asked = spark.createDataFrame([(1, [0.0])], "qid long, vector array<double>")
    assert [(r["rank"], r["document"]) for r in N.nearest(chunks, asked, 1).collect()] == [(1, "right")]
    probes = asked.select(F.lit("p").alias("qid"), F.lit("s").alias("source"), "vector")
    assert [r["id"] for r in N.nearest_in_source(chunks, probes, 3).collect()] == ["a"]


def test_snippets_of_a_stored_table_read_their_bucket_only(spark, tmp_path):
    table = upsert.ChunkTable(spark, str(tmp_path / "t"), buckets=8)
    table.upsert(chunk_rows(spark, "a", 5, "x").unionByName(chunk_rows(spark, "b", 3, "y")).drop("embedding").withColumn("embedding", F.array(F.col("chunk_no").cast("float"))))
    probes = spark.createDataFrame([("p", "a", [2.2])], "qid string, source string, vector array<double>")
    found = N.nearest_in_source(table.read(), probes, 2, buckets=8)
    assert [r["id"] for r in found.orderBy("snippet_no").collect()] == ["a#chunk=2", "a#chunk=3"]
    assert "dynamicpruning" in found._jdf.queryExecution().toString().lower()


def test_an_id_moves_between_sources(spark, tmp_path):
    table = upsert.ChunkTable(spark, str(tmp_path / "t"), buckets=8)
    table.upsert(chunk_rows(spark, "a", 3, "x"))
    moved = chunk_rows(spark, "a", 2, "y").withColumn("source", F.lit("elsewhere"))
    table.upsert(moved)
    assert stored(table) == [("a#chunk=0", "y0"), ("a#chunk=1", "y1"), ("a#chunk=2", "x2")]
    assert table.add_new(chunk_rows(spark, "a", 3, "z").withColumn("source", F.lit("third")), hash_embedder(8)) == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        upsert.ChunkTable(spark, str(tmp_path / "broken")).read().collect()


def test_sparse_orders_are_spread_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be one range
    rows = spark.range(20_000).select(F.xxhash64("id").alias("o"), F.lit(1).alias("v"))
    ranged = numbering._ranged(rows, ["o"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    counts = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(counts) > 1 and max(counts) < 3 * 20_000 / len(counts)
    got = numbering.number_rows(rows, [], "o", "n").orderBy("o").select("n").collect()
    assert [r["n"] for r in got] == list(range(20_000))


def test_composites_store_and_report(spark, tmp_path):
    from gleaner.plans import ingest

    store = upsert.ChunkTable(spark, str(tmp_path / "t"), buckets=2)
    pages = spark.createDataFrame([("a", 1, "one"), ("a", 1, "two"), ("b", None, None), ("c", 3, " "), (None, 1, "x")], "source string, page long, text string")
    got = {r["name"]: (r["chunks"], r["status"], r["error"]) for r in ingest.store_paged(store, pages).collect()}
    assert got == {"a": (2, "Processed", None), "b": (0, "Failed", "no text"), "c": (0, "Empty", None), None: (0, "Failed", "no text")}
    assert {r["id"] for r in store.read().collect()} == {"a#page=1_chunk=0", "a#page=1_chunk=1"}
