"""Ingest, manifest, upsert and statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner import schemas as S
from gleaner.functions import splitter
from gleaner.functions import text as X
from gleaner.functions.embedding import hash_embedder
from gleaner.operators import stats, upsert
from gleaner.operators.vectors import VectorTable
from gleaner.plans import chunking, ingest, tables
from gleaner.queries.common import case_of, lit, load, load_spread, nth, strip_sql
from gleaner.queries.facts import FACT_SQL, INVOICE_SQL, invoices
from gleaner.queries.text import normal_url_sql
from gleaner.session import fresh_dir, stage
from gleaner.sources import contracts, files
from gleaner.sources.tables import Warehouse, catalog_names
from gleaner.streaming.arrivals import arrival_reports, ingest_arrivals

FILE_ROWS = 100_000

# --- manifest ---------------------------------------------------------------
# Orders stand for files: the old version knows the cheap ones, the new one
# changes the hash of those with status F.


def _versions(spark, root):
    orders = load(spark, root, "orders")
    name = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".csv"))
    old = orders.where(F.col("o_totalprice") < 300000).select(
        name.alias("file_path"), X.table_name(name).alias("table_name"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("file_hash"), F.col("o_custkey").alias("row_count"),
        F.lit("2024-01-01T00:00:00Z").alias("updated_at"),
    )
    changed = F.when(F.col("o_orderstatus") == "F", "x").otherwise("")
    new = orders.select(
        name.alias("file"), X.table_name(name).alias("table_name"),
        F.sha2(F.concat(F.col("o_orderkey").cast("string"), changed), 256).alias("file_hash"),
        (F.col("o_custkey") + 1).alias("row_count"),
    )
    return old, new


def manifest_status(spark, root):
    old, new = _versions(spark, root)
    return tables.manifest_status(new, old).select("file", "table_name", "status")


def manifest_upsert(spark, root):
    old, new = _versions(spark, root)
    changed = tables.manifest_status(new, old).where(F.col("status") != S.STATUS_SAME)
    rows = changed.select(
        F.col("file").alias("file_path"), "table_name", "file_hash", "row_count",
        F.lit("2024-02-02T00:00:00Z").alias("updated_at"),
    )
    return tables.upsert_manifest(old, rows)


_STATUS_SQL = """
files AS (
  SELECT *, 'order_' || o_orderkey || '.csv' AS file, 'order_' || o_orderkey AS table_name,
    sha256(o_orderkey::VARCHAR) AS old_hash,
    sha256(o_orderkey || CASE WHEN o_orderstatus = 'F' THEN 'x' ELSE '' END) AS new_hash, o_totalprice < 300000 AS known
  FROM orders
),
judged AS (
  SELECT *, CASE WHEN NOT known THEN 'Processed' WHEN old_hash = new_hash THEN 'Already processed'
    ELSE 'Re-ingested (changed)' END AS status FROM files
)"""

# --- chunk upserts ----------------------------------------------------------


def _unsplit(spark, root, version: int, where=None) -> DataFrame:
    docs = load(spark, root, "documents")
    docs = docs if where is None else docs.where(where)
    return docs.select(
        nth(S.RETRIEVAL_ORDER, F.col("doc_id") % 4).alias("collection"),
        F.concat("source", F.lit("#chunk="), F.col("doc_id").cast("string")).alias("id"),
        F.col("source"),
        F.md5(F.concat("text", F.lit(str(version)))).alias("document"),
        F.lit(version).alias("version"),
    )


def _two_versions(spark, root):
    """Version 1 of all documents; version 2 of the long ones, written twice."""
    first = _unsplit(spark, root, 1)
    long = F.col("n_chars") > 2000
    again = _unsplit(spark, root, 2, long).unionByName(_unsplit(spark, root, 3, long))
    return first, again


def upsert_chunks(spark, root):
    first, again = _two_versions(spark, root)
    return upsert.upsert_chunks(first, again, ["version"], keep_stale=True)


def upsert_replace_sources(spark, root):
    first, again = _two_versions(spark, root)
    return upsert.upsert_chunks(first, again, ["version"])


def insert_new_only(spark, root):
    stored = _unsplit(spark, root, 1, F.col("n_chars") > 2000)
    return upsert.insert_new(stored, _unsplit(spark, root, 2), ["collection", "id"])


def chunk_lookup(spark, root):
    """Point reads: labelled documents among the chunks, missing ids left out."""
    wanted = load(spark, root, "labels").select((F.col("doc_id") * 2).alias("doc_id"))
    docs = load(spark, root, "documents").select("doc_id", "source", "n_chars")
    return upsert.lookup(docs, wanted, ["doc_id"])


def chunk_table_upsert(spark, root):
    """The stored chunk table: create, replace the sources of one language's
    documents by their first words, add new ids only, move ids to other sources."""
    docs = load(spark, root, "documents")

    def rows(df, text, prefix):
        return df.select(
            nth(S.RETRIEVAL_ORDER, F.col("doc_id") % 4).alias("collection"),
            F.concat(F.lit(prefix), F.col("doc_id").cast("string")).alias("id"),
            F.concat("source", F.lit("/"), "lang").alias("source"), text.alias("document"),
            F.col("doc_id").alias("chunk_no"),
        )

    store = upsert.ChunkTable(spark, fresh_dir(spark, "chunks"), buckets=8)
    store.create(chunking.conform(rows(docs, F.md5("text"), "d")))
    french = docs.where(F.col("lang") == "fr")
    store.upsert(chunking.conform(rows(french.where(F.col("n_chars") > 500), F.lit("rewritten"), "d")))
    mixed = rows(docs, F.lit("new"), "d").unionByName(rows(french, F.lit("extra"), "x"))
    store.add_new(chunking.conform(mixed), lambda df, text, out: df)
    # Some ids move to another source; then none of them is new under a third one.
    moved = rows(docs.where(F.col("doc_id") % 10 == 7), F.lit("moved"), "d")
    place = F.concat(F.lit("moved/"), (F.col("chunk_no") % 50).cast("string"))
    store.upsert(chunking.conform(moved.withColumn("source", place)), keep_stale=True)
    store.add_new(chunking.conform(moved.withColumn("source", F.lit("third"))), lambda df, text, out: df)
    return store.read().select("collection", "id", "source", "document")


def _document_chunks(docs: DataFrame, prefix: str, text) -> DataFrame:
    """One chunk per document; sources by origin and language, record numbers on some."""
    return chunking.conform(
        docs.select(
            nth(S.RETRIEVAL_ORDER, F.col("doc_id") % 4).alias("collection"),
            F.concat(F.lit(prefix), F.col("doc_id").cast("string")).alias("id"),
            F.concat("source", F.lit("/"), "lang").alias("source"), text.alias("document"), F.col("doc_id").alias("chunk_no"),
            F.when(F.col("doc_id") % 3 > 0, F.col("n_chars")).alias("rows"),
        )
    )


def stored_lookup(spark, root):
    """Point reads of stored chunks by id after a create, an upsert and an append; ids that are not stored are left out."""
    docs = load(spark, root, "documents")
    store = upsert.ChunkTable(spark, fresh_dir(spark, "chunks"), buckets=8)
    store.create(_document_chunks(docs, "d", F.md5("text")))
    labelled = docs.join(load(spark, root, "labels").select("doc_id"), "doc_id", "left_semi")
    store.upsert(_document_chunks(labelled, "d", F.lit("rewritten")), keep_stale=True)
    store.add_new(_document_chunks(labelled, "x", F.md5("text")), lambda df, text, out: df)
    wanted = _document_chunks(docs, "d", F.lit("")).unionByName(_document_chunks(docs, "x", F.lit("")))
    return store.lookup(wanted.where(F.col("chunk_no") % 100 == 7)).select("collection", "id", "source", "document")


def index_status(spark, root):
    """Status lines from the figures kept with the table, after a create, an upsert and an append."""
    docs = load(spark, root, "documents")
    store = upsert.ChunkTable(spark, fresh_dir(spark, "chunks"), buckets=8)

    def status(step):
        # Staged: what is kept changes with the next step.
        return stage(store.stats().join(stats.status_lines(store.stats()), "collection").withColumn("step", F.lit(step)), "status")

    long = docs.where(F.col("n_chars") > 500)
    store.create(_document_chunks(long, "d", F.md5("text")))
    first = status("create")
    french = long.where(F.col("lang") == "fr")
    store.upsert(_document_chunks(french.where(F.col("n_chars") > 2000), "d", F.lit("rewritten")))
    second = status("upsert")
    store.add_new(_document_chunks(docs, "d", F.md5("text")), lambda df, text, out: df)
    return first.unionByName(second).unionByName(status("add"))


def embed_once(spark, root):
    """Documents ingested twice, a tenth of them changed: how many texts of each run were embedded, and that all have their vector."""
    docs = load_spread(spark, root, "documents").select("doc_id", "text")
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("changed "), "text")).otherwise(F.col("text")))
    table = VectorTable(spark, fresh_dir(spark, "vectors"))
    embed = table.embedder(hash_embedder())
    runs, before = [], 0
    for run, texts in enumerate((docs, changed), 1):
        found = stage(embed(texts, "text", "vector").groupBy().agg(F.count("*").alias("texts"), F.count_if(F.size("vector") == 64).alias("with_vector")), "run")
        after = table.size()
        runs.append(found.select(F.lit(run).alias("run"), "texts", "with_vector", F.lit(after - before).cast("bigint").alias("embedded")))
        before = after
    return runs[0].unionByName(runs[1])


# --- files ------------------------------------------------------------------


def write_csv_files(df: DataFrame, folder: str) -> None:
    """Write ``df`` as one CSV file per value of its column ``file``."""
    spark = df.sparkSession
    scratch = fresh_dir(spark, "csv")
    columns = [c for c in df.columns if c != "file"]
    rows = df.repartition("file").sortWithinPartitions("file", columns[0])
    rows.write.partitionBy("file").option("header", True).csv(scratch)
    java = spark._jvm.org.apache.hadoop.fs
    base = java.Path(scratch)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(java.Path(folder))
    for entry in system.listStatus(base):
        name = entry.getPath().getName()
        if name.startswith("file="):
            parts = [p.getPath() for p in system.listStatus(entry.getPath()) if p.getPath().getName().startswith("part-")]
            system.rename(parts[0], java.Path(f"{folder}/{name.removeprefix('file=')}"))


_SEGMENT_FILE = "lower(c_mktsegment) || '_' || (c_custkey // {n}) || '.csv'"


def _segment_files(spark: SparkSession, root: str, where=None, bump=None) -> DataFrame:
    """Customers as files: one per segment and range of keys, bounded in rows."""
    customers = load(spark, root, "customer")
    customers = customers if where is None else customers.where(where)
    balance = F.col("c_acctbal")
    if bump is not None:
        balance = F.when(bump, balance + 1).otherwise(balance)
    block = F.floor(F.col("c_custkey") / FILE_ROWS).cast("string")
    name = F.concat(F.lower("c_mktsegment"), F.lit("_"), block, F.lit(".csv"))
    return customers.select("c_custkey", "c_name", "c_nationkey", balance.alias("c_acctbal"), name.alias("file"))


def _two_folders(spark, root, base):
    """First upload lacks the households; the second has all, machinery changed."""
    write_csv_files(_segment_files(spark, root, F.col("c_mktsegment") != "HOUSEHOLD"), f"{base}/v1")
    write_csv_files(_segment_files(spark, root, bump=F.col("c_mktsegment") == "MACHINERY"), f"{base}/v2")


_REPORTS_SQL = f"""
SELECT run, {_SEGMENT_FILE.format(n=FILE_ROWS)} AS file, any_value(status) AS status, count(*) AS rows FROM (
  SELECT 1 AS run, *, 'Processed' AS status FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'
  UNION ALL
  SELECT 2 AS run, *, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Processed' WHEN 'MACHINERY' THEN 'Re-ingested (changed)'
    ELSE 'Already processed' END AS status FROM customer
) GROUP BY run, file"""


def incremental_ingest(spark, root):
    base = fresh_dir(spark, "uploads")
    _two_folders(spark, root, base)
    warehouse = Warehouse(spark, f"{base}/tables")
    first = tables.ingest_folder(warehouse, f"{base}/v1").withColumn("run", F.lit(1))
    second = tables.ingest_folder(warehouse, f"{base}/v2").withColumn("run", F.lit(2))
    return first.unionByName(second).select("run", "file", "status", "rows")


def incremental_stream(spark, root):
    """The same two uploads as arriving files, the second written over the first in place, two runs of one stream."""
    base = fresh_dir(spark, "uploads")
    _two_folders(spark, root, base)
    warehouse = Warehouse(spark, f"{base}/tables")
    java = spark._jvm.org.apache.hadoop.fs
    system = java.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(java.Path(f"{base}/in"))
    for version in ("v1", "v2"):
        for status in system.listStatus(java.Path(f"{base}/{version}")):
            target = java.Path(f"{base}/in/{status.getPath().getName()}")
            system.delete(target, False)
            system.rename(status.getPath(), target)
        ingest_arrivals(warehouse, f"{base}/in/*.csv", f"{base}/checkpoint").awaitTermination()
    return arrival_reports(warehouse).select(
        (F.col("batch_id") + 1).cast("int").alias("run"), "file", "status", "rows"
    )


def plain_folder_load(spark, root):
    """Folder to tables without a manifest; the tables are read back."""
    base = fresh_dir(spark, "uploads")
    write_csv_files(_segment_files(spark, root), f"{base}/deep/er")
    warehouse = Warehouse(spark, f"{base}/tables")
    names = tables.load_folder(warehouse, base)
    parts = [warehouse.read(n).select(F.lit(n).alias("table_name"), "*") for n in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def csv_roundtrip(spark, root):
    """Orders written as CSV files in a nested folder, read back with inferred types."""
    folder = f"{fresh_dir(spark, 'csv')}/a/b"
    orders = load(spark, root, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    orders = orders.withColumn("o_note", F.concat(F.lit('say "'), F.col("o_orderkey").cast("string"), F.lit('", ok')))
    orders.write.option("header", True).option("escape", '"').csv(folder)
    return files.read_csv(spark, folder)


def csv_quoted_breaks(spark, root):
    """Whole texts with line breaks, commas and quotes inside quoted cells, written as CSV and cut into records by ranges."""
    folder = fresh_dir(spark, "csv")
    text = F.replace("text", F.lit(". "), F.lit('.",\n\n "'))
    docs = load(spark, root, "documents").select("doc_id", text.alias("text"), "n_chars")
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.write.options(header=True, escape='"', **spaces).csv(folder)
    read = files.read_csv(spark, folder)
    return read.select("doc_id", "n_chars", F.md5("text").alias("digest"))


def file_hashes(spark, root):
    """File listing and both ways of hashing agree on every file."""
    base = fresh_dir(spark, "uploads")
    write_csv_files(_segment_files(spark, root), base)
    listed = files.list_files(spark, base)
    whole = files.hash_files(spark, base)
    streamed = files.hash_files(spark, base, limit=0).withColumnRenamed("file_hash", "_streamed")
    both = listed.join(whole, "path").join(streamed, "path")
    return both.select(
        "file", "kind", "table_name", (F.col("length") > 0).alias("nonempty"),
        (F.col("file_hash") == F.col("_streamed")).alias("same_hash"),
    )


def catalog_tables(spark, root):
    """Registered tables with their counts."""
    names = ("region", "nation", "supplier", "customer")
    for name in names:
        load(spark, root, name).createOrReplaceTempView(name)
    listed = catalog_names(spark).where(F.col("table_name").isin(*names))
    counts = spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in names))
    return listed.join(counts, "table_name")


def requested_paths(spark, root):
    """Requested documents against a listing that knows the labelled ones."""
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    docs = load(spark, root, "documents")
    moved = F.concat(F.lit("/elsewhere/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    requested = docs.select(F.when(F.col("doc_id") % 2 == 0, path).otherwise(moved).alias("path"))
    listing = load(spark, root, "labels").select(path.alias("path"))
    return files.requested_paths(requested, listing)


# --- reports and statistics -------------------------------------------------


def _labelled(spark, root) -> DataFrame:
    docs = load(spark, root, "documents").join(load(spark, root, "labels"), "doc_id", "left")
    return docs.select(
        nth(S.RETRIEVAL_ORDER, F.coalesce(F.col("quality"), F.lit(2))).alias("collection"),
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("lang") != "de", F.col("source")).alias("source"),
        F.lit(None).cast("bigint").alias("rows"),
    ).unionByName(
        docs.select(
            F.lit(S.TABULAR).alias("collection"), F.concat(F.lit("t"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("id"),
            "source", F.when(F.col("doc_id") % 3 > 0, F.col("n_chars")).alias("rows"),
        )
    )


_LABELLED_SQL = f"""
docs AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)),
chunks AS (
  SELECT {case_of('coalesce(quality, 2)', S.RETRIEVAL_ORDER)} AS collection, doc_id::VARCHAR AS id,
    CASE WHEN lang <> 'de' THEN source END AS source, NULL::BIGINT AS rows FROM docs
  UNION ALL
  SELECT '{S.TABULAR}', 't' || lpad(doc_id::VARCHAR, 12, '0'), source, CASE WHEN doc_id % 3 > 0 THEN n_chars END FROM docs
),
stats AS (
  SELECT n.collection, coalesce(c.chunks, 0)::BIGINT AS chunks, coalesce(c.sources, 0)::BIGINT AS sources,
         coalesce(t.rows, 0)::BIGINT AS rows
  FROM (SELECT unnest([{', '.join(lit(c) for c in S.RETRIEVAL_ORDER)}]) AS collection) n
  LEFT JOIN (SELECT collection, count(*) AS chunks, count(DISTINCT nullif(source, '')) AS sources FROM chunks GROUP BY 1) c
    USING (collection)
  LEFT JOIN (SELECT collection, sum(r) AS rows FROM (
      SELECT collection, source, arg_min(rows, id) AS r FROM chunks
      WHERE collection = '{S.TABULAR}' AND source IS NOT NULL AND rows IS NOT NULL GROUP BY 1, 2) GROUP BY 1) t
    USING (collection)
)"""


def collection_stats(spark, root):
    return stats.collection_stats(_labelled(spark, root))


def index_totals(spark, root):
    return stats.index_totals(stats.collection_stats(_labelled(spark, root)))


def status_lines(spark, root):
    return stats.status_lines(stats.collection_stats(_labelled(spark, root)))


def collection_counts(spark, root):
    return stats.collection_counts(_labelled(spark, root))


def chunks_per_source(spark, root):
    return stats.chunks_per_source(_unsplit(spark, root, 1))


def _report(spark, root) -> DataFrame:
    """Requested: every labelled document's path; found: the documents in it."""
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    requested = load(spark, root, "labels").select(F.concat(F.lit("f"), (F.col("doc_id") * 2).cast("string")).alias("name"))
    chunks = load(spark, root, "documents").where(F.col("lang") == "en").select(name.alias("source"))
    return stats.ingest_report(requested, chunks)


def ingest_report(spark, root):
    return _report(spark, root)


def ingest_totals(spark, root):
    kinds = load(spark, root, "documents").select(
        F.element_at(F.array(F.lit("URLs"), F.lit("PDFs"), F.lit("Images"), F.lit("CSV/XLSX")), (F.col("doc_id") % 4 + 1).cast("int")).alias("kind"),
        (F.col("n_chars") % 5).alias("chunks"),
        F.when(F.col("doc_id") % 4 == 3, F.col("n_chars")).alias("rows"),
    )
    return stats.ingest_totals(kinds)


def count_added(spark, root):
    results = load(spark, root, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, F.col("doc_id")).alias("added"), F.col("toxic").cast("bigint").alias("rows")
    )
    return stats.count_added(results).select("doc_id", "added_total")


# --- composites -------------------------------------------------------------


def _shape(df: DataFrame) -> DataFrame:
    """What a chunk source must look like, per source: count, numbering, size."""
    return df.groupBy("collection", "source").agg(
        (F.count(F.lit(1)) == F.count_distinct("id")).alias("ids_unique"),
        (F.max("chunk_no") == F.count(F.lit(1)) - 1).alias("numbers_dense"),
        (F.min("chunk_no") == 0).alias("from_zero"),
        (F.max(F.length("document")) <= S.CHUNK_SIZE).alias("fits"),
        (F.max(F.size("embedding")) == 64).alias("embedded"),
    )


_SHAPE_TRUE = "true AS ids_unique, true AS numbers_dense, true AS from_zero, true AS fits, true AS embedded"


def ingest_pages(spark, root):
    return _shape(chunking.ingest_pages(contracts.pages(load_spread(spark, root, "pages"))))


def ingest_paged_docs(spark, root):
    pages = contracts.paged(load_spread(spark, root, "documents"), page="doc_id")
    return _shape(chunking.ingest_paged(pages))


def paged_chunk_numbers(spark, root):
    """Running chunk numbers: each page starts where the page before it ended."""
    pages = contracts.paged(load_spread(spark, root, "documents"), page="doc_id")
    chunks = chunking.paged_chunks(pages)
    named = F.concat("source", F.lit("#page="), F.col("page").cast("string"), F.lit("_chunk="), F.col("chunk_no").cast("string"))
    cut = chunks.groupBy("source", "page").agg(
        F.min("chunk_no").alias("lo"), F.max("chunk_no").alias("hi"), F.count("*").alias("n"), F.count_distinct("chunk_no").alias("numbers"),
        F.every(F.col("id") == named).alias("named"),
    )
    before = F.lag("hi").over(Window.partitionBy("source").orderBy("page"))
    return cut.select(
        "source", "page", (F.col("lo") == F.coalesce(before + 1, F.lit(0))).alias("follows"),
        ((F.col("hi") - F.col("lo") + 1 == F.col("n")) & (F.col("numbers") == F.col("n"))).alias("dense"), "named",
    )


def ingest_ocr_text(spark, root):
    rows = invoices(spark, root).select(
        F.concat(F.lit("/scans/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("source"), F.col("t").alias("ocr_text")
    )
    chunks = chunking.ingest_ocr(contracts.ocr(rows))
    return chunks.select(
        "collection", "id", "source", "type", "file", "document",
        F.try_element_at("metadata", F.lit("fact:invoice_number")).alias("invoice_number"),
        F.try_element_at("metadata", F.lit("fact:warranty_months")).alias("warranty_months"),
    )


def ingest_ocr_chunked(spark, root):
    rows = load_spread(spark, root, "documents").select(F.concat(F.lit("/scans/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("source"), F.col("text").alias("ocr_text"))
    chunks = chunking.ingest_ocr(contracts.ocr(rows), split=True)
    return chunks.groupBy("source").agg(
        (F.max("chunk_no") == F.count(F.lit(1)) - 1).alias("numbers_dense"),
        (F.max(F.length("document")) <= S.OCR_CHUNK_SIZE).alias("fits"),
        F.min(F.substring_index("id", ":", 1)).alias("doc_id"),
        F.count_distinct(F.substring_index("id", ":", 1)).alias("doc_ids"),
    )


def _store(spark) -> upsert.ChunkTable:
    return upsert.ChunkTable(spark, fresh_dir(spark, "chunks"), buckets=4)


def rebuilt(parts, start: str, text: str):
    """The text that chunks in order stand for, without blanks: what each adds to those before it."""
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit("").alias("text"))

    def add(so_far, part):
        from_ = F.greatest(so_far["end"] - part[start], F.lit(0))
        end = F.greatest(so_far["end"], part[start] + F.length(part[text]))
        more = F.substring(part[text], (from_ + 1).cast("int"), F.length(part[text]))
        return F.struct(end.cast("bigint").alias("end"), F.concat(so_far["text"], F.translate(more, X.WHITESPACE, "")).alias("text"))

    return F.aggregate(parts, zero, add)["text"]


def stored_paged_docs(spark, root):
    """Pages through one call into the store; the ends of the stored text of each page, and how the report names its source.

    Some pages have no text; where a source has no other, it is reported as failed.
    """
    docs = load_spread(spark, root, "documents")
    source = F.when(F.col("doc_id") % 97 == 5, F.concat(F.lit("broken"), F.col("doc_id").cast("string"))).otherwise(F.col("source"))
    text = F.when(F.col("doc_id") % 97 < 6, None).otherwise(F.col("text"))
    store = _store(spark)
    report = ingest.store_paged(store, contracts.paged(docs.select(source.alias("source"), "doc_id", text.alias("text")), page="doc_id"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "document")))
    pages = store.read().groupBy("source", "page").agg(parts.alias("parts"), F.count("*").alias("n"))
    pages = pages.join(docs.select(F.col("doc_id").alias("page"), "text", splitter.chunks("text", spark=spark).alias("cut")), "page")
    # Stored chunks carry no start; it is that of the cut with their place, and a chunk that is missing anywhere shifts or ends the text.
    placed = F.zip_with("cut", "parts", lambda c, p: F.struct(c["start"].alias("start"), p["document"].alias("text")))
    whole = F.md5(rebuilt(placed, "start", "text")) == F.md5(F.translate("text", X.WHITESPACE, ""))
    pages = pages.select(
        "source", "page", "n", F.left(F.get("parts", F.lit(0))["document"], F.lit(8)).alias("head"),
        F.right(F.element_at("parts", -1)["document"], F.lit(4)).alias("tail"),
        F.forall("parts", lambda p: F.contains(F.col("text"), p["document"])).alias("from_text"),
        ((F.size("cut") == F.size("parts")) & F.coalesce(whole, F.lit(False))).alias("covers"),
    )
    held = pages.groupBy("source").agg(F.sum("n").alias("held"))
    told = report.join(held, report["name"] == held["source"], "left").drop("source")
    return told.join(pages.drop("n"), F.col("name") == F.col("source"), "left").select(
        "name", "page", "head", "tail", "from_text", "covers", "status", "error", (F.col("chunks") == F.coalesce("held", F.lit(0))).alias("all_stored")
    )


def stored_ocr_text(spark, root):
    """Scans through one call into the store: the report."""
    rows = invoices(spark, root).select(
        F.concat(F.lit("/scans/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("source"), F.col("t").alias("ocr_text")
    )
    return ingest.store_ocr(_store(spark), contracts.ocr(rows))


def stored_rows(spark, root):
    """A table into a new store, one record per row: the counts by collection."""
    return ingest.store_rows(_store(spark), load(spark, root, "customer"), "customer.csv", "c_custkey")


def stored_table_text(spark, root):
    """A table's text through one call into the store: its lines read back from the stored chunks, beside the report."""
    store = _store(spark)
    report = ingest.store_table(store, load(spark, root, "orders"), "orders.csv", "o_orderkey")
    parts = store.read().select("source", F.explode(F.split("document", "\n")).alias("line"))
    return parts.join(report, parts["source"] == report["name"]).select("line", "rows", "status").distinct()


def ingest_table_text(spark, root):
    orders = load(spark, root, "orders")
    chunks = chunking.ingest_table_text(orders, "orders.csv", "o_orderkey")
    return chunks.groupBy("source", "rows").agg(
        (F.count(F.lit(1)) == F.count_distinct("id")).alias("ids_unique"),
        (F.max("chunk_no") == F.count(F.lit(1)) - 1).alias("numbers_dense"),
        (F.max(F.length("document")) <= S.CHUNK_SIZE).alias("fits"),
        F.max(F.when(F.col("chunk_no") == 0, F.substring_index("document", "\n", 1))).alias("header"),
        F.count(F.when(F.col("document").startswith("o_orderkey,"), 1)).alias("headers"),
    )


def ingest_table_files(spark, root):
    """Customer files into the chunk store; some asked names are absent."""
    base = fresh_dir(spark, "uploads")
    write_csv_files(_segment_files(spark, root), base)
    known = files.list_files(spark, base)
    wanted = known.select("path").unionByName(
        load(spark, root, "region").select(F.concat(F.lit("/gone/"), F.lower("r_name"), F.lit(".csv")).alias("path"))
    )
    asked = files.requested_paths(wanted, known.select("path"))
    listing = asked.select(
        F.col("found").alias("path"), X.base_name("path").alias("file"), X.extension("path").alias("ext")
    )
    store = upsert.ChunkTable(spark, fresh_dir(spark, "chunks"), buckets=4)
    report = chunking.ingest_table_files(store, listing)
    counted = store.read().groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("stored"))
    return report.join(counted, "name", "left").select(
        "name", "rows", (F.col("chunks") == F.coalesce("stored", F.lit(0))).alias("all_stored"),
        (F.col("chunks") > 0).alias("any"),
    )


def table_text_rows(spark, root):
    """Every CSV line of the table survives whole in its chunks."""
    customers = load(spark, root, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    chunks = chunking.table_chunks(customers, "customer.csv", "c_custkey")
    lines = chunks.select(F.explode(F.split("document", "\n")).alias("line")).where(~F.col("line").startswith("c_custkey"))
    return lines.distinct()


def row_document_index(spark, root):
    rows = load(spark, root, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    chunks = chunking.ingest_rows(rows, "customer", "c_custkey")
    return chunks.select("collection", "id", "source", "document", F.size("embedding").cast("bigint").alias("dim"))


def create_only(spark, root):
    """First write succeeds, a second create of the same table is refused."""
    rows = load(spark, root, "nation").select("n_nationkey", "n_name")
    chunks = chunking.conform(chunking.row_chunks(rows, "nation", "n_nationkey"))
    store = upsert.ChunkTable(spark, fresh_dir(spark, "once"), buckets=8)
    store.create(hash_embedder()(chunks, "document", "embedding"))
    try:
        store.create(chunks)
        refused = False
    except Exception:  # noqa: BLE001
        refused = True
    return store.read().groupBy("source").agg(F.count(F.lit(1)).alias("records")).withColumn("refused", F.lit(refused))


QUERIES = {
    "manifest_status": manifest_status,
    "manifest_upsert": manifest_upsert,
    "upsert_chunks": upsert_chunks,
    "upsert_replace_sources": upsert_replace_sources,
    "insert_new_only": insert_new_only,
    "chunk_lookup": chunk_lookup,
    "chunk_table_upsert": chunk_table_upsert,
    "stored_lookup": stored_lookup,
    "index_status": index_status,
    "embed_once": embed_once,
    "csv_roundtrip": csv_roundtrip,
    "csv_quoted_breaks": csv_quoted_breaks,
    "file_hashes": file_hashes,
    "incremental_ingest": incremental_ingest,
    "incremental_stream": incremental_stream,
    "plain_folder_load": plain_folder_load,
    "catalog_tables": catalog_tables,
    "requested_paths": requested_paths,
    "collection_stats": collection_stats,
    "collection_counts": collection_counts,
    "index_totals": index_totals,
    "status_lines": status_lines,
    "chunks_per_source": chunks_per_source,
    "ingest_report": ingest_report,
    "ingest_totals": ingest_totals,
    "count_added": count_added,
    "ingest_pages": ingest_pages,
    "ingest_paged_docs": ingest_paged_docs,
    "paged_chunk_numbers": paged_chunk_numbers,
    "stored_paged_docs": stored_paged_docs,
    "stored_ocr_text": stored_ocr_text,
    "stored_rows": stored_rows,
    "stored_table_text": stored_table_text,
    "ingest_ocr_text": ingest_ocr_text,
    "ingest_ocr_chunked": ingest_ocr_chunked,
    "ingest_table_text": ingest_table_text,
    "ingest_table_files": ingest_table_files,
    "table_text_rows": table_text_rows,
    "row_document_index": row_document_index,
    "create_only": create_only,
}

_DOCUMENT_CHUNKS_SQL = (
    f"{case_of('doc_id % 4', S.RETRIEVAL_ORDER)} AS collection, doc_id, n_chars, lang, source || '/' || lang AS source, "
    "CASE WHEN doc_id % 3 > 0 THEN n_chars END::BIGINT AS rows"
)


def _status_sql(step: str, rows: str) -> str:
    """Full count of the chunks that ``rows`` selects."""
    return f"""
SELECT '{step}' AS step, n.collection, coalesce(c.chunks, 0)::BIGINT AS chunks, coalesce(c.sources, 0)::BIGINT AS sources, coalesce(t.rows, 0)::BIGINT AS rows
FROM (SELECT unnest([{', '.join(lit(c) for c in S.RETRIEVAL_ORDER)}]) AS collection) n
LEFT JOIN (SELECT collection, count(*) AS chunks, count(DISTINCT source) AS sources FROM ({rows}) GROUP BY 1) c USING (collection)
LEFT JOIN (SELECT collection, sum(r) AS rows FROM (
    SELECT collection, source, arg_min(rows, 'd' || doc_id) AS r FROM ({rows}) WHERE collection = '{S.TABULAR}' AND rows IS NOT NULL GROUP BY 1, 2) GROUP BY 1) t
  USING (collection)"""


_UNSPLIT_SQL = (
    f"{case_of('doc_id % 4', S.RETRIEVAL_ORDER)} AS collection, source || '#chunk=' || doc_id AS id, source"
)
ORACLES = {
    "manifest_status": f"WITH {_STATUS_SQL} SELECT file, table_name, status FROM judged",
    "manifest_upsert": f"""WITH {_STATUS_SQL}
SELECT file AS file_path, table_name, CASE WHEN status = 'Already processed' THEN old_hash ELSE new_hash END AS file_hash,
  CASE WHEN status = 'Already processed' THEN o_custkey ELSE o_custkey + 1 END AS row_count,
  CASE WHEN status = 'Already processed' THEN '2024-01-01T00:00:00Z' ELSE '2024-02-02T00:00:00Z' END AS updated_at
FROM judged""",
    "upsert_chunks": f"SELECT {_UNSPLIT_SQL}, md5(text || v) AS document, v AS version FROM "
    "(SELECT *, CASE WHEN n_chars > 2000 THEN 3 ELSE 1 END AS v FROM documents)",
    "upsert_replace_sources": f"""
WITH base AS (SELECT {_UNSPLIT_SQL}, text, n_chars FROM documents),
hit AS (SELECT DISTINCT collection, source FROM base WHERE n_chars > 2000)
SELECT collection, id, source, md5(text || '3') AS document, 3 AS version FROM base WHERE n_chars > 2000
UNION ALL
SELECT collection, id, source, md5(text || '1') AS document, 1 AS version FROM base
WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.collection = base.collection AND hit.source = base.source)""",
    "insert_new_only": f"SELECT {_UNSPLIT_SQL}, md5(text || '2') AS document, 2 AS version FROM documents WHERE n_chars <= 2000",
    "chunk_lookup": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id * 2 FROM labels)",
    "stored_lookup": f"""
SELECT collection, 'd' || doc_id AS id, source, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'rewritten' ELSE md5(text) END AS document
FROM (SELECT {_DOCUMENT_CHUNKS_SQL}, text FROM documents WHERE doc_id % 100 = 7)
UNION ALL
SELECT collection, 'x' || doc_id, source, md5(text) FROM (SELECT {_DOCUMENT_CHUNKS_SQL}, text FROM documents WHERE doc_id % 100 = 7)
WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "index_status": f"""
WITH base AS MATERIALIZED (SELECT {_DOCUMENT_CHUNKS_SQL} FROM documents),
hit AS (SELECT DISTINCT collection, source FROM base WHERE lang = 'fr' AND n_chars > 2000),
kept AS MATERIALIZED (
  SELECT * FROM base WHERE n_chars > 500 AND (NOT EXISTS (SELECT 1 FROM hit WHERE hit.collection = base.collection AND hit.source = base.source)
    OR (lang = 'fr' AND n_chars > 2000))),
steps AS ({_status_sql('create', 'SELECT * FROM base WHERE n_chars > 500')} UNION ALL {_status_sql('upsert', 'SELECT * FROM kept')}
  UNION ALL {_status_sql('add', 'SELECT * FROM base')})
SELECT step, collection, chunks, sources, rows, collection || ': ' || chunks || ' chunks, ' || sources || ' source(s)'
  || CASE WHEN rows > 0 THEN ' — ~' || rows || ' rows' ELSE '' END AS line FROM steps""",
    "embed_once": """
WITH changed AS (SELECT CASE WHEN doc_id % 10 = 3 THEN 'changed ' || text ELSE text END AS text FROM documents)
SELECT 1 AS run, count(*) AS texts, count(*) AS with_vector, count(DISTINCT text) AS embedded FROM documents
UNION ALL
SELECT 2, count(*), count(*), (SELECT count(DISTINCT text) FROM changed WHERE text NOT IN (SELECT text FROM documents)) FROM changed""",
    "chunk_table_upsert": f"""
WITH base AS (
  SELECT *, {case_of('doc_id % 4', S.RETRIEVAL_ORDER)} AS collection, source || '/' || lang AS src FROM documents
),
hit AS (SELECT DISTINCT collection, src FROM base WHERE lang = 'fr' AND n_chars > 500),
old AS (
  SELECT collection, 'd' || doc_id AS id, src AS source, md5(text) AS document FROM base
  WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.collection = base.collection AND hit.src = base.src)
  UNION ALL
  SELECT collection, 'd' || doc_id, src, 'rewritten' FROM base WHERE lang = 'fr' AND n_chars > 500
)
SELECT * FROM old WHERE substr(id, 2)::BIGINT % 10 <> 7
UNION ALL
SELECT collection, 'd' || doc_id, 'moved/' || (doc_id % 50), 'moved' FROM base WHERE doc_id % 10 = 7
UNION ALL
SELECT collection, 'd' || doc_id, src, 'new' FROM base
WHERE doc_id % 10 <> 7 AND NOT EXISTS (SELECT 1 FROM old WHERE old.collection = base.collection AND old.id = 'd' || doc_id)
UNION ALL
SELECT collection, 'x' || doc_id, src, 'extra' FROM base WHERE lang = 'fr'""",
    "csv_roundtrip": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, "
    "o_orderpriority, 'say \"' || o_orderkey || '\", ok' AS o_note FROM orders",
    "csv_quoted_breaks": f"""
SELECT doc_id, n_chars, md5(CASE WHEN body NOT IN ({", ".join(f"'{w}'" for w in files.MISSING)}) THEN body END) AS digest
FROM (SELECT *, replace(text, '. ', '.",' || chr(10) || chr(10) || ' "') AS body FROM documents)""",
    "file_hashes": f"SELECT DISTINCT {_SEGMENT_FILE.format(n=FILE_ROWS)} AS file, 'table' AS kind, "
    f"lower(c_mktsegment) || '_' || (c_custkey // {FILE_ROWS}) AS table_name, true AS nonempty, true AS same_hash FROM customer",
    "incremental_ingest": _REPORTS_SQL,
    "incremental_stream": _REPORTS_SQL,
    "plain_folder_load": f"SELECT lower(c_mktsegment) || '_' || (c_custkey // {FILE_ROWS}) AS table_name, c_custkey, c_name, "
    "c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer",
    "catalog_tables": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in ("region", "nation", "supplier", "customer")
    ),
    "requested_paths": """
SELECT CASE WHEN d.doc_id % 2 = 0 THEN '/in/' ELSE '/elsewhere/' END || d.doc_id || '.pdf' AS path,
  CASE WHEN l.doc_id IS NOT NULL THEN '/in/' || d.doc_id || '.pdf' END AS found
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""",
    "collection_stats": f"WITH {_LABELLED_SQL} SELECT * FROM stats",
    "collection_counts": f"WITH {_LABELLED_SQL} SELECT collection, chunks FROM stats WHERE chunks > 0",
    "index_totals": f"WITH {_LABELLED_SQL} SELECT sum(chunks)::BIGINT AS chunks, sum(sources)::BIGINT AS sources FROM stats",
    "status_lines": f"WITH {_LABELLED_SQL} SELECT collection, collection || ': ' || chunks || ' chunks, ' || sources || "
    "' source(s)' || CASE WHEN rows > 0 THEN ' — ~' || rows || ' rows' ELSE '' END AS line FROM stats",
    "chunks_per_source": "SELECT source, count(*) AS chunks FROM documents GROUP BY source",
    "ingest_report": """
SELECT coalesce(r.name, c.name) AS name, coalesce(c.n, 0)::BIGINT AS chunks
FROM (SELECT DISTINCT 'f' || (doc_id * 2) AS name FROM labels) r
FULL JOIN (SELECT 'f' || doc_id AS name, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1) c ON r.name = c.name""",
    "ingest_totals": f"SELECT {case_of('doc_id % 4', ('URLs', 'PDFs', 'Images', 'CSV/XLSX'))} AS kind, count(*) AS files, "
    "sum(n_chars % 5)::BIGINT AS chunks, coalesce(sum(CASE WHEN doc_id % 4 = 3 THEN n_chars END), 0)::BIGINT AS rows "
    "FROM documents GROUP BY 1",
    "count_added": "SELECT doc_id, CASE WHEN quality = 1 THEN doc_id ELSE toxic END::BIGINT AS added_total FROM labels",
    "ingest_pages": f"SELECT DISTINCT '{S.URLS}' AS collection, {normal_url_sql('url')} AS source, {_SHAPE_TRUE} FROM pages",
    "ingest_paged_docs": f"SELECT DISTINCT '{S.PDFS}' AS collection, source, {_SHAPE_TRUE} FROM documents "
    f"WHERE {strip_sql('text')} <> ''",
    "paged_chunk_numbers": f"""
SELECT source, doc_id AS page, true AS follows, true AS dense, true AS named FROM documents WHERE {strip_sql('text')} <> ''""",
    "stored_paged_docs": f"""
WITH named AS (
  SELECT CASE WHEN doc_id % 97 = 5 THEN 'broken' || doc_id ELSE source END AS name, doc_id,
    CASE WHEN doc_id % 97 < 6 THEN NULL ELSE text END AS text FROM documents),
pages AS (SELECT name, doc_id AS page, left({strip_sql('text')}, 8) AS head, right({strip_sql('text')}, 4) AS tail,
  true AS from_text, true AS covers FROM named WHERE {strip_sql("coalesce(text, '')")} <> ''),
asked AS (SELECT name, count(text) = 0 AS failed FROM named GROUP BY name)
SELECT name, page, head, tail, from_text, covers, CASE WHEN failed THEN 'Failed' WHEN page IS NULL THEN 'Empty' ELSE '{S.STATUS_NEW}' END AS status,
  CASE WHEN failed THEN 'no text' END AS error, true AS all_stored
FROM asked LEFT JOIN pages USING (name)""",
    "stored_ocr_text": f"""
SELECT '/scans/' || o_orderkey || '.png' AS name, 0::BIGINT AS rows, 1::BIGINT AS chunks, length(t)::BIGINT AS ocr_chars,
  left(replace(t, chr(10), ' '), {S.OCR_PREVIEW_CHARS}) AS ocr_preview, '{S.STATUS_NEW}' AS status, NULL::VARCHAR AS error
FROM (SELECT o_orderkey, {INVOICE_SQL} AS t FROM orders)""",
    "stored_rows": f"SELECT '{S.TABULAR}' AS collection, count(*) AS chunks FROM customer",
    "stored_table_text": f"""
WITH lines AS (
  SELECT o_orderkey || ',' || o_custkey || ',' || o_orderstatus || ',' || o_totalprice || ',' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ',' || o_orderpriority AS line FROM orders
  UNION ALL SELECT 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority')
SELECT DISTINCT line, (SELECT count(*) FROM orders) AS rows, '{S.STATUS_NEW}' AS status FROM lines""",
    "ingest_ocr_text": f"""
SELECT '{S.IMAGES}' AS collection, '/scans/' || o_orderkey || '.png#img_chunk=0' AS id, '/scans/' || o_orderkey || '.png' AS source,
  'image' AS type, o_orderkey || '.png' AS file, t AS document, {FACT_SQL['invoice_number']} AS invoice_number,
  {FACT_SQL['warranty_months']} AS warranty_months
FROM (SELECT o_orderkey, {INVOICE_SQL} AS t FROM orders)""",
    "ingest_ocr_chunked": "SELECT '/scans/' || doc_id || '.png' AS source, true AS numbers_dense, true AS fits, "
    "sha1('/scans/' || doc_id || '.png|' || trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\x{a0}]+', ' ', 'g'))) AS doc_id, "
    f"1::BIGINT AS doc_ids FROM documents WHERE {strip_sql('text')} <> ''",
    "ingest_table_text": "SELECT 'orders.csv' AS source, count(*) AS rows, true AS ids_unique, true AS numbers_dense, "
    "true AS fits, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS header, 1::BIGINT AS headers FROM orders",
    "ingest_table_files": f"SELECT {_SEGMENT_FILE.format(n=FILE_ROWS)} AS name, count(*) AS rows, true AS all_stored, "
    "true AS \"any\" FROM customer GROUP BY 1 UNION ALL SELECT lower(r_name) || '.csv', 0, true, false FROM region",
    "table_text_rows": "SELECT concat_ws(',', c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal) AS line FROM customer",
    "row_document_index": f"SELECT '{S.TABULAR}' AS collection, 'id' || (row_number() OVER (ORDER BY c_custkey) - 1) AS id, "
    "'customer' AS source, 'c_custkey: ' || c_custkey || ',' || chr(10) || 'c_name: ' || c_name || ',' || chr(10) || "
    "'c_mktsegment: ' || c_mktsegment || ',' || chr(10) || 'c_acctbal: ' || c_acctbal || ',' || chr(10) AS document, 64::BIGINT AS dim FROM customer",
    "create_only": "SELECT 'nation' AS source, count(*) AS records, true AS refused FROM nation",
}
