"""Text functions, page decoding, chunking and file names."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import functions as F

from gleaner import schemas as S
from gleaner.functions import markup, splitter
from gleaner.functions import text as X
from gleaner.queries.common import WS, lit, load, load_spread, preview_sql, strip_sql
from gleaner.sources import contracts

# --- urls -------------------------------------------------------------------

_DECORATED = (
    "CASE page_id % 5 WHEN 0 THEN url || '/' WHEN 1 THEN chr(9) || url || '?GCLID=a%b' "
    "WHEN 2 THEN url || '/?utm_campaign=x&q=2' WHEN 3 THEN ' ' || url || '&fbclid=' ELSE url END"
)


def _urls(spark, root):
    url, number = F.col("url"), F.col("page_id") % 5
    decorated = (
        F.when(number == 0, F.concat(url, F.lit("/")))
        .when(number == 1, F.concat(F.lit("\t"), url, F.lit("?GCLID=a%b")))
        .when(number == 2, F.concat(url, F.lit("/?utm_campaign=x&q=2")))
        .when(number == 3, F.concat(F.lit(" "), url, F.lit("&fbclid=")))
        .otherwise(url)
    )
    return load(spark, root, "pages").select("page_id", decorated.alias("url"))


def normal_url_sql(expression: str) -> str:
    cut = f"regexp_replace({strip_sql(expression)}, {lit('[?&](utm_[^=]+|gclid|fbclid)=[^&]+')}, '', 'gi')"
    return f"CASE WHEN ends_with({cut}, '/') THEN left({cut}, length({cut}) - 1) ELSE {cut} END"


def url_normalize(spark, root):
    return _urls(spark, root).select("page_id", X.normalize_url("url").alias("url"))


def url_dedupe(spark, root):
    """Pages fetched twice under spellings of one URL, stored twice, or without a position: the first by position stays."""
    mark = F.concat(F.lit("<p>"), F.col("page_id").cast("string"), F.lit("</p>")).alias("html")
    plain = load(spark, root, "pages").select((F.col("page_id") * 2 + 1).alias("page_id"), "url")
    spelled = _urls(spark, root).select((F.col("page_id") * 2).alias("page_id"), "url")
    lost = plain.select(F.lit(None).cast("bigint").alias("page_id"), F.concat("url", F.lit("/lost")).alias("url"))
    mark = F.coalesce(mark, F.lit("<p>-1</p>")).alias("html")
    fetched = plain.unionByName(plain).unionByName(spelled).unionByName(lost).unionByName(lost).select("page_id", "url", mark)
    return contracts.pages(fetched).select("source", F.col("text").cast("bigint").alias("first_page"))


def url_list_split(spark, root):
    pages = load(spark, root, "pages")
    typed = F.concat(F.col("url"), F.lit(", "), F.col("page_id").cast("string"), F.lit("\n\n , x\t,"), F.col("url"))
    parts = pages.select("page_id", F.posexplode(X.split_urls(typed)).alias("pos", "url"))
    return parts.select("page_id", F.col("pos").cast("bigint").alias("pos"), "url")


# --- pages ------------------------------------------------------------------


def pages_to_docs(spark, root):
    """Every page's text; rows stored again, or without a position, change nothing."""
    pages = load_spread(spark, root, "pages")
    again = pages.where("page_id % 5 = 0").unionByName(pages.where("page_id % 7 = 0").withColumn("page_id", F.lit(None).cast("bigint")))
    return contracts.pages(pages.unionByName(again)).select(
        "source", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars")
    )


def pages_meta(spark, root):
    html = F.col("html")
    return load_spread(spark, root, "pages").select(
        "page_id", markup.page_title(html).alias("title"), markup.page_language(html).alias("language")
    )


def _unescape_sql(expression: str) -> str:
    names = "MAP {" + ", ".join(f"{lit(n)}: chr({cp})" for n, cp in name2codepoint.items()) + "}"
    ref = "regexp_extract(p, '^([a-zA-Z][a-zA-Z0-9]*);', 1)"
    piece = (
        f"CASE WHEN i = 1 THEN p WHEN {ref} = '' THEN '&' || p "
        f"ELSE coalesce({names}[{ref}] || substring(p, length({ref}) + 2), '&' || p) END"
    )
    return f"array_to_string(list_transform(string_split({expression}, '&'), lambda p, i: {piece}), '')"


_FIRST_PAGES_SQL = f"""
firsts AS (
  SELECT url AS source, html FROM (
    SELECT {normal_url_sql('url')} AS url, html, row_number() OVER (PARTITION BY {normal_url_sql('url')} ORDER BY page_id) AS n FROM pages
  ) WHERE n = 1 AND url <> ''
)"""
_TEXT_SQL = _unescape_sql(
    "regexp_replace(regexp_replace(regexp_replace(html, "
    f"{lit(markup.HIDDEN)}, '', 'g'), {lit(markup.COMMENT)}, '', 'g'), {lit(markup.TAG)}, '', 'g')"
)

# --- chunks -----------------------------------------------------------------


# Spark finds a character by counting from the start of its text, so many places of a long text are looked up in blocks of it.
BLOCK_CHARS = 1024


def _blocks(text: str):
    return F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{BLOCK_CHARS}}}+"), F.lit(0))


def _between(blocks, lo, hi):
    """The characters from ``lo`` to before ``hi`` of the text in ``blocks``; none where ``hi`` is not behind ``lo``."""
    lo = F.greatest(lo, F.lit(0))
    first = F.floor(lo / BLOCK_CHARS).cast("int")
    count = F.greatest(F.floor(hi / BLOCK_CHARS) - first, F.lit(0)).cast("int") + 1
    near = F.array_join(F.slice(blocks, first + 1, count), "")
    return F.substring(near, (lo % BLOCK_CHARS + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))


def _end(part):
    return part["start"] + F.length(part["chunk"])


def chunk_invariants(spark, root):
    """Per document: chunks fit, sit where they say, and cover all text; a blank document has none to check."""
    docs = load_spread(spark, root, "documents").select("doc_id", "text")
    cut = docs.select(
        "doc_id", F.length("text").alias("chars"), _blocks("text").alias("blocks"), splitter.chunks("text", spark=spark).alias("parts")
    )
    parts, blocks = F.col("parts"), F.col("blocks")

    def blank(lo, hi):
        return F.btrim(_between(blocks, lo, hi), F.lit(X.WHITESPACE)) == ""

    def gap(p, i):
        """Only blanks lie between the end so far and this chunk's start."""
        before = F.when(i == 0, F.lit(0)).otherwise(_end(F.get(parts, i - 1)))
        return (p["start"] <= before) | blank(before, p["start"])

    last = F.coalesce(_end(F.get(parts, F.size(parts) - 1)), F.lit(0))
    return cut.select(
        "doc_id",
        F.forall(parts, lambda p: F.length(p["chunk"]) <= S.CHUNK_SIZE).alias("fits"),
        F.forall(parts, lambda p: _between(blocks, p["start"], _end(p)) == p["chunk"]).alias("in_place"),
        (F.forall(F.transform(parts, gap), lambda x: x) & blank(last, F.col("chars"))).alias("covered"),
    )


def chunk_text_rebuilt(spark, root):
    """Every document put together again from the starts and texts of its chunks, blanks aside."""
    from gleaner.queries.ingest import rebuilt

    docs = load_spread(spark, root, "documents").select("doc_id", splitter.chunks("text", spark=spark).alias("parts"))
    return docs.select("doc_id", F.md5(rebuilt(F.col("parts"), "start", "chunk")).alias("text_md5"))


def chunk_counts(spark, root):
    docs = load_spread(spark, root, "documents").select("doc_id", splitter.chunks("text", spark=spark).alias("parts"))
    return docs.select("doc_id", F.size("parts").cast("bigint").alias("chunks"))


def chunk_single(spark, root):
    """A text below the chunk size is exactly one chunk, the stripped text; a longer one has some."""
    docs = load_spread(spark, root, "documents").select("doc_id", (F.length("text") < S.CHUNK_SIZE).alias("short"), splitter.chunks("text", spark=spark).alias("p"))
    first = F.when(F.col("short"), F.get("p", F.lit(0)))
    return docs.select(
        "doc_id", F.when(F.col("short"), F.size("p")).cast("bigint").alias("chunks"), (F.size("p") > 0).alias("any"),
        first["start"].alias("start"), F.md5(first["chunk"]).alias("chunk_md5"),
    )


def chunk_ids(spark, root):
    """The id shapes on unsplit documents."""
    source, number = F.col("source"), F.col("doc_id")
    path = F.concat(F.lit("/up/"), source, F.lit(".png"))
    return load(spark, root, "documents").select(
        "doc_id",
        X.url_chunk_id(source, number).alias("url_id"),
        X.paged_chunk_id(source, F.when(number % 7 > 0, number % 7), number).alias("paged_id"),
        X.image_chunk_id(path).alias("image_id"),
        X.table_chunk_id(X.base_name(path), number).alias("table_id"),
        X.row_id(number).alias("row_id"),
    )


def content_ids(spark, root):
    return load(spark, root, "documents").select("doc_id", X.content_id(F.col("source"), F.col("text")).alias("id"))


def content_hash(spark, root):
    return load(spark, root, "documents").select("doc_id", X.content_hash("text").alias("file_hash"))


def previews(spark, root):
    return load(spark, root, "documents").select(
        "doc_id",
        X.preview("text").alias("preview"),
        X.ocr_preview("text").alias("ocr_preview"),
        F.length("text").cast("bigint").alias("ocr_chars"),
    )


def whitespace_collapse(spark, root):
    return load_spread(spark, root, "documents").select("doc_id", F.md5(X.collapse_whitespace("text")).alias("flat_md5"))


def ocr_fallback(spark, root):
    """Blank OCR text falls back to the file's base name."""
    docs = load(spark, root, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, F.lit(" \n\t ")).when(F.col("doc_id") % 3 == 1, F.lit(None)).otherwise(F.col("text"))
    images = docs.select(
        F.concat(F.lit("/scans/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("source"),
        text.alias("ocr_text"),
    )
    return contracts.ocr(images).select("source", "file", F.md5("text").alias("text_md5"))


def metadata_merge_cap(spark, root):
    docs = load(spark, root, "documents")
    loader = F.create_map(F.lit("source"), F.lit("loader"), F.lit("lang"), F.col("lang"))
    merged = X.merge_metadata(loader, F.create_map(F.lit("source"), F.col("source")))
    capped = X.cap_facts(F.create_map(F.lit("venue"), F.col("text")))
    return docs.select(
        "doc_id", merged["source"].alias("source"), merged["lang"].alias("lang"),
        F.size(merged).cast("bigint").alias("keys"), F.md5(capped["fact:venue"]).alias("venue_md5"),
        F.length(capped["fact:venue"]).cast("bigint").alias("venue_chars"),
    )


# --- rows and names ---------------------------------------------------------


def row_documents(spark, root):
    rows = load(spark, root, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    return rows.select("c_custkey", X.row_document(rows.columns).alias("document"))


_FILE = (
    "'/up load/' || p_brand || '/' || CASE p_partkey % 6 WHEN 0 THEN p_name || '.CSV' WHEN 1 THEN p_type || ' (v' || "
    "p_size || ').xlsx' WHEN 2 THEN '#' || p_name || '#.Final.pdf' WHEN 3 THEN '---.Jpeg' WHEN 4 THEN p_name "
    "ELSE p_brand || '.tiff' END"
)


def _files(spark, root):
    return load(spark, root, "part").select("p_partkey", F.expr(_FILE).alias("path"))


def table_names(spark, root):
    return _files(spark, root).select(
        "p_partkey", X.table_name("path").alias("table_name"), X.table_name_plain("path").alias("plain_name"),
        X.base_name("path").alias("file"),
    )


def route_files(spark, root):
    return _files(spark, root).select(
        "p_partkey", X.extension("path").alias("ext"), X.file_kind("path").alias("kind"),
        X.file_kind("path", wide=True).alias("wide_kind"),
    )


_STATEMENT = (
    "CASE item_id % 6 WHEN 0 THEN '  SELECT 1' WHEN 1 THEN 'selection of ' || text WHEN 2 THEN 'Explain why ' || text "
    "WHEN 3 THEN chr(10) || 'with x as (select 1) select * from x' WHEN 4 THEN text ELSE 'please select' END"
)


def statement_class(spark, root):
    asked = load(spark, root, "benchmark").select("item_id", F.expr(_STATEMENT).alias("q"))
    return asked.select("item_id", X.looks_like_sql("q").alias("is_sql"))


_BASE = "array_extract(string_split(path, '/'), -1)"
_STEM = f"regexp_replace({_BASE}, '(?s)^(\\.*[^.].*)\\.[^.]*$', '\\1')"
_EXT = f"lower(regexp_extract({_BASE}, '(?s)^\\.*[^.].*?(\\.[^.]*)$', 1))"
_NAME = f"lower(trim(regexp_replace({_STEM}, '[^A-Za-z0-9_]+', '_', 'g'), '_'))"


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


QUERIES = {
    "url_normalize": url_normalize,
    "url_dedupe": url_dedupe,
    "url_list_split": url_list_split,
    "pages_to_docs": pages_to_docs,
    "pages_meta": pages_meta,
    "chunk_invariants": chunk_invariants,
    "chunk_text_rebuilt": chunk_text_rebuilt,
    "chunk_counts": chunk_counts,
    "chunk_single": chunk_single,
    "chunk_ids": chunk_ids,
    "content_ids": content_ids,
    "content_hash": content_hash,
    "previews": previews,
    "whitespace_collapse": whitespace_collapse,
    "ocr_fallback": ocr_fallback,
    "metadata_merge_cap": metadata_merge_cap,
    "row_documents": row_documents,
    "table_names": table_names,
    "route_files": route_files,
    "statement_class": statement_class,
}
ORACLES = {
    "url_normalize": f"SELECT page_id, {normal_url_sql('url')} AS url FROM (SELECT page_id, {_DECORATED} AS url FROM pages)",
    "url_dedupe": f"SELECT source, coalesce(min(page_id), -1) AS first_page FROM (SELECT page_id, {normal_url_sql('url')} AS source FROM ("
    f"SELECT page_id * 2 + 1 AS page_id, url FROM pages UNION ALL SELECT page_id * 2, {_DECORATED} AS url FROM pages UNION ALL SELECT NULL, url || '/lost' FROM pages)) "
    "WHERE source <> '' GROUP BY source",
    "url_list_split": f"""
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, url FROM (
  SELECT page_id, generate_subscripts(parts, 1) AS i, trim(unnest(parts), {WS}) AS url FROM (
    SELECT page_id, regexp_split_to_array(url || ', ' || page_id || chr(10) || chr(10) || ' , x' || chr(9) || ',' || url, '[,\n]') AS parts
    FROM pages)) WHERE url <> ''""",
    "pages_to_docs": f"WITH {_FIRST_PAGES_SQL} SELECT source, md5({_TEXT_SQL}) AS text_md5, "
    f"length({_TEXT_SQL})::BIGINT AS chars FROM firsts",
    "pages_meta": f"SELECT page_id, {_unescape_sql('regexp_extract(html, ' + lit(markup.TITLE) + ', 1)')} AS title, "
    f"coalesce(nullif(regexp_extract(html, {lit(markup.LANGUAGE)}, 1), ''), 'No language found.') AS language FROM pages",
    "chunk_invariants": "SELECT doc_id, true AS fits, true AS in_place, true AS covered FROM documents",
    "chunk_text_rebuilt": f"SELECT doc_id, md5(translate(text, {lit(X.WHITESPACE)}, '')) AS text_md5 FROM documents",
    "chunk_single": f"""
SELECT doc_id, CASE WHEN short THEN (blank = false)::BIGINT END AS chunks, NOT blank AS "any",
  CASE WHEN short AND NOT blank THEN length(text) - length(ltrim(text, {WS})) END AS start,
  CASE WHEN short AND NOT blank THEN md5({strip_sql('text')}) END AS chunk_md5
FROM (SELECT *, length(text) < {S.CHUNK_SIZE} AS short, {strip_sql('text')} = '' AS blank FROM documents)""",
    "chunk_ids": """
SELECT doc_id, source || '#chunk=' || doc_id AS url_id,
  source || '#page=' || coalesce((CASE WHEN doc_id % 7 > 0 THEN doc_id % 7 END)::VARCHAR, 'None') || '_chunk=' || doc_id AS paged_id,
  '/up/' || source || '.png#img_chunk=0' AS image_id, source || '.png#tab_chunk=' || doc_id AS table_id, 'id' || doc_id AS row_id
FROM documents""",
    "content_ids": "SELECT doc_id, sha1(source || '|' || text) AS id FROM documents",
    "content_hash": "SELECT doc_id, sha256(text) AS file_hash FROM documents",
    "previews": f"SELECT doc_id, {preview_sql('text')} AS preview, left(replace(text, chr(10), ' '), 140) AS ocr_preview, "
    "length(text)::BIGINT AS ocr_chars FROM documents",
    "whitespace_collapse": "SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\x{a0}]+', ' ', 'g'))) "
    "AS flat_md5 FROM documents",
    "ocr_fallback": f"""
SELECT '/scans/' || source || '/' || doc_id || '.png' AS source, doc_id || '.png' AS file,
  md5(CASE WHEN doc_id % 3 < 2 THEN doc_id || '.png' ELSE {strip_sql('text')} END) AS text_md5 FROM documents""",
    "metadata_merge_cap": "SELECT doc_id, source, lang, 2::BIGINT AS keys, md5(left(text, 160)) AS venue_md5, "
    "length(left(text, 160))::BIGINT AS venue_chars FROM documents",
    "row_documents": """
SELECT c_custkey, 'c_custkey: ' || c_custkey || ',' || chr(10) || 'c_name: ' || c_name || ',' || chr(10) ||
  'c_nationkey: ' || c_nationkey || ',' || chr(10) || 'c_mktsegment: ' || c_mktsegment || ',' || chr(10) ||
  'c_acctbal: ' || c_acctbal || ',' || chr(10) AS document
FROM customer""",
    "table_names": f"SELECT p_partkey, CASE WHEN {_NAME} = '' THEN 'table_1' ELSE {_NAME} END AS table_name, "
    f"replace(lower({_STEM}), ' ', '_') AS plain_name, {_BASE} AS file FROM (SELECT p_partkey, {_FILE} AS path FROM part)",
    "route_files": f"""
SELECT p_partkey, ext,
  CASE WHEN ext = '.pdf' THEN 'pdf' WHEN ext IN {_in(X.IMAGE_EXT)} THEN 'image' WHEN ext IN {_in(X.TABLE_EXT)} THEN 'table'
       ELSE 'unsupported' END AS kind,
  CASE WHEN ext IN {_in(X.IMAGE_EXT_WIDE)} THEN 'image' WHEN ext IN {_in(X.TABLE_EXT_WIDE)} THEN 'table'
       ELSE 'unsupported' END AS wide_kind
FROM (SELECT p_partkey, {_EXT} AS ext FROM (SELECT p_partkey, {_FILE} AS path FROM part))""",
    "statement_class": f"SELECT item_id, regexp_matches(lower({strip_sql('q')}), '^({'|'.join(X.SQL_WORDS)})') AS is_sql "
    f"FROM (SELECT item_id, {_STATEMENT} AS q FROM benchmark)",
}
