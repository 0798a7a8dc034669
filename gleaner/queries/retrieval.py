"""Retrieval, citation and evidence queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import schemas as S
from gleaner.functions.embedding import bucket_counts, hash_embedder, token_buckets
from gleaner.operators import citations as C
from gleaner.operators.coarse import MOST_CENTRES, CoarseIndex
from gleaner.operators.nearest import nearest, nearest_in_source
from gleaner.plans.answer import answer_questions, answer_snippets, direct_answers, evidence_texts, question_cites
from gleaner.queries.facts import FACT_SQL, INVOICE_SQL, poster_images
from gleaner.queries.common import (
    BENCHMARK_QUESTIONS_SQL,
    LABEL_QUESTIONS_SQL,
    TEXT_CORPUS_SQL,
    VECTOR_CORPUS_SQL,
    benchmark_questions,
    hashed_sql,
    label_questions,
    lit,
    load,
    load_spread,
    preview_sql,
    rank_of,
    ranked_sql,
    strip_sql,
    text_corpus,
    vector_corpus,
    with_odd_vectors,
)
from gleaner.session import fresh_dir

WIDE = S.TOP_K * S.WIDEN


def _hits(df: DataFrame) -> DataFrame:
    return df.select(
        "qid", F.col("rank").cast("bigint").alias("rank"), "collection", "id", "source",
        F.round("distance", 6).alias("distance"),
    )


def retrieve_topk(spark, root):
    return _hits(nearest(with_odd_vectors(vector_corpus(spark, root)), label_questions(spark, root)))


def retrieve_text(spark, root):
    return _hits(nearest(text_corpus(spark, root), benchmark_questions(spark, root)))


#: Every so many vectors one is a centre of the stored index, and a question looks at so many centres.
CENTRE_EVERY, LOOKED_AT = 32, 4


def _given_centres(spark, root):
    """Centres that do not depend on a fit, so that the twin has the same."""
    rows = load(spark, root, "embeddings").where(F.col("vec_id") % CENTRE_EVERY == 5).orderBy("vec_id").select("embedding").limit(MOST_CENTRES)
    return np.array([r["embedding"] for r in rows.collect()], np.float64)


def retrieve_approx(spark, root):
    """Questions against chunks stored by centre, in the partitions of their nearest centres."""
    index = CoarseIndex(spark, fresh_dir(spark, "coarse")).build(with_odd_vectors(vector_corpus(spark, root)), centres=_given_centres(spark, root))
    return _hits(index.nearest(label_questions(spark, root), probes=LOOKED_AT))


def retrieve_dedupe_by_source(spark, root):
    cites = question_cites(vector_corpus(spark, root), label_questions(spark, root))
    rows = cites.select("qid", F.explode(C.number_cites(F.col("cites"))).alias("c"))
    return rows.select(
        "qid", F.col("c.n").cast("bigint").alias("n"), "c.id", "c.collection", "c.source",
        F.round("c.distance", 6).alias("distance"),
    )


def context_answer(spark, root):
    answers = answer_questions(vector_corpus(spark, root), label_questions(spark, root))
    return answers.select(
        "qid", "answer", F.size("cites").cast("bigint").alias("n_cites"),
        F.concat_ws(",", F.transform("cites", lambda c: c["id"])).alias("cite_ids"),
    )


def answer_text_questions(spark, root):
    answers = answer_questions(text_corpus(spark, root), benchmark_questions(spark, root))
    return answers.select(
        "qid", F.md5("answer").alias("answer_md5"),
        F.concat_ws(",", F.transform("cites", lambda c: c["id"])).alias("cite_ids"),
    )


def prompt_table(spark, root):
    answers = answer_questions(vector_corpus(spark, root), label_questions(spark, root))
    return answers.select("qid", "system_prompt", "user_prompt")


def no_hit_answer(spark, root):
    """All questions against one empty collection set: fixed sentence, no cites."""
    empty = vector_corpus(spark, root).where(F.col("collection").isNull())
    answers = answer_questions(empty, benchmark_questions(spark, root))
    return answers.select("qid", "answer", F.size("cites").cast("bigint").alias("n_cites"))


def _source_probes(spark, root):
    corpus = vector_corpus(spark, root)
    pairs = (
        load(spark, root, "embeddings")
        .select("vec_id", F.col("label").cast("bigint").alias("qid"))
        .join(corpus.select(F.substring("id", 2, 20).cast("bigint").alias("vec_id"), "source"), "vec_id")
        .select("qid", "source")
        .distinct()
    )
    return corpus, pairs.join(label_questions(spark, root).select("qid", "vector"), "qid").select(
        F.concat_ws("|", F.col("qid").cast("string"), "source").alias("qid"), "source", "vector"
    )


def snippets_for_source(spark, root):
    corpus, probes = _source_probes(spark, root)
    found = nearest_in_source(with_odd_vectors(corpus), probes)
    return found.select(
        "qid", "source", F.col("snippet_no").cast("bigint").alias("snippet_no"), "collection", "id",
        F.round("distance", 6).alias("distance"),
    )


def embed_hash(spark, root):
    docs = load_spread(spark, root, "documents").select("doc_id", "text")
    counted = docs.withColumn("b", token_buckets(F.col("text"), 64)).select(
        "doc_id", bucket_counts(F.col("b"), 64).alias("counts")
    )
    squares = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x * x)
    return counted.select(
        "doc_id", F.concat_ws(",", F.col("counts").cast("array<string>")).alias("counts"),
        squares.cast("bigint").alias("squares"),
    )


def embed_questions(spark, root):
    asked = hash_embedder()(load(spark, root, "benchmark"), "text", "vector")
    return asked.select(
        "item_id",
        F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 5).alias("length2"),
        F.round(F.array_max("vector").cast("double"), 5).alias("largest"),
        F.size(F.filter("vector", lambda x: x > 0)).cast("bigint").alias("nonzero"),
    )


# --- answers with marks, composed from conversations ------------------------

_MARKS = "' [' || (length(text) % 7) || '] and [2], again [' || (turn % 5 + 1) || '][99]'"


def _marked(spark, root):
    turns = load(spark, root, "conversations").where(F.col("role") == "assistant")
    marks = F.concat(
        F.lit(" ["), (F.length("text") % 7).cast("string"), F.lit("] and [2], again ["),
        (F.col("turn") % 5 + 1).cast("string"), F.lit("][99]"),
    )
    # Every third conversation cites nothing.
    text = F.when(F.col("conv_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", marks))
    return turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"),
        (F.col("conv_id") % 10).alias("qid"),
        text.alias("answer"),
    )


_MARKED_SQL = f"""
marked AS (
  SELECT conv_id || '-' || turn AS answer_id, conv_id % 10 AS qid,
         CASE WHEN conv_id % 3 = 0 THEN text ELSE text || {_MARKS} END AS answer
  FROM conversations WHERE role = 'assistant'
)"""
_USED_SQL = (
    "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), "
    "lambda m: m::INT), lambda n: n >= 1 AND n <= {n})))"
)


def cited_numbers(spark, root):
    marked = _marked(spark, root)
    used = C.cited_numbers(F.col("answer"), F.lit(8))
    return marked.select(
        "answer_id", F.concat_ws(",", used.cast("array<string>")).alias("used"), F.size(used).cast("bigint").alias("n")
    )


def _resolved(spark, root):
    cites = question_cites(vector_corpus(spark, root), label_questions(spark, root))
    numbered = cites.select("qid", C.number_cites(F.col("cites")).alias("cites"))
    return C.resolve_cites(_marked(spark, root), numbered)


def resolve_cites(spark, root):
    return _resolved(spark, root).select(
        "answer_id", "qid",
        F.concat_ws(",", F.transform("used", lambda c: c["n"].cast("string"))).alias("numbers"),
        F.concat_ws(",", F.transform("used", lambda c: c["id"])).alias("ids"),
    )


def sources_block(spark, root):
    done = _resolved(spark, root)
    return done.select(
        "answer_id",
        C.sources_block(F.col("used"), renumber=True).alias("renumbered"),
        C.sources_block(F.col("used"), renumber=False).alias("original"),
    )


_DEDUPED_SQL = f"""{VECTOR_CORPUS_SQL},{LABEL_QUESTIONS_SQL},{ranked_sql(WIDE)},
firsts AS (
  SELECT *, row_number() OVER (
      PARTITION BY qid, CASE WHEN source = '' THEN 'i:' || id ELSE 's:' || source END ORDER BY rank) AS seen
  FROM ranked
),
cites AS (
  SELECT qid, question, id, collection, source, document, distance,
         row_number() OVER (PARTITION BY qid ORDER BY rank) AS n
  FROM firsts WHERE seen = 1
)"""
_CONTEXT_SQL = f"""
contexts AS (
  SELECT qid, any_value(question) AS question, count(*) AS n_all,
    string_agg('[' || n || '] Source: ' || source || chr(10) || 'Snippet: ' || {preview_sql('document')} || chr(10),
               chr(10) || chr(10) ORDER BY n) AS context,
    string_agg(id, ',' ORDER BY n) FILTER (WHERE n <= {S.TOP_K}) AS cite_ids,
    count(*) FILTER (WHERE n <= {S.TOP_K}) AS n_cites
  FROM cites GROUP BY qid
)"""
_NO_MODEL_SQL = "'(No LLM configured)' || chr(10) || chr(10) || 'Top cites:' || chr(10) || context"


# Numbers used by an answer, falling back to [1], cut to the cites there are.
_PICKED_SQL = f"""
picked AS (
  SELECT answer_id, m.qid, unnest(CASE WHEN len(used) > 0 THEN used ELSE [1] END) AS n
  FROM (SELECT answer_id, m.qid, {_USED_SQL.format(n='n_all')} AS used
        FROM marked m JOIN contexts USING (qid)) m
),
shown AS (
  SELECT answer_id, p.qid, c.n, c.id, c.source, c.collection,
         row_number() OVER (PARTITION BY answer_id ORDER BY c.n) AS slot
  FROM picked p JOIN cites c ON c.qid = p.qid AND c.n = p.n
  QUALIFY slot <= {S.TOP_K}
)"""


# --- stored answers with a sources block ------------------------------------


def _stored_answers(spark, root):
    """Assistant turns with a block of two sources appended in several styles."""
    turns = load(spark, root, "conversations").where(F.col("role") == "assistant")
    first = F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string"))
    second = F.concat(F.lit("src"), ((F.col("conv_id") + F.col("turn")) % 20).cast("string"))
    block = (
        F.when(
            F.col("conv_id") % 4 == 0,
            F.concat(F.lit("\n\nSources:\n[1] "), first, F.lit(" (ti_pdfs)\n[3] "), second, F.lit(" (ti_urls)")),
        )
        .when(
            F.col("conv_id") % 4 == 1,
            F.concat(F.lit("\nsources:  \n\n- [2] "), first, F.lit("\n\n* [5]  "), second, F.lit("  (ti_images) \nend")),
        )
        .when(
            F.col("conv_id") % 4 == 2,
            F.concat(F.lit("\n\nSources:\n[1] "), first, F.lit("\nMessage box\n[2] "), second),
        )
        .otherwise(F.lit(" Sources: none"))
    )
    return turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"),
        (F.col("conv_id") % 10).alias("qid"),
        F.concat("text", block).alias("text"),
    )


_NL = "chr(10)"
_STORED_SQL = f"""
stored AS (
  SELECT conv_id || '-' || turn AS answer_id, conv_id % 10 AS qid, text ||
    CASE conv_id % 4
      WHEN 0 THEN {_NL} || {_NL} || 'Sources:' || {_NL} || '[1] ' || s1 || ' (ti_pdfs)' || {_NL} || '[3] ' || s2 || ' (ti_urls)'
      WHEN 1 THEN {_NL} || 'sources:  ' || {_NL} || {_NL} || '- [2] ' || s1 || {_NL} || {_NL} || '* [5]  ' || s2 || '  (ti_images) ' || {_NL} || 'end'
      WHEN 2 THEN {_NL} || {_NL} || 'Sources:' || {_NL} || '[1] ' || s1 || {_NL} || 'Message box' || {_NL} || '[2] ' || s2
      ELSE ' Sources: none' END AS text
  FROM (SELECT *, 'src' || (conv_id % 20) AS s1, 'src' || ((conv_id + turn) % 20) AS s2
        FROM conversations WHERE role = 'assistant')
),
tails AS (
  SELECT answer_id, qid, {strip_sql("regexp_extract(text, '(?ims)^Sources:[ \t]*$(.*)', 1)")} AS tail FROM stored
),
lines AS (
  SELECT answer_id, qid, list_filter(list_transform(string_split(tail, {_NL}), lambda x: {strip_sql('x')}),
         lambda x: x <> '') AS lines
  FROM tails
),
flagged AS (
  SELECT answer_id, qid, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM lines
),
running AS (
  SELECT *, max(CASE WHEN regexp_matches(line, '^[-*]?\\s*\\[(\\d+)\\]\\s+(.+)$')
      AND NOT starts_with(lower(line), 'message') AND NOT starts_with(lower(line), 'type your question')
      THEN 0 ELSE 1 END) OVER (PARTITION BY answer_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS bad
  FROM flagged
),
parsed AS (
  SELECT answer_id, qid, row_number() OVER (PARTITION BY answer_id ORDER BY pos) AS slot,
    regexp_extract(line, '^[-*]?\\s*\\[(\\d+)\\]\\s+(.+)$', 1)::BIGINT AS cite_no,
    {strip_sql("regexp_replace(" + strip_sql("regexp_extract(line, '^[-*]?\\s*\\[(\\d+)\\]\\s+(.+)$', 2)") + ", '\\s*\\(ti_[^)]+\\)\\s*$', '')")} AS source
  FROM running WHERE bad = 0
)"""


def parse_sources(spark, root):
    stored = _stored_answers(spark, root)
    rows = stored.select("answer_id", F.posexplode(C.parse_sources(F.col("text"))).alias("i", "s"))
    return rows.select(
        "answer_id", (F.col("i") + 1).cast("bigint").alias("slot"), F.col("s.n").cast("bigint").alias("cite_no"),
        F.col("s.source").alias("source"),
    )


def _evidence(spark, root):
    stored = _stored_answers(spark, root).join(label_questions(spark, root).select("qid", "vector"), "qid")
    return answer_snippets(vector_corpus(spark, root), stored)


def answer_evidence(spark, root):
    return _evidence(spark, root).select(
        "answer_id", F.col("slot").cast("bigint").alias("slot"), F.col("cite_no").cast("bigint").alias("cite_no"),
        "source", F.col("snippet_no").cast("bigint").alias("snippet_no"), F.md5("chunk").alias("chunk_md5"),
    )


def answer_evidence_text(spark, root):
    return evidence_texts(_evidence(spark, root)).select(
        "answer_id", F.col("slot").cast("bigint").alias("slot"), "text"
    )


_EVIDENCE_SQL = f"""{VECTOR_CORPUS_SQL},{LABEL_QUESTIONS_SQL},{_STORED_SQL},
slots AS (SELECT * FROM parsed WHERE slot <= {S.SHOWN_SOURCES}),
hits AS (
  SELECT s.answer_id, s.slot, c.collection, c.id, c.document,
         {rank_of('c.collection', S.SNIPPET_ORDER)} AS crank,
         round(pow(list_distance(c.vec, q.qvec), 2), 9) AS distance
  FROM slots s JOIN questions q ON q.qid = s.qid JOIN corpus c ON c.source = s.source
),
fetched AS (
  SELECT *, row_number() OVER (PARTITION BY answer_id, slot, collection ORDER BY distance, id) AS f
  FROM hits QUALIFY f <= {S.SNIPPET_FETCH}
),
snips AS (
  SELECT *, row_number() OVER (PARTITION BY answer_id, slot ORDER BY distance, crank, id) AS snippet_no
  FROM fetched WHERE {strip_sql('document')} <> '' QUALIFY snippet_no <= {S.SNIPPETS}
)"""


def direct_image_answer(spark, root):
    """Questions on composed posters, answered from the nearest image."""
    from gleaner.plans.chunking import ingest_ocr
    chunks = ingest_ocr(poster_images(spark, root))
    words = load(spark, root, "orders").groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("key"))
    asked = words.select(
        F.col("o_orderpriority").alias("qid"),
        F.concat(F.lit("What is the invoice number of order "), F.col("key").cast("string"), F.lit("?")).alias("question"),
    )
    return direct_answers(chunks, hash_embedder()(asked, "question", "vector")).select("qid", "answer", "id")


QUERIES = {
    "retrieve_topk": retrieve_topk,
    "retrieve_text": retrieve_text,
    "retrieve_approx": retrieve_approx,
    "retrieve_dedupe_by_source": retrieve_dedupe_by_source,
    "context_answer": context_answer,
    "answer_text_questions": answer_text_questions,
    "prompt_table": prompt_table,
    "no_hit_answer": no_hit_answer,
    "snippets_for_source": snippets_for_source,
    "embed_hash": embed_hash,
    "embed_questions": embed_questions,
    "cited_numbers": cited_numbers,
    "resolve_cites": resolve_cites,
    "sources_block": sources_block,
    "parse_sources": parse_sources,
    "answer_evidence": answer_evidence,
    "answer_evidence_text": answer_evidence_text,
    "direct_image_answer": direct_image_answer,
}

_HITS = "SELECT qid, rank, collection, id, source, round(distance, 6) AS distance FROM ranked"
_TEXT_CITES_SQL = _DEDUPED_SQL.replace(VECTOR_CORPUS_SQL, TEXT_CORPUS_SQL).replace(
    LABEL_QUESTIONS_SQL, BENCHMARK_QUESTIONS_SQL
)

ORACLES = {
    "retrieve_topk": f"WITH {VECTOR_CORPUS_SQL},{LABEL_QUESTIONS_SQL},{ranked_sql(S.TOP_K)} {_HITS}",
    "retrieve_approx": f"""WITH {VECTOR_CORPUS_SQL},{LABEL_QUESTIONS_SQL},
centres AS MATERIALIZED (SELECT vec_id AS centre, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id % {CENTRE_EVERY} = 5 ORDER BY vec_id LIMIT {MOST_CENTRES}),
stored AS MATERIALIZED (
  SELECT collection, id, centre FROM corpus CROSS JOIN centres
  QUALIFY row_number() OVER (PARTITION BY collection, id ORDER BY list_distance(vec, c), centre) = 1),
looked AS (SELECT qid, centre FROM questions CROSS JOIN centres QUALIFY row_number() OVER (PARTITION BY qid ORDER BY list_distance(qvec, c), centre) <= {LOOKED_AT}),
met AS (SELECT qid, collection, id FROM stored JOIN looked USING (centre)),
enough AS (SELECT qid FROM met GROUP BY qid HAVING count(*) >= {S.TOP_K}),
scored AS (
  SELECT q.qid, c.collection, c.id, c.source, round(pow(list_distance(c.vec, q.qvec), 2), 9) AS distance
  FROM questions q CROSS JOIN corpus c
  WHERE q.qid NOT IN (SELECT qid FROM enough) OR EXISTS (SELECT 1 FROM met m WHERE m.qid = q.qid AND m.collection = c.collection AND m.id = c.id)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, {rank_of('collection', S.RETRIEVAL_ORDER)}, id) AS rank
  FROM scored QUALIFY rank <= {S.TOP_K}
)
{_HITS}""",
    "retrieve_text": f"WITH {TEXT_CORPUS_SQL},{BENCHMARK_QUESTIONS_SQL},{ranked_sql(S.TOP_K)} {_HITS}",
    "retrieve_dedupe_by_source": f"WITH {_DEDUPED_SQL} "
    "SELECT qid, n, id, collection, source, round(distance, 6) AS distance FROM cites",
    "context_answer": f"WITH {_DEDUPED_SQL},{_CONTEXT_SQL} "
    f"SELECT qid, {_NO_MODEL_SQL} AS answer, n_cites, cite_ids FROM contexts",
    "answer_text_questions": f"WITH {_TEXT_CITES_SQL},{_CONTEXT_SQL} "
    f"SELECT qid, md5({_NO_MODEL_SQL}) AS answer_md5, cite_ids FROM contexts",
    "prompt_table": f"WITH {_DEDUPED_SQL},{_CONTEXT_SQL} SELECT qid, {lit(C.SYSTEM_ROLE)} AS system_prompt, "
    f"'Question: ' || question || chr(10) || chr(10) || 'Use ONLY this context:' || chr(10) || context || chr(10) || "
    f"chr(10) || {lit(C.ASK)} AS user_prompt FROM contexts",
    "no_hit_answer": f"SELECT item_id AS qid, {lit(C.NO_HITS)} AS answer, 0::BIGINT AS n_cites FROM benchmark",
    "snippets_for_source": f"""WITH {VECTOR_CORPUS_SQL},{LABEL_QUESTIONS_SQL},
pairs AS (SELECT DISTINCT e.label AS label, c.source FROM embeddings e JOIN corpus c ON c.id = 'v' || e.vec_id),
hits AS (
  SELECT q.qid || '|' || p.source AS qid, c.source, c.collection, c.id, c.document,
         {rank_of('c.collection', S.SNIPPET_ORDER)} AS crank, round(pow(list_distance(c.vec, q.qvec), 2), 9) AS distance
  FROM pairs p JOIN questions q ON q.qid = p.label JOIN corpus c ON c.source = p.source
),
fetched AS (
  SELECT *, row_number() OVER (PARTITION BY qid, collection ORDER BY distance, id) AS f FROM hits
  QUALIFY f <= {S.SNIPPET_FETCH}
),
snips AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, crank, id) AS snippet_no
  FROM fetched WHERE {strip_sql('document')} <> '' QUALIFY snippet_no <= {S.SNIPPETS}
)
SELECT qid, source, snippet_no, collection, id, round(distance, 6) AS distance FROM snips""",
    "direct_image_answer": f"""WITH {hashed_sql("corpus", "SELECT o_orderkey, " + INVOICE_SQL + " AS t FROM orders", "o_orderkey", "t")},
{hashed_sql("asked", "SELECT o_orderpriority AS qid, 'What is the invoice number of order ' || min(o_orderkey) || '?' AS question FROM orders GROUP BY 1", "qid", "question")},
ranked AS (
  SELECT a.qid, '/scans/' || o_orderkey || '.png#img_chunk=0' AS id, {FACT_SQL["invoice_number"]} AS answer,
    row_number() OVER (PARTITION BY a.qid
      ORDER BY round(pow(list_distance(c.vec, a.vec), 2), 9), '/scans/' || o_orderkey || '.png#img_chunk=0') AS rank
  FROM asked a CROSS JOIN corpus c QUALIFY rank <= {S.TOP_K}
)
SELECT qid, arg_min(answer, rank) AS answer, arg_min(id, rank) AS id FROM ranked WHERE answer IS NOT NULL GROUP BY qid""",
    "embed_hash": f"WITH {hashed_sql('h', 'SELECT doc_id, text FROM documents', 'doc_id', 'text')} "
    "SELECT doc_id, array_to_string(counts, ',') AS counts, "
    "list_sum(list_transform(counts, lambda c: c * c))::BIGINT AS squares FROM h",
    "embed_questions": f"WITH {hashed_sql('h', 'SELECT item_id, text FROM benchmark', 'item_id', 'text')} "
    "SELECT item_id, round(list_sum(list_transform(vec, lambda x: x * x)), 5) AS length2, "
    "round(list_max(vec), 5) AS largest, len(list_filter(vec, lambda x: x > 0))::BIGINT AS nonzero FROM h",
    "cited_numbers": f"WITH {_MARKED_SQL} SELECT answer_id, array_to_string(used, ',') AS used, len(used)::BIGINT AS n "
    f"FROM (SELECT answer_id, {_USED_SQL.format(n=8)} AS used FROM marked)",
    "resolve_cites": f"WITH {_DEDUPED_SQL},{_CONTEXT_SQL},{_MARKED_SQL},{_PICKED_SQL} "
    "SELECT answer_id, any_value(qid) AS qid, string_agg(n::VARCHAR, ',' ORDER BY n) AS numbers, "
    "string_agg(id, ',' ORDER BY n) AS ids FROM shown GROUP BY answer_id",
    "sources_block": f"WITH {_DEDUPED_SQL},{_CONTEXT_SQL},{_MARKED_SQL},{_PICKED_SQL} SELECT answer_id, "
    f"{_NL} || {_NL} || 'Sources:' || {_NL} || string_agg('[' || slot || '] ' || source || ' (' || collection || ')', {_NL} ORDER BY slot) AS renumbered, "
    f"{_NL} || {_NL} || 'Sources:' || {_NL} || string_agg('[' || n || '] ' || source || ' (' || collection || ')', {_NL} ORDER BY slot) AS original "
    "FROM shown GROUP BY answer_id",
    "parse_sources": f"WITH {_STORED_SQL} SELECT answer_id, slot, cite_no, source FROM parsed",
    "answer_evidence": f"WITH {_EVIDENCE_SQL} SELECT s.answer_id, s.slot, s.cite_no, s.source, n.snippet_no, "
    "md5(n.document) AS chunk_md5 FROM slots s LEFT JOIN snips n USING (answer_id, slot)",
    "answer_evidence_text": f"""WITH {_EVIDENCE_SQL} SELECT s.answer_id, s.slot, rtrim(
  '**Source [' || any_value(cite_no) || ']**  ' || {_NL} || '`' || any_value(source) || '`' || {_NL} ||
  coalesce({_NL} || string_agg('**Chunk ' || snippet_no || '**' || {_NL} || {strip_sql('document')} || {_NL} || '---', {_NL} ORDER BY snippet_no), ''), '-') AS text
FROM slots s LEFT JOIN snips n USING (answer_id, slot) GROUP BY s.answer_id, s.slot""",
}
