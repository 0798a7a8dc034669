"""Shared inputs of the registered queries and shared fragments of their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schemas as S
from gleaner.functions.embedding import DIMENSIONS, hash_embedder
from gleaner.functions.text import WHITESPACE
from gleaner.session import spread


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def load_spread(spark: SparkSession, root: str, name: str) -> DataFrame:
    """As :func:`load`, for queries with costly work per row."""
    return spread(load(spark, root, name))


def lit(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def case_of(expression: str, values: tuple[str, ...]) -> str:
    """SQL: value number ``expression`` of a list."""
    whens = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"CASE {expression} {whens} END"


def rank_of(column: str, order: tuple[str, ...]) -> str:
    whens = " ".join(f"WHEN {lit(v)} THEN {i}" for i, v in enumerate(order))
    return f"CASE {column} {whens} ELSE {len(order)} END"


def nth(values: tuple[str, ...], number) -> "F.Column":
    """Value number ``number`` of a list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number + 1).cast("int"))


WS = lit(WHITESPACE)


def strip_sql(expression: str) -> str:
    return f"trim({expression}, {WS})"


def preview_sql(expression: str) -> str:
    return f"replace({strip_sql(f'left({expression}, {S.PREVIEW_CHARS})')}, chr(10), ' ')"


# --- corpus of precomputed vectors ------------------------------------------


def vector_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``embeddings`` as a chunk table: collection from the label, text and
    source from the document of the same number."""
    vectors = load(spark, root, "embeddings")
    texts = load(spark, root, "documents").select("doc_id", "text", "source")
    return vectors.join(texts, vectors["vec_id"] == texts["doc_id"], "left").select(
        nth(S.RETRIEVAL_ORDER, F.col("label") % 4).alias("collection"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.when(F.col("vec_id") % 40 == 3, F.lit(" \t\n")).otherwise(F.coalesce("text", F.lit(""))).alias("document"),
        F.col("embedding"),
    )


def with_odd_vectors(corpus: DataFrame) -> DataFrame:
    """Chunks that can answer nothing beside the good ones: a NaN, a NULL, an infinite element, another width, none."""
    first = F.col("embedding")[0]
    kinds = {
        "nan": F.transform("embedding", lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x)),
        "null": F.transform("embedding", lambda x, i: F.when(i == 5, None).otherwise(x)),
        "inf": F.transform("embedding", lambda x, i: F.when(i == 0, F.lit(float("inf"))).otherwise(x)),
        "short": F.slice("embedding", 1, 10), "empty": F.slice("embedding", 1, 0), "none": F.when(first.isNull(), F.col("embedding")),
    }
    type_ = corpus.schema["embedding"].dataType
    odd = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.cast(type_).alias("e")) for k, v in kinds.items()]))
    rows = corpus.select("collection", "id", "source", "document", odd.alias("_odd"))
    rows = rows.select("collection", F.concat("id", F.lit("-"), "_odd.kind").alias("id"), "source", "document", F.col("_odd.e").alias("embedding"))
    return corpus.unionByName(rows)


def label_questions(spark: SparkSession, root: str) -> DataFrame:
    """One question per label: the mean of its vectors."""
    cells = load(spark, root, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy("label").agg(F.transform(listed, lambda s: s["m"]).alias("vector")).select(
        F.col("label").cast("bigint").alias("qid"),
        F.concat(F.lit("What belongs to label "), F.col("label").cast("string"), F.lit("?")).alias("question"),
        "vector",
    )


VECTOR_CORPUS_SQL = f"""
corpus AS MATERIALIZED (
  SELECT {case_of('e.label % 4', S.RETRIEVAL_ORDER)} AS collection, 'v' || e.vec_id AS id,
         coalesce(d.source, '') AS source,
         CASE WHEN e.vec_id % 40 = 3 THEN ' ' || chr(9) || chr(10) ELSE coalesce(d.text, '') END AS document, e.embedding::DOUBLE[] AS vec
  FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id
)"""
LABEL_QUESTIONS_SQL = """
questions AS MATERIALIZED (
  SELECT label::BIGINT AS qid, 'What belongs to label ' || label || '?' AS question, list(m ORDER BY pos) AS qvec
  FROM (SELECT label, pos, avg(x::DOUBLE) AS m
        FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
        GROUP BY label, pos)
  GROUP BY label
)"""


def ranked_sql(k: int) -> str:
    """The ``k`` nearest corpus rows of every question."""
    return f"""
scored AS (
  SELECT qid, question, collection, id, source, document,
         round(pow(list_distance(vec, qvec), 2), 9) AS distance,
         {rank_of('collection', S.RETRIEVAL_ORDER)} AS crank
  FROM questions CROSS JOIN corpus
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, crank, id) AS rank
  FROM scored QUALIFY rank <= {k}
)"""


# --- hashed text ------------------------------------------------------------


def text_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``documents`` as chunk rows, one per document, with hashed vectors."""
    docs = load_spread(spark, root, "documents").select(
        nth(S.RETRIEVAL_ORDER, F.col("doc_id") % 4).alias("collection"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        "source",
        F.col("text").alias("document"),
    )
    return hash_embedder()(docs, "document", "embedding")


def benchmark_questions(spark: SparkSession, root: str) -> DataFrame:
    """``benchmark`` as a question table with hashed vectors."""
    asked = load(spark, root, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return hash_embedder()(asked, "question", "vector")


def hashed_sql(name: str, query: str, key: str, text: str, dim: int = DIMENSIONS) -> str:
    """CTEs that add ``counts`` and ``vec`` (token hashing of ``text``)."""
    return f"""
{name}_q AS MATERIALIZED ({query}),
{name}_t AS (
  SELECT {key}, ('0x' || left(md5(t), 8))::BIGINT % {dim} AS b, count(*) AS c
  FROM (SELECT {key}, unnest(string_split_regex(lower({text}), '[ \t\n\r\f]+')) AS t FROM {name}_q)
  WHERE t <> '' GROUP BY ALL
),
{name}_c AS (
  SELECT k.{key} AS hkey, list(coalesce(c, 0) ORDER BY r.b) AS counts, sqrt(sum(coalesce(c, 0) * coalesce(c, 0))) AS norm
  FROM (SELECT {key} FROM {name}_q) k CROSS JOIN (SELECT unnest(range({dim})) AS b) r
  LEFT JOIN {name}_t t ON t.{key} = k.{key} AND t.b = r.b
  GROUP BY ALL
),
{name} AS MATERIALIZED (
  SELECT q.*, counts,
    list_transform(counts, lambda c: (CASE WHEN norm > 0 THEN c / norm ELSE 0 END)::FLOAT)::DOUBLE[] AS vec
  FROM {name}_q q JOIN {name}_c ON q.{key} = hkey
)"""


TEXT_CORPUS_SQL = hashed_sql(
    "corpus",
    f"SELECT {case_of('doc_id % 4', S.RETRIEVAL_ORDER)} AS collection, 'd' || doc_id AS id, source, "
    "text AS document FROM documents",
    "id",
    "document",
)
BENCHMARK_QUESTIONS_SQL = (
    hashed_sql("asked", "SELECT item_id AS qid, text AS question FROM benchmark", "qid", "question")
    + ",\nquestions AS (SELECT qid, question, vec AS qvec FROM asked)"
)
