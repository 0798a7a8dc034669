"""Chat sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import sessions as C
from gleaner.queries.common import load, strip_sql

_STAMP = "2024-05-06 07:08"


def _pairs(spark, root):
    return C.turn_pairs(load(spark, root, "conversations"))


def _titles(spark, root):
    return C.session_titles(_pairs(spark, root), F.lit(f"{_STAMP}:09").cast("timestamp_ntz"))


def session_pairs(spark, root):
    return _pairs(spark, root)


def session_titles(spark, root):
    return _titles(spark, root).select("conv_id", "title")


def session_labels(spark, root):
    titled = _titles(spark, root)
    return titled.select("conv_id", C.session_label(F.col("conv_id"), F.col("title"), F.col("n_pairs")).alias("label"))


def session_archive(spark, root):
    """Even conversations are stored; then every conversation is archived, the
    ones divisible by four into their stored session, the rest as new ones."""
    titled = _titles(spark, root)
    stored = titled.where(F.col("conv_id") % 2 == 0).select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("id"),
        F.lit("old").alias("title"),
        F.lit(0).cast("bigint").alias("n_pairs"),
        F.col("conv_id").alias("position"),
    )
    incoming = titled.select(
        F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("s"), F.col("conv_id").cast("string"))).alias("active_id"),
        "title",
        "n_pairs",
        F.col("conv_id").alias("arrival"),
    )
    return C.archive(stored, incoming, next_id=100_000).select("id", "title", "n_pairs", "position")


_PAIRS_SQL = """
pairs AS (
  SELECT conv_id, turn, text AS "user", CASE WHEN next_role = 'assistant' THEN next_text END AS bot FROM (
    SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
    FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
  ) WHERE role = 'user'
)"""
_SAID = strip_sql('"user"')
_TITLES_SQL = f"""{_PAIRS_SQL},
firsts AS (
  SELECT conv_id, count(*) AS n_pairs, arg_min({_SAID}, turn) FILTER (WHERE {_SAID} <> '') AS said FROM pairs GROUP BY conv_id
),
titles AS (
  SELECT conv_id, n_pairs, '{_STAMP} · ' ||
    coalesce(CASE WHEN length(said) > 45 THEN left(said, 44) || '…' ELSE said END, 'Untitled') AS title
  FROM firsts
)"""

QUERIES = {
    "session_pairs": session_pairs,
    "session_titles": session_titles,
    "session_labels": session_labels,
    "session_archive": session_archive,
}
ORACLES = {
    "session_pairs": f"WITH {_PAIRS_SQL} SELECT * FROM pairs",
    "session_titles": f"WITH {_TITLES_SQL} SELECT conv_id, title FROM titles",
    "session_labels": f"WITH {_TITLES_SQL} SELECT conv_id, conv_id || ' · ' || title || ' (' || n_pairs || ' msgs)' AS label FROM titles",
    "session_archive": f"""WITH {_TITLES_SQL}
SELECT 's' || conv_id AS id, CASE WHEN conv_id % 4 = 0 THEN title ELSE 'old' END AS title,
  CASE WHEN conv_id % 4 = 0 THEN n_pairs ELSE 0 END AS n_pairs, conv_id AS position
FROM titles WHERE conv_id % 2 = 0
UNION ALL
SELECT n::VARCHAR AS id, title, n_pairs, n AS position
FROM (SELECT *, 100000 + row_number() OVER (ORDER BY conv_id) - 1 AS n FROM titles WHERE conv_id % 4 <> 0)""",
}
