"""Index statistics and ingest reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import schemas as S


def chunks_per_source(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))


def collection_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection").agg(F.count(F.lit(1)).alias("chunks"))


def collection_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, distinct sources and (tabular only) rows of each collection.

    Pre-aggregated by source, so four collection values never decide the
    parallelism. Collections without chunks appear with zeros.
    """
    per_source = chunks.groupBy("collection", "source").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("rows", F.when(F.col("rows").isNotNull(), F.col("id"))).alias("r")
    )
    return of_sources(per_source)


def of_sources(per_source: DataFrame) -> DataFrame:
    """The figures of :func:`collection_stats` from ``collection, source, n, r``."""
    is_table = F.col("collection") == S.TABULAR
    found = per_source.groupBy("collection").agg(
        F.sum("n").alias("chunks"),
        F.count(F.when(F.col("source") != "", 1)).alias("sources"),
        F.coalesce(F.sum(F.when(is_table & F.col("source").isNotNull(), F.col("r"))), F.lit(0)).alias("rows"),
    )
    names = per_source.sparkSession.createDataFrame([(c,) for c in S.RETRIEVAL_ORDER], "collection string")
    return names.join(found, "collection", "full_outer").select(
        "collection", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("chunks", "sources", "rows")]
    )


def index_totals(stats: DataFrame) -> DataFrame:
    """Totals over all collections."""
    return stats.agg(F.sum("chunks").alias("chunks"), F.sum("sources").alias("sources"))


def status_lines(stats: DataFrame) -> DataFrame:
    """One readable line per collection; rows only where there are some."""
    line = F.format_string("%s: %d chunks, %d source(s)", "collection", "chunks", "sources")
    rows = F.when(F.col("rows") > 0, F.format_string(" — ~%d rows", "rows")).otherwise("")
    return stats.select("collection", F.concat(line, rows).alias("line"))


def ingest_report(requested: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks per requested name; zero where none came, unasked names appended."""
    counted = chunks.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return (
        requested.select("name")
        .distinct()
        .join(counted, "name", "full_outer")
        .select("name", F.coalesce("n", F.lit(0)).cast("bigint").alias("chunks"))
    )


def full_report(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """``name, rows, chunks, ocr_chars, ocr_preview, status, error`` of an ingest.

    ``asked`` has ``name`` once each, ``error`` and perhaps the two columns of
    recognised texts; sources that came without being asked are appended.
    """
    counted = chunks.groupBy(F.col("source").alias("_name")).agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("r"))
    joined = asked.join(counted, F.col("name").eqNullSafe(F.col("_name")), "full_outer")
    found = F.coalesce("n", F.lit(0)).cast("bigint")
    status = F.when(F.col("error").isNotNull(), "Failed").when(found == 0, "Empty").otherwise(S.STATUS_NEW)
    more = [
        (F.col(c) if c in asked.columns else F.lit(None)).cast(t).alias(c) for c, t in (("ocr_chars", "bigint"), ("ocr_preview", "string"))
    ]
    return joined.select(
        F.coalesce("name", "_name").alias("name"), F.coalesce("r", F.lit(0)).cast("bigint").alias("rows"), found.alias("chunks"),
        *more, status.alias("status"), "error",
    )


def ingest_totals(report: DataFrame) -> DataFrame:
    """Files, chunks and rows per kind."""
    return report.groupBy("kind").agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
    )


def count_added(report: DataFrame) -> DataFrame:
    """The first of ``added``, ``rows``, ``count``, ``n`` a result has."""
    present = [F.col(c).cast("bigint") for c in ("added", "rows", "count", "n") if c in report.columns]
    rest = [F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c, t in report.dtypes if t in ("int", "bigint", "double")]
    fallback = sum(rest[1:], rest[0]) if rest else F.lit(0)
    return report.withColumn("added_total", F.coalesce(*present, fallback))
