"""Input tables of the ingest jobs: what a decoded source looks like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import markup
from gleaner.functions import text as X
from gleaner.operators.upsert import broadcast_if_small
from gleaner.session import stage


def pages(fetched: DataFrame, position: str = "page_id") -> DataFrame:
    """Fetched pages (``url, html``) to documents.

    URLs are normalized; of equal ones the first by position stays, pages without one after all others, and of
    equal positions the smallest markup. URLs that repeat, usually few, are found from the URLs alone; where they are
    counted to be few, all other markup goes from the scan straight on. Of a URL that repeats, an aggregate with a map
    side takes the first page, so one fetched a million times is no task's burden.
    """
    named = fetched.select(F.col(position).alias("pos"), X.normalize_url("url").alias("source"), "html").where(F.col("source") != "")
    often = named.groupBy("source").agg(F.count("*").alias("n")).where("n > 1").select("source")
    often = broadcast_if_small(stage(often, "repeated-urls"))
    first = F.min_by("html", F.struct(F.col("pos").isNull(), "pos", "html")).alias("html")
    repeated = named.join(often, "source", "left_semi").groupBy("source").agg(first)
    kept = named.join(often, "source", "left_anti").select("source", "html").unionByName(repeated)
    html = F.col("html")
    return kept.select(
        "source",
        markup.page_text(html).alias("text"),
        F.create_map(
            F.lit("title"), markup.page_title(html), F.lit("language"), markup.page_language(html)
        ).alias("metadata"),
    )


def paged(documents: DataFrame, source: str = "source", page: str = "page", text: str = "text") -> DataFrame:
    """One row per page of a document."""
    return documents.select(
        F.col(source).alias("source"), F.col(page).cast("bigint").alias("page"), F.col(text).alias("text")
    )


def ocr(images: DataFrame, source: str = "source", text: str = "ocr_text") -> DataFrame:
    """OCR text per image; blank text falls back to the file's base name."""
    return images.select(
        F.col(source).alias("source"),
        X.base_name(source).alias("file"),
        X.ocr_text(F.col(text), F.col(source)).alias("text"),
    )
