"""Sources to stored chunks and a report, one call per kind: chunk, embed, upsert, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.functions.embedding import Embedder
from gleaner.operators.stats import collection_counts, full_report
from gleaner.operators.upsert import ChunkTable
from gleaner.plans import chunking
from gleaner.session import stage


def _usable(rows: DataFrame):
    """A row that can be chunked has a source and a text."""
    return F.col("source").isNotNull() & F.col("text").isNotNull()


def _asked(rows: DataFrame, **more) -> DataFrame:
    """One row per source, failed only where none of its rows can be used."""
    error = F.when(~F.bool_or(_usable(rows)), F.lit("no text"))
    return rows.groupBy(F.col("source").alias("name")).agg(error.alias("error"), *[c.alias(n) for n, c in more.items()])


def _stored(store: ChunkTable, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    written = stage(chunks, "ingest")
    if not written.isEmpty():
        store.upsert(written, staged=True)
    return full_report(asked, written)


def store_pages(store: ChunkTable, documents: DataFrame, embed: Embedder | None = None) -> DataFrame:
    """Pages (``source, text, metadata``) into the store; returns the report by source."""
    chunks = chunking.ingest_pages(documents.where(_usable(documents)), embed)
    return _stored(store, chunks, _asked(documents))


def store_paged(store: ChunkTable, pages: DataFrame, embed: Embedder | None = None) -> DataFrame:
    """Paged documents (``source, page, text``) into the store; returns the report by source."""
    chunks = chunking.ingest_paged(pages.where(_usable(pages)), embed)
    return _stored(store, chunks, _asked(pages))


def store_ocr(store: ChunkTable, images: DataFrame, embed: Embedder | None = None, split: bool = False) -> DataFrame:
    """Recognised texts (``source, file, text``) into the store; the report has their length and beginning."""
    chunks = chunking.ingest_ocr(images.where(_usable(images)), embed, split)
    shown = {"ocr_chars": F.max(F.length("text")).cast("bigint"), "ocr_preview": F.max(X.ocr_preview("text"))}
    return _stored(store, chunks, _asked(images, **shown))


def store_table(store: ChunkTable, table: DataFrame, file: str, order: str, embed: Embedder | None = None) -> DataFrame:
    """A table's text into the store; the report has one row."""
    asked = table.sparkSession.createDataFrame([(file, None)], "name string, error string")
    return _stored(store, chunking.ingest_table_text(table, file, order, embed), asked)


def store_rows(store: ChunkTable, table: DataFrame, file: str, order: str, embed: Embedder | None = None) -> DataFrame:
    """One record per row into a new store, an existing one being an error; returns the counts by collection."""
    store.create(chunking.ingest_rows(table, file, order, embed))
    return collection_counts(store.read())
