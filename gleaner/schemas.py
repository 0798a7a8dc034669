"""Record shapes and the constants that define results."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
IMAGES = "ti_images"
PDFS = "ti_pdfs"
URLS = "ti_urls"
TABULAR = "ti_tabular_docs"

# On equal distance, retrieval prefers images, then this visiting order.
RETRIEVAL_ORDER = (IMAGES, PDFS, URLS, TABULAR)
# Evidence snippets visit the collections in another order.
SNIPPET_ORDER = (PDFS, URLS, IMAGES, TABULAR)

CHUNK_SIZE = 800
CHUNK_OVERLAP = 120
OCR_CHUNK_SIZE = 600
OCR_CHUNK_OVERLAP = 100

TOP_K = 4
WIDEN = 3
SNIPPETS = 3
SNIPPET_FETCH = 5
PREVIEW_CHARS = 220
OCR_PREVIEW_CHARS = 140
FACT_CHARS = 160
SQL_ROWS = 50
SHOWN_SOURCES = 4
TITLE_MAX = 45

STATUS_NEW = "Processed"
STATUS_SAME = "Already processed"
STATUS_CHANGED = "Re-ingested (changed)"
# ----------------------------------------------------------------------------

MANIFEST = T.StructType(
    [
        T.StructField("file_path", T.StringType(), False),
        T.StructField("table_name", T.StringType(), False),
        T.StructField("file_hash", T.StringType(), False),
        T.StructField("row_count", T.LongType(), False),
        T.StructField("updated_at", T.StringType(), False),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("collection", T.StringType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("source", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("page", T.LongType()),
        T.StructField("chunk_no", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("document", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
