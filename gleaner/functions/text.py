"""Scalar text functions as column expressions (no Python in the data path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import schemas as S

# --- Fixed values -----------------------------------------------------------
# Characters a Unicode-aware strip removes.
WHITESPACE = "".join(
    map(
        chr,
        [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288],
    )
)
# Line ends of a Unicode-aware line split.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TRACKING = r"(?i)[?&](utm_[^=]+|gclid|fbclid)=[^&]+"
SQL_WORDS = ("select", "with", "pragma", "explain", "update", "insert", "delete")
PDF_EXT = (".pdf",)
IMAGE_EXT = (".png", ".jpg", ".jpeg", ".gif", ".webp")
IMAGE_EXT_WIDE = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".gif", ".webp")
TABLE_EXT = (".csv", ".xlsx")
TABLE_EXT_WIDE = (".csv", ".xlsx", ".xls")
# ----------------------------------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    """Strip Unicode whitespace on both ends."""
    return F.btrim(_c(col), F.lit(WHITESPACE))


def collapse_whitespace(col: Column | str) -> Column:
    """Whitespace runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(_c(col), r"(?U)[\s\x1c-\x1f]+", " "))


def normalize_url(col: Column | str) -> Column:
    """Strip, drop tracking parameters, drop one trailing slash."""
    url = F.regexp_replace(strip(F.coalesce(_c(col), F.lit(""))), TRACKING, "")
    return F.when(url.endswith("/"), F.substring(url, F.lit(1), F.length(url) - 1)).otherwise(url)


def split_urls(col: Column | str) -> Column:
    """Array of the nonblank entries of a comma- or newline-separated list."""
    lines = F.split(F.replace(_c(col), F.lit(","), F.lit("\n")), LINE_BREAK)
    return F.filter(F.transform(lines, strip), lambda u: u != "")


def base_name(col: Column | str) -> Column:
    """Last path component."""
    return F.substring_index(_c(col), "/", -1)


def extension(col: Column | str) -> Column:
    """Lowercased extension with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(base_name(col), r"(?s)^\.*[^.].*?(\.[^.]*)$", 1))


def stem(col: Column | str) -> Column:
    """Base name without its extension."""
    return F.regexp_replace(base_name(col), r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def table_name(col: Column | str) -> Column:
    """Table name for a file: other characters to ``_``, trimmed, lowercased."""
    name = F.lower(F.btrim(F.regexp_replace(stem(col), "[^A-Za-z0-9_]+", "_"), F.lit("_")))
    return F.when(name == "", F.lit("table_1")).otherwise(name)


def table_name_plain(col: Column | str) -> Column:
    """Variant: lowercase, spaces to ``_``, nothing else."""
    return F.replace(F.lower(stem(col)), F.lit(" "), F.lit("_"))


def file_kind(col: Column | str, wide: bool = False) -> Column:
    """``pdf``, ``image``, ``table`` or ``unsupported``, by extension.

    ``wide`` accepts the longer lists of the table pipeline.
    """
    ext = extension(col)
    return (
        F.when(ext.isin(*PDF_EXT) & F.lit(not wide), "pdf")
        .when(ext.isin(*(IMAGE_EXT_WIDE if wide else IMAGE_EXT)), "image")
        .when(ext.isin(*(TABLE_EXT_WIDE if wide else TABLE_EXT)), "table")
        .otherwise("unsupported")
    )


def looks_like_sql(col: Column | str) -> Column:
    """True where the text starts with a statement word (no word boundary)."""
    head = F.lower(strip(F.coalesce(_c(col), F.lit(""))))
    return head.rlike("^(" + "|".join(SQL_WORDS) + ")")


def preview(col: Column | str) -> Column:
    """First 220 characters, stripped, then newlines to spaces."""
    cut = F.substring(F.coalesce(_c(col), F.lit("")), 1, S.PREVIEW_CHARS)
    return F.translate(strip(cut), "\n", " ")


def ocr_preview(col: Column | str) -> Column:
    """Newlines to spaces, then the first 140 characters."""
    return F.substring(F.translate(_c(col), "\n", " "), 1, S.OCR_PREVIEW_CHARS)


def ocr_text(text: Column | str, path: Column | str) -> Column:
    """Stripped text; the file's base name where the text is blank."""
    return F.coalesce(F.nullif(strip(text), F.lit("")), base_name(path))


def content_hash(col: Column | str) -> Column:
    """SHA-256 over bytes (or over the UTF-8 bytes of a string)."""
    return F.sha2(_c(col), 256)


def url_chunk_id(source: Column, chunk_no: Column) -> Column:
    return F.concat(source, F.lit("#chunk="), chunk_no.cast("string"))


def paged_chunk_id(source: Column, page: Column, chunk_no: Column) -> Column:
    page_text = F.coalesce(page.cast("string"), F.lit("None"))
    return F.concat(source, F.lit("#page="), page_text, F.lit("_chunk="), chunk_no.cast("string"))


def image_chunk_id(path: Column) -> Column:
    return F.concat(path, F.lit("#img_chunk=0"))


def table_chunk_id(base: Column, chunk_no: Column) -> Column:
    return F.concat(base, F.lit("#tab_chunk="), chunk_no.cast("string"))


def row_id(index: Column) -> Column:
    return F.concat(F.lit("id"), index.cast("string"))


def content_id(source: Column, text: Column) -> Column:
    """SHA-1 of source and text: the same text under the same source, the same id."""
    return F.sha1(F.concat_ws("|", source, text))


def merge_metadata(left: Column, right: Column) -> Column:
    """Union of two maps, the right side winning on shared keys."""
    keep = F.map_filter(left, lambda k, _v: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(keep, right)


def cap_facts(facts: Column) -> Column:
    """Fact map with ``fact:`` keys and values cut to 160 characters."""
    short = F.transform_values(facts, lambda _k, v: F.substring(v, 1, S.FACT_CHARS))
    return F.transform_keys(short, lambda k, _v: F.concat(F.lit("fact:"), k))


def row_document(columns: list[str], types: dict[str, str] | None = None) -> Column:
    """One text per row: ``name: value,`` and a newline for every column.

    A missing value prints ``nan``, as a data frame library prints it.
    """
    parts = [
        F.concat(F.lit(f"{name}: "), F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("nan")), F.lit(",\n"))
        for name in columns
    ]
    return F.concat(*parts)


def csv_line(columns: list[str], dtypes: dict[str, str]) -> Column:
    """A row as one CSV line with minimal quoting."""
    fields = []
    for name in columns:
        value = F.col(f"`{name}`").cast("string")
        if dtypes.get(name) == "boolean":
            value = F.initcap(value)
        quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        fields.append(
            F.when(value.isNull(), F.lit('""' if len(columns) == 1 else ""))
            .when(value.rlike('[,"\n\r]'), quoted)
            .otherwise(value)
        )
    return F.concat_ws(",", *fields)


def csv_header(columns: list[str]) -> str:
    """The header line that goes with :func:`csv_line`."""
    out = []
    for name in columns:
        special = any(ch in name for ch in ',"\n\r')
        out.append('"' + name.replace('"', '""') + '"' if special else name)
    return ",".join(out)
