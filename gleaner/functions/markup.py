"""Page markup to text, title and language, as column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
HIDDEN = r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>"
COMMENT = r"(?s)<!--.*?-->"
TAG = r"<[a-zA-Z/!?][^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LANGUAGE = r"(?is)<html[^>]*\blang=[\"']?([a-zA-Z-]+)"
# ----------------------------------------------------------------------------


def unescape(col: Column) -> Column:
    """Decode character references in one pass (``&amp;lt;`` gives ``&lt;``)."""
    names = F.create_map(*[x for n, cp in name2codepoint.items() for x in (F.lit(n), F.lit(chr(cp)))])

    def code_point(number: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")

    def piece(part: Column) -> Column:
        ref = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);", 1)
        rest = F.substring(part, F.length(ref) + 2, F.length(part))
        decimal = code_point(F.substring(ref, F.lit(2), F.length(ref)).cast("bigint"))
        hexadecimal = code_point(F.conv(F.substring(ref, F.lit(3), F.length(ref)), 16, 10).cast("bigint"))
        named = F.try_element_at(names, ref)
        return (
            F.when(ref == "", F.concat(F.lit("&"), part))
            .when(ref.rlike("^#[0-9]"), F.concat(decimal, rest))
            .when(ref.startswith("#"), F.concat(hexadecimal, rest))
            .otherwise(F.coalesce(F.concat(named, rest), F.concat(F.lit("&"), part)))
        )

    parts = F.split(col, "&")
    decoded = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(piece(p)))
    return F.when(F.contains(col, F.lit("&")), F.array_join(decoded, "")).otherwise(col)


def page_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags dropped."""
    bare = F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), COMMENT, "")
    return unescape(F.regexp_replace(bare, TAG, ""))


def page_title(html: Column) -> Column:
    """Text of the title element, empty where there is none."""
    return unescape(F.regexp_extract(html, TITLE, 1))


def page_language(html: Column) -> Column:
    """``lang`` of the root element."""
    found = F.regexp_extract(html, LANGUAGE, 1)
    return F.when(found == "", F.lit("No language found.")).otherwise(found)
