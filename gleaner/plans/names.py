"""Names of typed SQL that Spark does not know, as SQL-defined functions of the session.

Users type the names they know from small databases: ``strftime``, ``julianday``, ``glob``, ``json_each``,
``group_concat``, ``total``. Scalar and table-valued ones are temporary functions in Spark SQL; Catalyst
inlines them, so nothing leaves the JVM. Aggregates cannot be defined in SQL, and built-in names cannot be
replaced, so those few calls are spelled anew in the statement (:func:`respelled`).
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

# --- Fixed values -----------------------------------------------------------
# Codes of strftime: (code, expression over the moment ``t``). What the codes mean decides results.
STRFTIME = (
    ("%Y", "date_format(t, 'yyyy')"), ("%m", "date_format(t, 'MM')"), ("%d", "date_format(t, 'dd')"), ("%e", "lpad(CAST(day(t) AS STRING), 2, ' ')"),
    ("%H", "date_format(t, 'HH')"), ("%I", "date_format(t, 'hh')"), ("%M", "date_format(t, 'mm')"), ("%S", "date_format(t, 'ss')"),
    ("%f", "date_format(t, 'ss.SSS')"), ("%j", "date_format(t, 'DDD')"), ("%F", "date_format(t, 'yyyy-MM-dd')"), ("%T", "date_format(t, 'HH:mm:ss')"),
    ("%R", "date_format(t, 'HH:mm')"), ("%p", "date_format(t, 'a')"), ("%w", "CAST(dayofweek(t) - 1 AS STRING)"),
    ("%u", "CAST(weekday(t) + 1 AS STRING)"), ("%W", "lpad(CAST(CAST(floor((dayofyear(t) + 6 - weekday(t)) / 7) AS INT) AS STRING), 2, '0')"),
    ("%s", "CAST(name_seconds(t) AS STRING)"), ("%J", "CAST(name_days(t) AS STRING)"),
)
# Julian day of 1970-01-01 00:00.
EPOCH_DAY = 2440587.5
# ----------------------------------------------------------------------------

#: Modifiers a date function takes at most.
MODIFIERS = 4

_MARKED = "m1 STRING DEFAULT '', m2 STRING DEFAULT '', m3 STRING DEFAULT '', m4 STRING DEFAULT ''"
_MOVED = "name_moved(name_moved(name_moved(name_moved(name_moment(x, m1), m1), m2), m3), m4)"
_NUMBER = "^[+-]?[0-9]+([.][0-9]*)?$"
_STEP = "^([+-]?[0-9]+(?:[.][0-9]*)?) +(second|minute|hour|day|month|year)s?$"


def _strftime() -> str:
    text = "replace(f, '%%', char(1))"
    for code, value in STRFTIME:
        text = f"replace({text}, '{code}', {value})"
    return f"replace({text}, char(1), '%')"


#: (name and parameters, result, body). Later ones use earlier ones.
FUNCTIONS = (
    ("name_seconds(t TIMESTAMP_NTZ)", "BIGINT", "unix_seconds(CAST(CAST(t AS STRING) || '+00:00' AS TIMESTAMP))"),
    ("name_days(t TIMESTAMP_NTZ)", "DOUBLE", f"unix_micros(CAST(CAST(t AS STRING) || '+00:00' AS TIMESTAMP)) / 86400000000.0D + {EPOCH_DAY}D"),
    ("name_after(seconds DOUBLE)", "TIMESTAMP_NTZ", "TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, try_cast(round(seconds, 3) AS DECIMAL(18, 6)))"),
    # A date, a date with a time, a time of the first day of 2000, a Julian day, or seconds where the first modifier says so.
    (
        "name_moment(x STRING, m STRING)",
        "TIMESTAMP_NTZ",
        f"""CASE WHEN lower(trim(x)) = 'now' THEN CAST(now() AS TIMESTAMP_NTZ)
  WHEN x RLIKE '{_NUMBER}' AND lower(trim(m)) = 'unixepoch' THEN name_after(try_cast(x AS DOUBLE))
  WHEN x RLIKE '{_NUMBER}' THEN name_after((try_cast(x AS DOUBLE) - {EPOCH_DAY}D) * 86400.0D)
  WHEN x RLIKE '^[0-9][0-9]:[0-9][0-9]' THEN try_cast('2000-01-01 ' || x AS TIMESTAMP_NTZ)
  WHEN x RLIKE '^[0-9]{{4}}-[0-9][0-9]-[0-9][0-9]' THEN try_cast(x AS TIMESTAMP_NTZ) END""",
    ),
    # Months and years keep the day of the month; a day the month does not have runs on into the next one.
    (
        "name_moved(t TIMESTAMP_NTZ, m STRING)",
        "TIMESTAMP_NTZ",
        f"""CASE WHEN m IS NULL THEN NULL WHEN lower(trim(m)) IN ('', 'unixepoch', 'utc', 'localtime') THEN t
  WHEN lower(m) RLIKE '^ *start of (day|month|year) *$' THEN CAST(date_trunc(regexp_extract(lower(m), 'start of (day|month|year)', 1), t) AS TIMESTAMP_NTZ)
  WHEN lower(m) RLIKE '^ *weekday [0-6] *$' THEN t + make_dt_interval(CAST(pmod(try_cast(regexp_extract(m, '([0-6])', 1) AS INT) - dayofweek(t) + 1, 7) AS INT))
  WHEN lower(trim(m)) RLIKE '{_STEP}' THEN CASE
    WHEN regexp_extract(lower(trim(m)), '{_STEP}', 2) IN ('month', 'year')
    THEN CAST(date_trunc('month', t) AS TIMESTAMP_NTZ) + make_ym_interval(0, try_cast(try_cast(regexp_extract(lower(trim(m)), '{_STEP}', 1) AS DOUBLE) AS INT)
        * if(regexp_extract(lower(trim(m)), '{_STEP}', 2) = 'year', 12, 1)) + (t - CAST(date_trunc('month', t) AS TIMESTAMP_NTZ))
    ELSE t + make_dt_interval(0, 0, 0, try_cast(round(try_cast(regexp_extract(lower(trim(m)), '{_STEP}', 1) AS DOUBLE)
        * CASE regexp_extract(lower(trim(m)), '{_STEP}', 2) WHEN 'day' THEN 86400 WHEN 'hour' THEN 3600 WHEN 'minute' THEN 60 ELSE 1 END, 3) AS DECIMAL(18, 6))) END END""",
    ),
    (f"date_text(x STRING, {_MARKED})", "STRING", f"date_format({_MOVED}, 'yyyy-MM-dd')"),
    (f"time_text(x STRING, {_MARKED})", "STRING", f"date_format({_MOVED}, 'HH:mm:ss')"),
    (f"datetime(x STRING, {_MARKED})", "STRING", f"date_format({_MOVED}, 'yyyy-MM-dd HH:mm:ss')"),
    (f"julianday(x STRING, {_MARKED})", "DOUBLE", f"name_days({_MOVED})"),
    (f"unixepoch(x STRING, {_MARKED})", "BIGINT", f"name_seconds({_MOVED})"),
    ("name_formatted(f STRING, t TIMESTAMP_NTZ)", "STRING", _strftime()),
    (f"strftime(f STRING, x STRING, {_MARKED})", "STRING", f"name_formatted(f, {_MOVED})"),
    # The whole text; * any characters, ? one, [..] one of a set, [^..] one outside it.
    (
        "glob(pattern STRING, x STRING)",
        "BOOLEAN",
        r"x RLIKE ('(?s)^' || regexp_replace(regexp_replace(regexp_replace(pattern, '([\\\\.(){}+|$&~]|(?<!\\[)\\^)', '\\\\$1'), '\\*', '.*'), '\\?', '.') || '$')",
    ),
    ("unicode(x STRING)", "INT", "ascii(x)"),
    ("json_extract(j STRING, path STRING)", "STRING", "get_json_object(j, path)"),
    # In brackets what follows the value shows; the parser alone would stop before it.
    ("json_valid(j STRING)", "BOOLEAN", "if(j IS NULL, NULL, try_parse_json('[' || j || ']') IS NOT NULL AND coalesce(json_array_length('[' || j || ']'), 0) = 1)"),
    (
        "name_json_type(v VARIANT)",
        "STRING",
        """CASE WHEN v IS NULL OR is_variant_null(v) THEN 'null' WHEN schema_of_variant(v) = 'BOOLEAN' THEN CAST(v AS STRING) WHEN schema_of_variant(v) = 'STRING' THEN 'text'
  WHEN schema_of_variant(v) = 'BIGINT' THEN 'integer' WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN 'array' WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN 'object' ELSE 'real' END""",
    ),
    ("json_type(j STRING)", "STRING", "if(j IS NULL, NULL, name_json_type(parse_json(j)))"),
    # One row a member of an object or array; members that are no scalars as JSON.
    (
        "json_each(j STRING)",
        "TABLE(key STRING, value STRING, type STRING)",
        """SELECT coalesce(e.key, CAST(e.pos AS STRING)), if(name_json_type(e.value) IN ('array', 'object'), to_json(e.value), CAST(e.value AS STRING)), name_json_type(e.value)
  FROM variant_explode(parse_json(j)) AS e""",
    ),
)

_KNOWN = "gleaner.sql.names"


_NAMES = re.compile(r"\b(" + "|".join(head.split("(")[0] for head, _, _ in FUNCTIONS) + r")\s*\(", re.I)


def define(spark: SparkSession, statement: str) -> None:
    """Make the names known to the session, once, if ``statement`` uses one."""
    if not _NAMES.search(_code(statement)) or spark.conf.get(_KNOWN, None) == "1":
        return
    for head, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {result} RETURN {body}")
    spark.conf.set(_KNOWN, "1")


#: Text, quoted names and comments: nothing inside them is a call.
_SKIPPED = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.S)
_CALL = re.compile(r"\b(total|group_concat|json_group_array|iif|date|time|min|max)\s*\(", re.I)
_TAIL = re.compile(r"\s*(filter|over)\s*\(", re.I)


def _code(text: str) -> str:
    """``text`` of equal length with blanks for all that is no code."""
    return _SKIPPED.sub(lambda m: " " * len(m[0]), text)


def _closing(code: str, opened: int) -> int:
    """Place of the bracket that closes the one at ``opened``, or -1."""
    depth = 0
    for at in range(opened, len(code)):
        depth += {"(": 1, ")": -1}.get(code[at], 0)
        if not depth:
            return at
    return -1


def _arguments(text: str) -> list[str]:
    """Arguments between the brackets of a call."""
    code, parts, depth, first = _code(text), [], 0, 0
    for at, c in enumerate(code):
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(c, 0)
        if c == "," and not depth:
            parts.append(text[first:at])
            first = at + 1
    return [p.strip() for p in [*parts, text[first:]]] if text.strip() else []


def _spelled(name: str, inside: str, tail: str) -> str | None:
    """A call in Spark's spelling, or None where it is Spark's already. ``tail``: its FILTER and OVER."""
    arguments = _arguments(inside)
    distinct = ""
    if name in ("total", "group_concat") and arguments and re.match(r"distinct\b", arguments[0], re.I):
        distinct, arguments[0] = "DISTINCT ", arguments[0][8:].strip()
    if name == "iif" and len(arguments) in (2, 3):
        return f"if({', '.join([*arguments, 'NULL'][:3])}){tail}"
    if name == "total" and len(arguments) == 1:
        return f"coalesce(sum({distinct}CAST({arguments[0]} AS DOUBLE)){tail}, 0.0D)"
    if name == "group_concat" and arguments:
        ordered = re.search(r"\border\s+by\b", _code(arguments[-1]), re.I)
        within = ""
        if ordered:
            order = arguments[-1][ordered.start() :]
            arguments[-1] = arguments[-1][: ordered.start()].strip()
            if distinct:  # the order has to be that of the texts put together
                order = order.replace(arguments[0], f"CAST({arguments[0]} AS STRING)")
            within = f" WITHIN GROUP ({order})"
        if len(arguments) <= 2:
            return f"listagg({distinct}CAST({arguments[0]} AS STRING), {arguments[1] if len(arguments) == 2 else repr(',')}){within}{tail}"
    if name == "json_group_array" and len(arguments) == 1:
        return f"to_json(collect_list({arguments[0]}){tail})"
    if name in ("date", "time") and len(arguments) > 1:
        return f"{name}_text({inside}){tail}"
    if name in ("min", "max") and len(arguments) > 1:
        missing = " OR ".join(f"({a}) IS NULL" for a in arguments)
        return f"if({missing}, NULL, {'least' if name == 'min' else 'greatest'}({', '.join(arguments)})){tail}"
    return None


def respelled(statement: str) -> str:
    """``statement`` with the calls spelled anew that Spark cannot define: ``total``, ``group_concat``, ``json_group_array``,
    ``iif``, ``date`` and ``time`` with modifiers, and ``min`` and ``max`` of several values (NULL if one is NULL).

    Everything else, text, quoted names and comments included, stays as it is.
    """
    at = 0
    while True:
        code = _code(statement)
        call = _CALL.search(code, at)
        if not call:
            return statement
        closed = _closing(code, call.end() - 1)
        if closed < 0:
            return statement
        end = closed + 1
        tail = _TAIL.match(code, end)
        while tail:
            shut = _closing(code, tail.end() - 1)
            if shut < 0:
                return statement
            end = shut + 1
            tail = _TAIL.match(code, end)
        new = _spelled(call[1].lower(), statement[call.end() : closed], statement[closed + 1 : end])
        if new is None:
            at = call.end()
        else:
            statement = statement[: call.start()] + new + statement[end:]
            # Calls inside the arguments come next; Spark's own name is not met again.
            at = call.start()
