"""Fact extraction over posters and invoices composed from ``orders``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import facts as facts_of
from gleaner.queries.common import lit, load
from gleaner.session import spread

# --- composed texts, the same expression in both engines ---------------------
# %s stands for a column turned to text.
_POSTER = (
    "Global {seg} Summit 20{yy}\n"
    "{month} {d1}{dash}{d2}, 20{yy}\n"
    "Convention Center Hall {hall}, Level {d1}\n"
    "Opening Keynote 9:{d1} AM - 10:{d2} AM\n"
    "Keynote: “Order {key} in Practice”\n"
    "Keynote by Ada Lovelace{key}\n"
    "Early-bird {d2}% off tickets ends {month} {d1}, 20{yy}\n"
    "Standard ${p1} Student: ${p2}\n"
    "Team pack {p3} Workshops ${p2}\n"
    "Expo hours 10:{d1}–18:{d2}{daily}"
)
_INVOICE = (
    "Invoice {no} {key}-{d1}\n"
    "Customer {cust}\n"
    "{word}{per}{qty} {unit}\n"
    "shall be paid by {month} {d1}"
)
_SLOTS = {
    "key": "CAST(o_orderkey AS STRING)",
    "cust": "CAST(o_custkey AS STRING)",
    "seg": "substring(o_orderpriority, 3, 20)",
    "yy": "CAST(20 + o_orderkey % 9 AS STRING)",
    "month": "CASE o_orderkey % 4 WHEN 0 THEN 'April' WHEN 1 THEN 'Jun' WHEN 2 THEN 'sept' ELSE 'December' END",
    "d1": "CAST(10 + o_orderkey % 10 AS STRING)",
    "d2": "CAST(20 + o_orderkey % 9 AS STRING)",
    "dash": "CASE o_orderkey % 3 WHEN 0 THEN '–' WHEN 1 THEN ' - ' ELSE ' to ' END",
    "hall": "o_orderstatus",
    "p1": "CAST(100 + o_custkey % 900 AS STRING)",
    "p2": "CAST(10 + o_custkey % 90 AS STRING)",
    "p3": "CAST(1000 + o_custkey % 9000 AS STRING)",
    "daily": "CASE o_orderkey % 3 WHEN 0 THEN ' daily' WHEN 1 THEN ' each day' ELSE '' END",
    "no": "CASE o_orderkey % 3 WHEN 0 THEN 'No:' WHEN 1 THEN '#' ELSE 'Notes' END",
    "word": "CASE o_orderkey % 2 WHEN 0 THEN 'Warranty' ELSE 'guarantee' END",
    "per": "CASE o_orderkey % 3 WHEN 0 THEN ' period ' WHEN 1 THEN ': ' ELSE ' period: ' END",
    "qty": "CAST(1 + o_orderkey % 5 AS STRING)",
    "unit": "CASE o_orderkey % 2 WHEN 0 THEN 'Years' ELSE 'month' END",
}


def _compose(template: str, newline: str) -> str:
    """A SQL concatenation that fills the slots of a template."""
    import re

    out = []
    for piece in re.split(r"(\{\w+\}|\n)", template):
        if piece == "\n":
            out.append(newline)
        elif piece.startswith("{"):
            out.append(f"({_SLOTS[piece[1:-1]]})")
        elif piece:
            out.append(lit(piece))
    return " || ".join(out)


POSTER_SQL = _compose(_POSTER, "chr(10)")
INVOICE_SQL = _compose(_INVOICE, "chr(10)")


def posters(spark, root) -> DataFrame:
    return spread(load(spark, root, "orders").select("o_orderkey", F.expr(POSTER_SQL).alias("t")))


def invoices(spark, root) -> DataFrame:
    return spread(load(spark, root, "orders").select("o_orderkey", F.expr(INVOICE_SQL).alias("t")))


def poster_images(spark, root) -> DataFrame:
    """Invoices as OCR text of image files."""
    rows = invoices(spark, root)
    path = F.concat(F.lit("/scans/"), F.col("o_orderkey").cast("string"), F.lit(".png"))
    return rows.select(path.alias("source"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".png")).alias("file"), F.col("t").alias("text"))


def _facts(df: DataFrame, *keys: str) -> DataFrame:
    found = facts_of.fact_columns(F.col("t"))
    return df.select("o_orderkey", *[found[k].alias(k) for k in keys])


def _extract(pattern: str, group: int, any_case: bool = True) -> str:
    flags = ", 'i'" if any_case else ", 'c'"
    return f"nullif(regexp_extract(t, {lit(pattern)}, {group}{flags}), '')"


_EVENT = ("event_name", "event_dates", "venue", "expo_hours", "early_bird")
_KEYNOTE = ("keynote_time", "keynote_title", "keynote_speaker")
_PRICES = ("price_standard", "price_student", "price_team", "price_workshop")
_INVOICE_KEYS = ("invoice_number", "warranty", "warranty_months")

FACT_SQL = {
    "event_name": f"nullif(trim({_extract(facts_of.EVENT_NAME, 1)}), '')",
    "event_dates": _extract(facts_of.EVENT_DATES, 0),
    "venue": f"nullif(trim({_extract(facts_of.VENUE, 0)}), '')",
    "keynote_time": f"trim({_extract(facts_of.KEYNOTE_TIME, 2)})",
    "keynote_title": f"trim(coalesce({_extract(facts_of.KEYNOTE_TITLE, 1, False)}, {_extract(facts_of.KEYNOTE_TITLE, 2, False)}))",
    "keynote_speaker": f"trim({_extract(facts_of.KEYNOTE_SPEAKER, 1, False)})",
    "early_bird": f"{_extract(facts_of.EARLY_BIRD, 2)} || '% off; ends ' || {_extract(facts_of.EARLY_BIRD, 3)}",
    **{f"price_{k}": _extract(facts_of.PRICE.replace("TIER", v), 2) for k, v in facts_of.PRICE_TIERS.items()},
    "expo_hours": f"{_extract(facts_of.EXPO_HOURS, 2)} || '–' || {_extract(facts_of.EXPO_HOURS, 3)} || "
    f"CASE WHEN {_extract(facts_of.EXPO_HOURS, 4)} IS NULL THEN '' ELSE ' daily' END",
    "invoice_number": _extract(facts_of.INVOICE, 3),
    "warranty": f"({_extract(facts_of.WARRANTY, 2)})::BIGINT || ' ' || lower({_extract(facts_of.WARRANTY, 3)}) || "
    f"CASE WHEN ({_extract(facts_of.WARRANTY, 2)})::BIGINT = 1 THEN '' ELSE 's' END",
    "warranty_months": f"(({_extract(facts_of.WARRANTY, 2)})::BIGINT * "
    f"CASE WHEN lower({_extract(facts_of.WARRANTY, 3)}) = 'year' THEN 12 ELSE 1 END)::VARCHAR",
}


def _twin(text: str, keys: tuple[str, ...]) -> str:
    columns = ", ".join(f"{FACT_SQL[k]} AS {k}" for k in keys)
    return f"SELECT o_orderkey, {columns} FROM (SELECT o_orderkey, {text} AS t FROM orders)"


def facts_event(spark, root):
    return _facts(posters(spark, root), *_EVENT)


def facts_keynote(spark, root):
    return _facts(posters(spark, root), *_KEYNOTE)


def facts_prices(spark, root):
    return _facts(posters(spark, root), *_PRICES)


def facts_invoice_warranty(spark, root):
    return _facts(invoices(spark, root), *_INVOICE_KEYS)


_QUESTIONS = (
    "What is the name of the event?", "On which dates?", "Where is it?", "Keynote time?", "Who gives the keynote?",
    "Keynote title, please", "Early bird offer?", "Standard price?", "Student price?", "4-pack price?",
    "Workshop price?", "Expo schedule?", "Which invoice number?", "Warranty in months?", "How long is the warranty?",
    "Anything else?",
)


def _pick(column: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {lit(q)}" for i, q in enumerate(_QUESTIONS))
    return f"CASE {column} % {len(_QUESTIONS)} {whens} END"


def direct_answer(spark, root):
    both = load(spark, root, "orders").select(
        "o_orderkey",
        F.expr(f"CASE WHEN o_orderkey % 2 = 0 THEN {POSTER_SQL} ELSE {INVOICE_SQL} END").alias("t"),
        F.expr(_pick("o_custkey")).alias("question"),
    )
    answer = facts_of.direct_answer(F.col("question"), facts_of.fact_columns(F.col("t")))
    return spread(both).select("o_orderkey", "question", answer.alias("answer"))


def _rule(words: str, answer: str) -> str:
    return f"CASE WHEN {words} THEN {answer} END"


_Q = "lower(question)"


def _has(*words: str) -> str:
    return "(" + " AND ".join(f"contains({_Q}, {lit(w)})" for w in words) + ")"


_ANSWER_SQL = "coalesce(" + ", ".join(
    [
        _rule(_has("event name") + " OR " + _has("what", "event", "name"), "event_name"),
        _rule(_has("event date") + " OR " + _has("dates"), "event_dates"),
        _rule(_has("venue") + " OR " + _has("where"), "venue"),
        _rule(_has("keynote", "time"), "keynote_time"),
        _rule(_has("keynote", "who") + " OR " + _has("keynote", "speaker"), "keynote_speaker"),
        _rule(_has("keynote", "title"), "'“' || keynote_title || '”'"),
        _rule(_has("early-bird") + " OR " + _has("early bird"), "early_bird"),
        _rule(_has("standard", "price"), "'$' || price_standard"),
        _rule(_has("student", "price"), "'$' || price_student"),
        _rule(_has("team", "price") + " OR " + _has("4-pack", "price"), "'$' || price_team"),
        _rule(_has("workshop", "price"), "'$' || price_workshop"),
        _rule(_has("expo", "hour") + " OR " + _has("expo", "time") + " OR " + _has("expo", "schedule"), "expo_hours"),
        _rule(_has("invoice", "no") + " OR " + _has("invoice", "number"), "invoice_number"),
        _rule(_has("warranty", "month"), "warranty_months || ' months'"),
        _rule(_has("warranty"), "warranty"),
    ]
) + ")"

QUERIES = {
    "facts_event": facts_event,
    "facts_keynote": facts_keynote,
    "facts_prices": facts_prices,
    "facts_invoice_warranty": facts_invoice_warranty,
    "direct_answer": direct_answer,
}
ORACLES = {
    "facts_event": _twin(POSTER_SQL, _EVENT),
    "facts_keynote": _twin(POSTER_SQL, _KEYNOTE),
    "facts_prices": _twin(POSTER_SQL, _PRICES),
    "facts_invoice_warranty": _twin(INVOICE_SQL, _INVOICE_KEYS),
    "direct_answer": f"WITH base AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN {POSTER_SQL} "
    f"ELSE {INVOICE_SQL} END AS t, {_pick('o_custkey')} AS question FROM orders), "
    f"found AS (SELECT *, {', '.join(f'{sql} AS {k}' for k, sql in FACT_SQL.items())} FROM base) "
    f"SELECT o_orderkey, question, {_ANSWER_SQL} AS answer FROM found",
}
