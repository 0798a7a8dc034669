"""Facts from poster, invoice and warranty text, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.embedding import let
from gleaner.functions.text import strip

# --- Fixed values -----------------------------------------------------------
MONTHS = (
    "(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?"
    "|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
EVENT_NAME = r"([A-Z][A-Za-z@&\s\-]+?(?:Summit|Conference|Expo)\s*20\d{2})"
EVENT_DATES = MONTHS + r"\s+\d{1,2}\s*(?:–|-|to)\s*\d{1,2},\s*20\d{2}"
VENUE = r"(Convention Center|Center|Hall\s*[A-Z0-9]+)[^\n]*"
KEYNOTE_TIME = (
    r"(Opening\s+Keynote|Keynote)[^\n]*?"
    r"(\d{1,2}:\d{2}\s*(?:AM|PM)?(?:\s*[–-]\s*\d{1,2}:\d{2}\s*(?:AM|PM)?)?)"
)
KEYNOTE_TITLE = r'(?:Keynote|Opening Keynote)[:\-\s]+“([^”]+)”|"([^"]+)"'
KEYNOTE_SPEAKER = r"(?:Keynote\s*by|Speaker|by)\s*([A-Z][A-Za-z\.\-]+(?:\s+[A-Z][A-Za-z\.\-]+)+)"
EARLY_BIRD = (
    r"(early[-\s]?bird)[^\n]*?(\d{1,2})%\s*off[^\n]*?(?:ends|until)\s*([A-Za-z]+\s*\d{1,2},\s*20\d{2})"
)
PRICE = r"\b(TIER)\b[^\n$]*\$?\s?(\d{2,5})"
PRICE_TIERS = {"standard": "Standard", "student": "Student", "team": "Team", "workshop": "Workshops?"}
EXPO_HOURS = r"(Expo|Exhibition)[^\n]*?(\d{1,2}:\d{2})\s*[–-]\s*(\d{1,2}:\d{2})\s*(daily|each day)?"
INVOICE = r"(Invoice\s*(No\.?|#)\s*[:\-]?\s*([A-Za-z0-9\-]+))"
WARRANTY = r"(warranty|guarantee)\s*(?:period|:)?\s*([0-9]+)\s*(year|month)s?"
FACT_KEYS = (
    "event_name", "event_dates", "venue", "keynote_time", "keynote_title", "keynote_speaker",
    "early_bird", "price_standard", "price_student", "price_team", "price_workshop",
    "expo_hours", "invoice_number", "warranty", "warranty_months",
)
# ----------------------------------------------------------------------------

# Unicode-aware classes, as the reference semantics have them.
_EXACT = "(?U)"
_ANY_CASE = "(?iU)"


def _first(text: Column, pattern: str, group: int = 0, flags: str = _ANY_CASE) -> Column:
    """Group of the first match, NULL without one; the pattern runs once."""
    found = F.regexp_extract(text, flags + pattern, group)
    return F.try_element_at(F.array_remove(F.array(found), ""), F.lit(1))


def _rewritten(text: Column, pattern: str, form: str, flags: str = _ANY_CASE) -> Column:
    """The first match written in another form from its groups."""
    return F.regexp_replace(_first(text, pattern, 0, flags), flags + pattern, form)


def _mentions(low: Column, *words: str) -> Column:
    """Cheap test that any of the words occurs, before a pattern is tried."""
    return reduce(or_, [F.contains(low, F.lit(w)) for w in words])


def fact_columns(text: Column) -> dict[str, Column]:
    """One nullable string column per fact; first match only.

    Every pattern sits behind a plain substring test of a word it cannot match
    without, so text that holds no such phrase never reaches a pattern.
    """
    t = strip(F.coalesce(text, F.lit("")))
    low = F.replace(F.lower(t), F.lit("ſ"), F.lit("s"))
    out: dict[str, Column] = {}

    # A name can only end in a year: without one, skip the long scan for its start.
    named = _mentions(low, "summit", "conference", "expo") & t.rlike(
        _ANY_CASE + r"(Summit|Conference|Expo)\s*20\d{2}"
    )
    out["event_name"] = F.when(named, strip(_first(t, EVENT_NAME, 1)))
    dated = F.contains(t, F.lit("20")) & F.contains(t, F.lit(","))
    out["event_dates"] = F.when(dated, _first(t, EVENT_DATES))
    out["venue"] = F.when(_mentions(low, "center", "hall"), strip(_first(t, VENUE)))

    keynote = _mentions(low, "keynote")
    out["keynote_time"] = F.when(keynote, strip(_first(t, KEYNOTE_TIME, 2)))
    quoted = F.contains(t, F.lit("“")) | F.contains(t, F.lit('"'))
    out["keynote_title"] = F.when(quoted, strip(_rewritten(t, KEYNOTE_TITLE, "$1$2", _EXACT)))
    named_by = F.contains(t, F.lit("by")) | F.contains(t, F.lit("Speaker"))
    out["keynote_speaker"] = F.when(named_by, strip(_first(t, KEYNOTE_SPEAKER, 1, _EXACT)))

    early = _rewritten(t, EARLY_BIRD, "$2% off; ends $3")
    out["early_bird"] = F.when(_mentions(low, "early"), early)
    for key, tier in PRICE_TIERS.items():
        out[f"price_{key}"] = F.when(_mentions(low, key), _first(t, PRICE.replace("TIER", tier), 2))

    hours = F.lower(_rewritten(t, EXPO_HOURS, "$2–$3 $4"))
    hours = F.rtrim(F.regexp_replace(hours, "each day$", "daily"))
    out["expo_hours"] = F.when(_mentions(low, "expo", "exhibition"), hours)
    out["invoice_number"] = F.when(_mentions(low, "invoice"), _first(t, INVOICE, 3))

    covered = _mentions(low, "warranty", "guarantee")
    term = F.regexp_replace(F.lower(_rewritten(t, WARRANTY, "$2 $3")), "^0+([0-9])", "$1")

    def told(found: Column) -> Column:
        """The term as it is shown and its months; the pattern runs once for both."""
        years = F.regexp_extract(found, "^([0-9]+) year$", 1)
        in_years = (years.try_cast("decimal(30,0)") * 12).cast("string")
        months = F.coalesce(in_years, F.substring_index(found, " ", 1))
        return F.struct(F.regexp_replace(found, "^(?!1 )(.*)$", "$1s").alias("shown"), months.alias("months"))

    cover = F.when(covered, let(term, told))
    out["warranty"], out["warranty_months"] = cover["shown"], cover["months"]
    return {key: out[key] for key in FACT_KEYS}


def extract_facts(text: Column) -> Column:
    """All facts as one struct of nullable strings."""
    return F.struct(*[col.alias(key) for key, col in fact_columns(text).items()])


def fact_map(facts: Column) -> Column:
    """The facts found, as a string map."""
    entries = [F.struct(F.lit(k).alias("key"), facts[k].alias("value")) for k in FACT_KEYS]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def direct_answer(question: Column, facts: Column | dict[str, Column]) -> Column:
    """Answer by the question's keywords; the first rule with its fact wins.

    With the columns of :func:`fact_columns` a row evaluates only the facts its
    question asks for.
    """
    q = F.lower(F.coalesce(question, F.lit("")))

    def asks(*words: str) -> Column:
        test = F.lit(True)
        for word in words:
            test = test & F.contains(q, F.lit(word))
        return test

    def dollars(key: str) -> Column:
        return F.concat(F.lit("$"), facts[key])

    title = facts["keynote_title"]
    quoted_title = F.when(title != "", F.concat(F.lit("“"), title, F.lit("”")))
    rules = [
        (asks("event name") | asks("what", "event", "name"), facts["event_name"]),
        (asks("event date") | asks("dates"), facts["event_dates"]),
        (asks("venue") | asks("where"), facts["venue"]),
        (asks("keynote", "time"), facts["keynote_time"]),
        (asks("keynote") & (asks("who") | asks("speaker")), facts["keynote_speaker"]),
        (asks("keynote", "title"), quoted_title),
        (asks("early-bird") | asks("early bird"), facts["early_bird"]),
        (asks("price", "standard"), dollars("price_standard")),
        (asks("price", "student"), dollars("price_student")),
        (asks("price") & (asks("team") | asks("4-pack")), dollars("price_team")),
        (asks("price", "workshop"), dollars("price_workshop")),
        (asks("expo") & (asks("hour") | asks("time") | asks("schedule")), facts["expo_hours"]),
        (asks("invoice") & (asks("no") | asks("number")), facts["invoice_number"]),
        (asks("warranty", "month"), F.concat(facts["warranty_months"], F.lit(" months"))),
        (asks("warranty"), facts["warranty"]),
    ]
    return F.coalesce(*[F.when(test, answer) for test, answer in rules])
