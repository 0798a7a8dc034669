"""Cites per question: dedupe, numbering, context, prompt, answer, resolution.

A question never has more than ``3k`` cites, so they travel as one short array
per question and every step is an array expression: one exchange by question
in all, however long the chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import schemas as S
from gleaner.functions.text import LINE_BREAK, preview, strip

# --- Fixed values -----------------------------------------------------------
SYSTEM_ROLE = (
    "You are a concise assistant. Use ONLY the provided context. "
    "If the context is insufficient, say you do not know and ask for details."
)
NO_HITS = "I couldn't find anything relevant in your indexed sources."
NO_MODEL = "(No LLM configured)\n\nTop cites:\n"
ASK = (
    "Answer briefly. Cite minimally by including [n] only for the specific item numbers you actually used. "
    "If nothing in the context answers the question, reply exactly: I don't know."
)
SOURCES_HEAD = "\n\nSources:\n"
SOURCES_BLOCK = r"(?dims)^Sources:\s*$(.*)"
SOURCE_LINE = r"^[-*]?\s*\[(\d+)\]\s+(.+)$"
SOURCE_SUFFIX = r"\s*\(ti_[^)]+\)\s*$"
STOP_WORDS = ("message", "type your question")
# ----------------------------------------------------------------------------


def cite_lists(ranked: DataFrame) -> DataFrame:
    """One row per question with its cites in ranked order."""
    cite = F.struct(
        "rank",
        "id",
        "collection",
        F.coalesce("source", F.lit("")).alias("source"),
        preview("document").alias("preview"),
        F.coalesce("distance", F.lit(0.0)).alias("distance"),
    )
    return ranked.groupBy("qid").agg(F.array_sort(F.collect_list(cite)).alias("cites"))


def dedupe_by_source(cites: Column) -> Column:
    """First cite per source (per id where the source is empty)."""

    def key(c: Column) -> Column:
        return F.when(c["source"] == "", F.concat(F.lit("i:"), c["id"])).otherwise(F.concat(F.lit("s:"), c["source"]))

    keys = F.transform(cites, key)
    return F.filter(cites, lambda c, i: F.array_position(keys, key(c)) == i + 1)


def context(cites: Column) -> Column:
    """Numbered context text."""
    items = F.transform(
        cites,
        lambda c, i: F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] Source: "), c["source"],
            F.lit("\nSnippet: "), c["preview"], F.lit("\n"),
        ),
    )
    return F.array_join(items, "\n\n")


def user_prompt(question: Column, context_text: Column) -> Column:
    return F.concat(
        F.lit("Question: "), question, F.lit("\n\nUse ONLY this context:\n"), context_text, F.lit("\n\n" + ASK)
    )


def context_answer(cites: Column, context_text: Column) -> Column:
    """Answer without a model: the context, or the fixed no-hit sentence."""
    none = cites.isNull() | (F.size(cites) == 0)
    return F.when(none, F.lit(NO_HITS)).otherwise(F.concat(F.lit(NO_MODEL), context_text))


def cited_numbers(text: Column, max_n: Column) -> Column:
    """Distinct ``[n]`` marks with 1 <= n <= max_n, ascending."""
    marks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[(\d+)\]"), 1)
    numbers = F.transform(marks, lambda m: m.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= max_n))))


def used_cites(text: Column, cites: Column, k: int = S.TOP_K) -> Column:
    """Cites an answer refers to; its first cite where it refers to none."""
    used = cited_numbers(text, F.size(cites))
    picked = F.when(F.size(used) > 0, F.transform(used, lambda n: F.get(cites, n - 1))).otherwise(
        F.slice(cites, 1, 1)
    )
    return F.slice(dedupe_by_source(picked), 1, k)


def number_cites(cites: Column) -> Column:
    """Add the context number ``n`` to every cite."""
    return F.transform(
        cites,
        lambda c, i: F.struct(
            (i + 1).alias("n"), c["id"].alias("id"), c["collection"].alias("collection"),
            c["source"].alias("source"), c["preview"].alias("preview"), c["distance"].alias("distance"),
        ),
    )


def resolve_cites(answers: DataFrame, numbered: DataFrame, k: int = S.TOP_K) -> DataFrame:
    """Answers (``qid``, ``answer``) with the cites they use.

    ``numbered`` has ``qid`` and ``cites`` as :func:`number_cites` gives them.
    """
    return answers.join(numbered, "qid").withColumn("used", used_cites(F.col("answer"), F.col("cites"), k))


def sources_block(cites: Column, renumber: bool = True) -> Column:
    """The ``Sources:`` tail of an answer; empty without cites."""
    lines = F.transform(
        cites,
        lambda c, i: F.concat(
            F.lit("["), ((i + 1) if renumber else c["n"]).cast("string"), F.lit("] "), c["source"],
            F.lit(" ("), c["collection"], F.lit(")"),
        ),
    )
    return F.when(F.size(cites) > 0, F.concat(F.lit(SOURCES_HEAD), F.array_join(lines, "\n"))).otherwise("")


def parse_sources(text: Column) -> Column:
    """Array of ``struct(n, source)`` read back from an answer's sources block."""
    tail = strip(F.regexp_extract(F.coalesce(text, F.lit("")), SOURCES_BLOCK, 1))
    lines = F.filter(F.transform(F.split(tail, LINE_BREAK), strip), lambda x: x != "")

    def stops(line: Column) -> Column:
        low = F.lower(line)
        stop = ~line.rlike(SOURCE_LINE)
        for word in STOP_WORDS:
            stop = stop | low.startswith(word)
        return stop

    first_stop = F.array_position(F.transform(lines, stops), F.lit(True))
    good = F.slice(lines, F.lit(1), F.when(first_stop == 0, F.size(lines)).otherwise(first_stop - 1).cast("int"))
    return F.transform(
        good,
        lambda x: F.struct(
            F.regexp_extract(x, SOURCE_LINE, 1).try_cast("int").alias("n"),
            strip(F.regexp_replace(strip(F.regexp_extract(x, SOURCE_LINE, 2)), SOURCE_SUFFIX, "")).alias("source"),
        ),
    )


def snippet_text(n: Column, source: Column, chunks: Column) -> Column:
    """Evidence text of one source from its ordered snippet texts."""
    head = F.concat(F.lit("**Source ["), n.cast("string"), F.lit("]**  \n`"), source, F.lit("`"))
    parts = F.transform(
        chunks, lambda c, i: F.concat(F.lit("**Chunk "), (i + 1).cast("string"), F.lit("**\n"), strip(c), F.lit("\n---"))
    )
    body = F.concat(head, F.lit("\n"), F.when(F.size(chunks) > 0, F.lit("\n")).otherwise(""), F.array_join(parts, "\n"))
    return F.regexp_replace(body, r"-+\z", "")
