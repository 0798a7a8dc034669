"""Answers with cites for a table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import schemas as S
from gleaner.operators import citations as C
from gleaner.operators.nearest import nearest, nearest_in_source


def question_cites(chunks: DataFrame, questions: DataFrame, k: int = S.TOP_K) -> DataFrame:
    """``qid`` and the deduplicated cites among the ``3k`` nearest chunks."""
    ranked = nearest(chunks, questions, k * S.WIDEN)
    return C.cite_lists(ranked).withColumn("cites", C.dedupe_by_source(F.col("cites")))


def answer_questions(chunks: DataFrame, questions: DataFrame, k: int = S.TOP_K) -> DataFrame:
    """Context, prompts, context-only answer and cites per question.

    ``questions`` has ``qid``, ``question`` and ``vector``. A question without
    any hit gets the fixed sentence and no cites.
    """
    cites = question_cites(chunks, questions, k).withColumn("context", C.context(F.col("cites")))
    joined = questions.select("qid", "question").join(cites, "qid", "left")
    none = F.array().cast(cites.schema["cites"].dataType)
    shown = F.coalesce(F.slice("cites", 1, k), none)
    return joined.select(
        "qid",
        "question",
        "context",
        F.when(F.col("context").isNotNull(), F.lit(C.SYSTEM_ROLE)).alias("system_prompt"),
        C.user_prompt(F.col("question"), F.col("context")).alias("user_prompt"),
        C.context_answer(F.col("cites"), F.col("context")).alias("answer"),
        C.number_cites(F.coalesce("cites", none)).alias("all_cites"),
        C.number_cites(shown).alias("cites"),
    )


def answer_snippets(
    chunks: DataFrame, answers: DataFrame, shown: int = S.SHOWN_SOURCES, n: int = S.SNIPPETS, buckets: int | None = None
) -> DataFrame:
    """Evidence for stored answers (``answer_id, vector, text``).

    The first ``shown`` sources of each answer's block are looked up, the ``n``
    nearest chunks of each returned: one job for all answers. ``buckets`` of a
    stored chunk table limit what is read.
    """
    parsed = answers.select(
        "answer_id", "vector", F.posexplode(F.slice(C.parse_sources(F.col("text")), 1, shown)).alias("_i", "_s")
    )
    slots = parsed.select(
        F.concat_ws("#", F.col("answer_id").cast("string"), (F.col("_i") + 1).cast("string")).alias("qid"),
        "answer_id",
        (F.col("_i") + 1).alias("slot"),
        F.col("_s.n").alias("cite_no"),
        F.col("_s.source").alias("source"),
        "vector",
    )
    found = nearest_in_source(chunks, slots, n, buckets).select("qid", "snippet_no", F.col("document").alias("chunk"))
    return slots.drop("vector").join(found, "qid", "left").drop("qid")


def evidence_texts(snippets: DataFrame) -> DataFrame:
    """One evidence text per answer and slot."""
    listed = F.array_sort(
        F.collect_list(F.when(F.col("snippet_no").isNotNull(), F.struct("snippet_no", "chunk")))
    )
    return snippets.groupBy("answer_id", "slot", "cite_no", "source").agg(
        C.snippet_text(F.first("cite_no"), F.first("source"), F.transform(listed, lambda s: s["chunk"])).alias("text")
    )


def direct_answers(chunks: DataFrame, questions: DataFrame, k: int = S.TOP_K) -> DataFrame:
    """First image cite, in rank order, whose text answers the question."""
    from gleaner.functions.facts import direct_answer, fact_columns

    ranked = nearest(chunks, questions, k).where(F.col("collection") == S.IMAGES)
    asked = ranked.join(questions.select("qid", "question"), "qid")
    answered = asked.withColumn("answer", direct_answer(F.col("question"), fact_columns(F.col("document"))))
    best = answered.where(F.col("answer").isNotNull()).groupBy("qid").agg(
        F.min_by(F.struct("answer", "id", "source"), "rank").alias("_best")
    )
    return best.select("qid", "_best.answer", "_best.id", "_best.source")
