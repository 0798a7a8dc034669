"""Chat turns to pairs, titles, labels and the session archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import schemas as S
from gleaner.functions.text import strip
from gleaner.operators.numbering import next_row, number_rows


def turn_pairs(turns: DataFrame) -> DataFrame:
    """(user, bot) pairs from turn rows; a last message may lack its reply."""
    spoken = turns.where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", "text")
    seen = next_row(spoken, ["conv_id"], "turn", ["role", "text"])
    reply = F.when(F.col("next_role") == "assistant", F.col("next_text"))
    return seen.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("user"), reply.alias("bot")
    )


def short_title(text: Column) -> Column:
    """First 44 characters and an ellipsis where there are more than 45."""
    cut = F.concat(F.substring(text, 1, S.TITLE_MAX - 1), F.lit("…"))
    return F.coalesce(F.when(F.length(text) > S.TITLE_MAX, cut).otherwise(text), F.lit("Untitled"))


def session_titles(pairs: DataFrame, archived_at: Column) -> DataFrame:
    """Title and number of pairs per conversation."""
    said = strip("user")
    first = F.min_by(said, F.when(said != "", F.col("turn")))
    return pairs.groupBy("conv_id").agg(
        F.concat(F.date_format(archived_at, "yyyy-MM-dd HH:mm"), F.lit(" · "), short_title(first)).alias("title"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


def session_label(sid: Column, title: Column, n_pairs: Column) -> Column:
    """``id · title (n msgs)``."""
    return F.concat(
        F.coalesce(sid.cast("string"), F.lit("?")), F.lit(" · "), F.coalesce(title, F.lit("Session")),
        F.lit(" ("), n_pairs.cast("string"), F.lit(" msgs)"),
    )


def archive(sessions: DataFrame, incoming: DataFrame, next_id: int = 1) -> DataFrame:
    """Session upsert.

    ``sessions``: ``id, title, n_pairs, position`` (greatest position first in
    the list). ``incoming``: ``active_id, title, n_pairs, arrival``. A known
    active id updates its row in place; anything else becomes a new session
    with the next id. Empty chats are not archived.
    """
    full = incoming.where(F.col("n_pairs") > 0)
    known = full.join(sessions.select(F.col("id").alias("active_id")), "active_id", "left_semi")
    edits = known.groupBy("active_id").agg(F.max_by(F.struct("title", "n_pairs"), "arrival").alias("_new"))
    changed = sessions.join(edits, sessions["id"] == edits["active_id"], "left").select(
        sessions["id"],
        F.coalesce("_new.title", sessions["title"]).alias("title"),
        F.coalesce("_new.n_pairs", sessions["n_pairs"]).alias("n_pairs"),
        sessions["position"],
    )
    fresh = full.join(sessions.select(F.col("id").alias("active_id")), "active_id", "left_anti")
    numbered = number_rows(fresh, [], "arrival", "_n")
    number = F.col("_n") + F.lit(next_id)
    added = numbered.select(number.cast("string").alias("id"), "title", "n_pairs", number.alias("position"))
    return changed.unionByName(added)
