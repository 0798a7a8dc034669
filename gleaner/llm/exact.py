"""Exact duplicates by distributed radix partitioning, most significant byte first.

Texts are compared byte by byte, never by a digest. A round takes the next
bytes of every text that still has company, groups by (group so far, bytes) and
lets go what is alone or has ended. Rounds read ever longer windows, so the
number of rounds grows with the logarithm of the text length up to the widest
window. A group is only ever an aggregate with a map side (its size, its
smallest row and its largest id), so a text with millions of copies costs no task
more than another; the join back is a sort-merge join that Spark splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import boxed, mark, maybe_broadcast, short_batches, unboxed
from gleaner.session import stage

#: Bytes of the first window, factor from round to round, bytes of the widest window.
FIRST_BYTES, GROWTH, WIDEST_BYTES = 32, 8, 1 << 18

#: Characters that decide whether a text has company at all; only such texts enter the rounds.
HEAD_CHARS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lowered = pc.ascii_lower(batch.column("text")).cast(pa.binary())
        digests = [hashlib.sha256(v.as_buffer()).hexdigest() for v in lowered]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), batch.column("head"), pa.array(digests, pa.string())],
            ["doc_id", "mark", "head", "text_sha256"],
        )


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lowered = pc.ascii_lower(batch.column("text")).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), lowered], ["doc_id", "mark", "body"])


def copies(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, mark`` for every row of ``docs`` (``doc_id``, ``text``).

    Texts are equal when identical after lower-casing A-Z only; null counts as
    empty. The largest ``doc_id`` of a group stays; a null id only where the
    group has no other, and then every row of the group stays. Rows that repeat
    an id and a text all carry the same decision. Other columns are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    head = F.translate(F.substring(text, 1, HEAD_CHARS), _UPPER, _LOWER)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"), head.alias("head"), text.alias("text"))
    rows = stage(
        plain.mapInArrow(_digests, "doc_id long, mark long, head string, text_sha256 string"),
        "exact-rows",
    )
    company = stage(rows.groupBy("head").agg(F.count("*").alias("n")).filter("n > 1").select("head"), "exact-heads")
    company = maybe_broadcast(company, 4 * company.count())
    state = stage(
        plain.join(company, "head", "left_semi").select("doc_id", "mark", "text").mapInArrow(_bodies, "doc_id long, mark long, body binary")
        .withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.lit(0).cast("long")),
        "exact-bodies",
    )
    done, width = [], FIRST_BYTES
    while not state.isEmpty():
        window = state.withColumn("window", F.substring(F.col("body"), 1, width))
        parts = window.groupBy("part", "window").agg(
            F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"), F.min("row").alias("next_part")
        )
        parts = stage(parts, "exact-parts")  # stored, so that the join can split a large group
        split = window.join(parts.hint("merge"), ["part", "window"])
        ended = F.length("window") < width
        split = stage(
            split.select(
                "doc_id", "mark", "row", F.col("next_part").alias("part"), "group_size", "keep_id", ended.alias("ended"),
                F.when(ended | (F.col("group_size") == 1), None).otherwise(F.expr(f"substring(body, {width + 1})")).alias("body"),
            ),
            "exact-round",
        )
        done.append(split.filter("ended AND group_size > 1").select("doc_id", "mark", "keep_id", "group_size"))
        state = split.filter("NOT ended AND group_size > 1").select("doc_id", "mark", "body", "row", "part")
        width = min(width * GROWTH, WIDEST_BYTES)
    # Every row of one id and text has the same decision.
    shared = done[0] if done else rows.select("doc_id", "mark", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).limit(0)
    for more in done[1:]:
        shared = shared.unionByName(more)
    shared = shared.distinct().select(F.col("doc_id").alias("id"), F.col("mark").alias("m"), "keep_id", "group_size")
    found = rows.join(shared.hint("merge"), rows["doc_id"].eqNullSafe(shared["id"]) & (rows["mark"] == shared["m"]), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "mark",
    )


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows named by (``doc_id``, ``mark``) in the staged table ``dropped``."""
    names = dropped.select("doc_id", "mark")
    names = maybe_broadcast(names, names.count())
    rows = boxed(docs)
    return unboxed(rows.join(names, rows["id"].eqNullSafe(names["doc_id"]) & (rows["own"] == names["mark"]), "left_anti"), docs.columns)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row left of every group of equal texts, columns unchanged whatever their names.

    Where rows repeat both id and text, one of them stays.
    """
    decided = stage(copies(docs).select("doc_id", "mark", "kept"), "exact-decided")
    kept = without(docs, stage(decided.filter("NOT kept").select("doc_id", "mark").distinct(), "exact-dropped"))
    again = stage(decided.filter("kept").groupBy("doc_id", "mark").count().filter("count > 1").select("doc_id", "mark"), "exact-again")
    if again.isEmpty():
        return kept
    single = without(kept, again)
    rows = boxed(kept)
    repeated = rows.join(again, rows["id"].eqNullSafe(again["doc_id"]) & (rows["own"] == again["mark"]), "left_semi")
    return single.unionByName(unboxed(repeated.dropDuplicates(["id", "own"]), docs.columns))
