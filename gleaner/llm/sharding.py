"""Shards that each hold the mixture of sources, by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.ranks import ranked
from gleaner.session import stage

#: Pieces of the whole order; every source is spread evenly over them.
PIECES = 16_384


def shards(docs: DataFrame, count: int = 8, seed: str = "shards") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs`` (``doc_id``, ``text``, ``source``).

    Rows are shuffled by a seeded digest of the id and ranked within their
    source; row ``r`` of ``n`` gets the fractional rank ``(r + 1/2) / n``. All
    rows sorted by it are cut into ``count`` runs whose lengths differ by one at
    most (law ``rows``), so that every shard holds each source's share give or
    take a row. ``size`` is the UTF-8 length plus 1, a null text counts as
    empty, a null source is a source of its own, ``slot`` runs from 0 without
    gaps in every shard. Repeated rows are interchangeable; their places are
    decided by id, digest and size.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("z")).alias("stratum"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("draw"),
        ).withColumn("slice", F.substring("draw", 1, 3)),
        "shards-rows",
    )
    order = ["draw", "doc_id", "text_crc32", "size"]
    spread = ranked(rows, ["stratum"], ["slice"], order).withColumn("part", (F.col("_rank") + 0.5) / F.col("_total"))
    spread = stage(
        spread.select(
            "doc_id", "size", "text_crc32", "stratum", "draw", "part", F.floor(F.col("part") * PIECES).alias("piece"), F.lit(0).alias("all")
        ),
        "shards-spread",
    )
    placed = ranked(spread, ["all"], ["piece"], ["part", "stratum", *order])
    shard = F.expr(f"_rank * {count} DIV _total")
    first = F.expr(f"(shard * _total + {count - 1}) DIV {count}")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
