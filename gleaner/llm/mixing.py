"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import boxed, mark, maybe_broadcast, unboxed, word_count
from gleaner.llm.ranks import ranked
from gleaner.session import stage

#: Weights of the sources in code-point order, repeating; times a source may be taken at most.
WEIGHTS, MOST = (1, 2, 3), 3


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``stratum, source_size, target`` from the stored table ``stratum, source_size`` (one row per source).

    Sources share the sum of all sizes by weight; a target stops at ``most``
    times its source's size and the excess goes to the others by weight. The
    common factor is found by a few aggregates over the sources, which are never
    gathered: sources are numbered by range partitions.
    """
    sorted_ = stage(sources.orderBy("stratum").withColumn("range", F.spark_partition_id()), "mix-sources")
    starts = sorted_.groupBy("range").agg(F.count("*").alias("n"))
    starts = starts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("stratum")) - 1 + F.col("before")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = stage(sorted_.join(starts, "range").select("stratum", "source_size", weight.cast("double").alias("weight")), "mix-weighed")
    factor, capped = None, -1
    while True:
        full = F.lit(False) if factor is None else F.col("source_size") * most <= F.col("weight") * factor
        got = weighed.select("source_size", "weight", full.alias("full")).agg(
            F.sum("source_size").alias("all"), F.count_if("full").alias("n"),
            F.sum(F.when(F.col("full"), F.col("source_size") * most).otherwise(0)).alias("held"),
            F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if got["n"] == capped or not got["open"]:
            break
        factor, capped = ((got["all"] or 0) - (got["held"] or 0)) / got["open"], got["n"]
    share = F.least(F.col("source_size") * float(most), F.col("weight") * float(factor or 0.0))
    return weighed.select("stratum", "source_size", share.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, mark`` for every row of ``docs`` (``doc_id``, ``text``, ``source``).

    ``size`` counts words of the text (null: 0). Every document of a source has
    the same expected copies, target / source size. Their prefix sums, in the
    order of size and a seeded digest, plus one random offset per source give a
    document one copy for each integer boundary crossed: the expected copies
    rounded down or up, and neighbours in size take turns, so a source's taken
    words stay within about one long document of its target. A null source is
    one source, last; an empty source has target 0. The same rows always give the
    same mix; repeated rows may take turns among themselves.
    """
    text_digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), word_count().alias("size"),
            F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("stratum"), text_digest.alias("draw"), mark().alias("mark"),
        ).withColumn("slice", F.substring("draw", 1, 1)),
        "mix-rows",
    )
    aims = targets(stage(rows.groupBy("stratum").agg(F.sum("size").alias("source_size")), "mix-sizes"), weights, most)
    placed = ranked(rows, ["stratum"], ["size", "slice"], ["draw", "doc_id", "mark"]).join(aims, "stratum")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("stratum")).cast("binary")), 1, 3), 16, 10).cast("double") / 4096 + 1 / 8192
    crossed = F.floor((F.col("_rank") + 1) * F.col("each") + F.col("offset")) - F.floor(F.col("_rank") * F.col("each") + F.col("offset"))
    return placed.withColumn("each", each).withColumn("offset", offset).withColumn("copies", crossed.cast("long")).select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"),
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "mark",
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as :func:`mix` takes it, columns unchanged whatever their names.

    Rows that repeat id and text are taken as often as all of them together.
    """
    taken = mix(docs, **options).groupBy("doc_id", "mark").agg(F.sum("copies").alias("all"), F.count("*").alias("rows"))
    taken = stage(taken.filter(F.col("all") > 0), "mix-taken")
    bound = maybe_broadcast(taken, taken.count())
    rows = boxed(docs)
    joined = rows.join(bound, rows["id"].eqNullSafe(bound["doc_id"]) & (rows["own"] == bound["mark"]))
    parts = [joined.filter("rows = 1").select("row", F.col("all").alias("times"))]
    if not taken.filter("rows > 1").isEmpty():
        turn = Window.partitionBy("id", "own").orderBy(*[F.col("row").getField(c) for c in ("source", "lang") if c in docs.columns] or ["own"])
        again = joined.filter("rows > 1").withColumn("turn", F.row_number().over(turn) - 1)
        parts.append(again.select("row", F.expr("`all` DIV `rows` + IF(turn < `all` % `rows`, 1, 0)").alias("times")))
    whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    copies = F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")
    return unboxed(whole.filter("times > 0").select("row", copies), docs.columns)
