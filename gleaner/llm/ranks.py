"""Exact row numbers within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, group: list[str], slices: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``_rank`` (from 0 in its ``group``) and ``_total`` (rows of the group).

    ``slices`` cut a group into pieces that follow one another in the order and
    are small enough for a task; ``order`` sorts within a piece. The pieces are
    counted with a map side, a running sum over the counts gives every piece its
    first number, and only a piece is ever sorted as one. ``rows`` is read twice
    and should be a stored table; ``group`` and ``slices`` must not be null.
    """
    keys = [*group, *slices]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    pieces = counts.select(
        *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(whole).alias("_total")
    )
    piece = Window.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumn("_at", F.row_number().over(piece) - 1)
    return numbered.join(pieces, keys).withColumn("_rank", F.col("_first") + F.col("_at")).drop("_first", "_at")
