"""Ordered numbering and neighbours that survive one dominant key.

A plain window over ``key`` sorts all rows of a key in one task. Here the rows are
cut by sampled ranges of the order columns, equally many to a range whatever
their values are; a window runs per (key, range), the totals of the ranges get
their own running sum (as many rows per key as there are ranges), and the two are
joined. Neither a key with a third of all rows nor no key at all ever puts more
than a range into one task. The result depends on values only, never on where the
ranges happen to be cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import stage


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with the number of their range, stored so that every later step sees the same cuts."""
    return stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def _equal(left: DataFrame, right: DataFrame, keys: list[str]):
    """Null-safe equality of the keys."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[f"_k_{key}"])
    return condition


def _keyed(df: DataFrame, keys: list[str], *rest) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *rest)


def prefix_sum(df: DataFrame, keys: list[str], order: str | list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows of the same key.

    ``order`` names columns that are unique per key.
    """
    order = [order] if isinstance(order, str) else order
    rows = _ranged(df, order)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    starts = _keyed(starts, [*keys, "_range"], "_start")
    summed = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = summed.join(starts, _equal(summed, starts, [*keys, "_range"]))
    return joined.select(*df.columns, (F.col("_start") + F.col("_inside")).cast("bigint").alias(out))


def number_rows(df: DataFrame, keys: list[str], order: str | list[str], out: str) -> DataFrame:
    """Add ``out``: 0-based position of the row among its key's rows by ``order``."""
    return prefix_sum(df.withColumn("_one", F.lit(1)), keys, order, "_one", out).drop("_one")


def next_row(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Add ``next_<column>``: values of the following row of the same key.

    Inside a range this is a window; the last row of a range looks up the
    first row of the key's next range, a side that is cut to one row per key and
    range before its exchange.
    """
    rows = _ranged(df, [order])
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    heads = rows.groupBy(*keys, "_range").agg(F.min_by(F.struct(*columns), order).alias("_head"))
    after = F.lead("_head").over(Window.partitionBy(*keys).orderBy("_range"))
    heads = _keyed(heads.withColumn("_after", after), [*keys, "_range"], "_after")
    ahead = rows.select(
        "*",
        F.lead(F.lit(True)).over(inside).alias("_more"),
        *[F.lead(c).over(inside).alias(f"_next_{c}") for c in columns],
    )
    joined = ahead.join(heads, _equal(ahead, heads, [*keys, "_range"]))
    return joined.select(
        *df.columns,
        *[F.when(F.col("_more"), F.col(f"_next_{c}")).otherwise(F.col("_after")[c]).alias(f"next_{c}") for c in columns],
    )
