"""Connected components of a table of links, without gathering it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import stage


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """Every node's neighbours hang on to the smallest node around it: the larger ones, or (``small``) the others and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.filter("b < a") if small else both
    least = stage(around.groupBy("a").agg(F.min("b").alias("least")), "least")  # stored, so that the join can split a heavy node
    joined = around.join(least, "a").withColumn("least", F.least("a", "least"))
    moved = joined.filter("b > a" if not small else "b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    if small:
        moved = moved.unionByName(least.select("a", F.col("least").alias("b")))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node of ``links`` (``a``, ``b``, longs) that is not its own root.

    Alternating large and small stars; each round is written to the shared
    folder, and the table never grows beyond the number of links. It ends when
    a round changes nothing, then every node hangs on its root.
    """
    links = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        links = stage(_stars(stage(_stars(links, False), "stars"), True), "links")
