"""Text to vector.

The vector model is the caller's: an embedder is any function
``(df, text_column, output_column) -> df``. Two are provided: md5 feature
hashing as plain column expressions, and a join to vectors computed elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[DataFrame, str, str], DataFrame]

DIMENSIONS = 64


def token_buckets(text: Column, dim: int) -> Column:
    """Bucket number of every whitespace-separated, lowercased token."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \t\n\r\f]+"), lambda t: t != "")
    # The number of the first eight digits decides; where the width divides 256, its last two do.
    first, digits = (7, 2) if 256 % dim == 0 else (1, 8)
    return F.transform(
        tokens, lambda t: F.pmod(F.conv(F.substring(F.md5(t), first, digits), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain nested expression is recomputed inside every lambda that mentions
    it, and optimizer rewrites merge staged projections back into such a form.
    """
    return F.transform(F.array(value), body)[0]


def bucket_counts(buckets: Column, dim: int) -> Column:
    """How often each of the ``dim`` buckets occurs.

    Many buckets are sorted once, one of each slot added, and the places where the
    slots end are subtracted; few are counted slot by slot.
    """
    slots = F.array(*[F.lit(i) for i in range(dim)])

    def ends(b: Column) -> Column:
        last = F.transform(b, lambda x, i: F.when(F.get(b, i + 1) == x, F.lit(-1)).otherwise(i + 1))
        return F.array_remove(last, -1)

    def sorted_counts(b: Column) -> Column:
        return let(let(F.sort_array(F.concat(b, slots)), ends), lambda e: F.transform(e, lambda x, i: x - F.coalesce(F.get(e, i - 1), F.lit(0)) - 1))

    def slot_counts(b: Column) -> Column:
        return F.transform(slots, lambda i: F.size(b) - F.size(F.array_remove(b, i)))

    return let(buckets, lambda b: F.when(F.size(b) > dim, sorted_counts(b)).otherwise(slot_counts(b)))


def unit_vector(counts: Column) -> Column:
    """Counts scaled to length one; all zeros stay zeros."""

    def scaled(c: Column) -> Column:
        squares = F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        return let(
            F.sqrt(squares),
            lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)).cast("float")),
        )

    return let(counts, scaled)


def hash_embedder(dim: int = DIMENSIONS) -> Embedder:
    """Unit-length token-count vectors by md5 feature hashing."""

    def embed(df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, unit_vector(bucket_counts(token_buckets(F.col(text), dim), dim)))

    return embed


def precomputed(vectors: DataFrame, text: str = "text", vector: str = "embedding") -> Embedder:
    """Look vectors up by text hash in a table of (text, vector)."""
    table = vectors.select(F.sha2(F.col(text), 256).alias("_key"), F.col(vector).alias("_vector")).dropDuplicates(
        ["_key"]
    )

    def embed(df: DataFrame, text_col: str, out: str) -> DataFrame:
        keyed = df.drop(out).withColumn("_key", F.sha2(F.col(text_col), 256))
        return keyed.join(table, "_key", "left").drop("_key").withColumnRenamed("_vector", out)

    return embed
