"""Broadcast hints behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def _weight(df: DataFrame):
    """About the bytes of a row."""
    total = F.lit(8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            total += F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array<") and kind[6:-1] in ("double", "float", "int", "bigint"):
            total += 8 * F.coalesce(F.size(name), F.lit(0))
        elif kind.startswith(("array<", "map<", "struct<")):
            total += F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    return F.sum(total.cast("bigint"))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint where ``df`` is counted to be small in rows and bytes, a plain side otherwise."""
    got = df.limit(max_rows + 1).agg(F.count("*").alias("rows"), _weight(df).alias("bytes")).first()
    return F.broadcast(df) if got["rows"] <= max_rows and (got["bytes"] or 0) <= max_bytes else df
