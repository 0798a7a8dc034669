"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import stage

#: Rows handed to a Python worker at once. Whole texts may be long, so batches are kept short.
BATCH_ROWS = 256

#: Rows of a counted table that may be broadcast; its rows are a few numbers wide, 32 MB at most.
BROADCAST_ROWS = 500_000

#: Columns of ``documents``.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def short_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session; a smaller setting of the user stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a narrow table whose ``rows`` have been counted and are few; else a shuffled join decides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def mark(text: str = "text"):
    """With ``doc_id`` it names a row: rows equal in both hold the same text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def boxed(docs: DataFrame, *more) -> DataFrame:
    """``row, id, own`` and ``more``: the rows of ``docs`` as one struct beside their id and mark, so that names of theirs clash with none of an operator's."""
    return docs.select(F.struct(*[_column(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), mark().alias("own"), *more)


def unboxed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` of the struct ``row`` again."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def _column(name: str):
    return F.col("`" + name.replace("`", "``") + "`").alias(name)


def word_count(text: str = "text"):
    """Number of runs free of blanks and ASCII line or tab characters; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def stored(df: DataFrame, label: str) -> DataFrame:
    """As :func:`gleaner.session.stage`, in a denser format for tables that hold texts."""
    return stage(df, label, compression="zstd")


def discard(*tables: DataFrame) -> None:
    """Remove stored tables whose successors have been written, so that they hold no space while an operator goes on."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
