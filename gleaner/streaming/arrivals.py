"""File arrival as a stream: each version of a file is ingested once.

Spark's file source remembers paths only, so a file written again under its own path would never be seen.
Here a run first lists the files and appends every (path, modification time, length) that is not
in the arrival log yet; the log is a folder of Parquet files that only grows, and the stream reads the
log. A version is in the log once, the stream's checkpoint says which parts of the log are done, and a
batch that is replayed after a failure finds its files in the manifest.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.numbering import number_rows
from gleaner.plans.tables import ingest_listing
from gleaner.session import stage
from gleaner.sources import files
from gleaner.sources.tables import Warehouse

_VERSION = "path string, modificationTime timestamp, length bigint"
REPORTS = "ingest_reports"


def _listed(spark: SparkSession, pattern: str) -> DataFrame:
    """Files that match now. The content is never selected, so nothing of it is read."""
    try:
        return spark.read.format("binaryFile").load(pattern).select("path", "modificationTime", "length")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _VERSION)


def log_arrivals(spark: SparkSession, pattern: str, log: str, max_files: int = 1000) -> int:
    """Append the versions of files matching ``pattern`` that ``log`` does not hold yet; returns their number.

    Older versions come first, ``max_files`` of them to a part of the log. Parts are written one after another, since
    the stream takes them by their age; what a run that fails has not logged is fresh to the next one. A version is told by
    path, modification time and length: a file written twice within the clock's tick to the same length is one version.
    """
    known = spark.createDataFrame([], _VERSION)
    folder = spark._jvm.org.apache.hadoop.fs.Path(log)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        known = spark.read.schema(_VERSION).parquet(log)
    fresh = stage(_listed(spark, pattern).join(known, ["path", "modificationTime", "length"], "left_anti"), "arrived")
    count = fresh.count()
    if count > max_files:
        fresh = stage(number_rows(fresh, [], ["modificationTime", "path"], "number"), "arrived")
    for first in range(0, count, max_files):
        part = fresh.where(F.col("number").between(first, first + max_files - 1)).drop("number") if count > max_files else fresh
        part.coalesce(1).write.mode("append").parquet(log)  # ``max_files`` names
    return count


def ingest_arrivals(
    warehouse: Warehouse, pattern: str, checkpoint: str, max_files: int = 1000, report: str = REPORTS
) -> StreamingQuery:
    """Ingest the versions of files matching ``pattern`` that arrived since the last run, files written over included.

    Every micro-batch is one part of the log and goes through the same manifest as the batch job. The
    per-file report is written under ``report``, one folder per batch. Files without content are left out, as
    Spark's readers do; a file that is gone when its turn comes is reported as one that cannot be read.
    """
    spark = warehouse.spark
    log = f"{checkpoint}/arrivals"
    log_arrivals(spark, pattern, log, max_files)
    folder = spark._jvm.org.apache.hadoop.fs.Path(log)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)  # the stream wants it even where nothing arrived yet
    arriving = spark.readStream.schema(_VERSION).option("maxFilesPerTrigger", 1).parquet(log)
    named = files.describe(arriving.select("path", "modificationTime")).where(F.col("kind") == "table")

    def land(batch: DataFrame, batch_id: int) -> None:
        # Of two versions of one path only the file as it is now can be read.
        now = batch.groupBy(*[c for c in batch.columns if c != "modificationTime"]).agg(F.max("modificationTime").alias("modificationTime"))
        now = stage(now, "landing")
        hashed = now.join(files.stream_hashes(now), "path")
        result = ingest_listing(warehouse, hashed)
        out = f"{warehouse.root}/_{report}/batch={batch_id}"
        result.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(out)

    return (
        named.writeStream.foreachBatch(land)
        .option("checkpointLocation", f"{checkpoint}/stream")
        .trigger(availableNow=True)
        .start()
    )


def arrival_reports(warehouse: Warehouse, report: str = REPORTS) -> DataFrame:
    """All reports written so far."""
    return warehouse.spark.read.parquet(f"{warehouse.root}/_{report}")
