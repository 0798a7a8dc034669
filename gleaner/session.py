"""Session settings and the shared work area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.parquet.filterPushdown": "true",
}


def build(app: str = "gleaner", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def work_root(spark: SparkSession) -> str:
    """The shared folder for staged data.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the master is local (tests on one machine) a fresh temporary folder is
    taken and remembered in the same setting; elsewhere that is an error, since
    executors do not see each other's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder below the work root."""
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"


_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where an expensive step (Python chunking, a range of ranks) feeds more
    than one branch: the lineage is cut at files that outlive any executor, and
    each branch reads only the columns it needs. The shuffle files of the write
    go with it, since nothing reads them again.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        (df.write.option("compression", compression) if compression else df.write).parquet(path)
    finally:
        spark.conf.unset(_SHUFFLE_CLEANUP) if before is None else spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


# Rows and bytes handed to a Python function at once. Whole texts may be long, and a function holds several copies of a batch.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 256, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session in rows and bytes; smaller settings of the user stay."""
    for key, most in BATCH_LIMITS.items():
        now = spark.conf.get(key)
        size = 0 if now.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now)
        if not 0 < size <= most:
            spark.conf.set(key, str(most))


SPREAD_TASKS = 64


def spread(df: DataFrame) -> DataFrame:
    """Give a scan enough tasks for heavy per-row work.

    A file that cannot be split (one row group, one compressed stream) is one
    task however many cores wait. Such a scan is dealt out once before costly
    expressions or Python; a scan that already has as many splits as useful is
    returned as it is, so a large table is never shuffled for this. ``df`` is a
    plain scan: its split count is known from planning, nothing runs.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, SPREAD_TASKS)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
