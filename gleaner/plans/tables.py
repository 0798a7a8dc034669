"""Incremental ingest of CSV files into named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schemas as S
from gleaner.operators.upsert import upsert
from gleaner.session import stage
from gleaner.sources import files
from gleaner.sources.tables import Warehouse

MANIFEST_TABLE = "meta_ingest"

REPORT = "file string, table_name string, status string, rows bigint, error string, file_hash string"


def manifest_status(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (``file, table_name, file_hash``) against the manifest by base name."""
    known = manifest.select(
        F.col("file_path").alias("file"), F.col("file_hash").alias("_old_hash"), F.col("row_count").alias("_old_rows")
    )
    status = (
        F.when(F.col("_old_hash").isNull(), S.STATUS_NEW)
        .when(F.col("_old_hash") == F.col("file_hash"), S.STATUS_SAME)
        .otherwise(S.STATUS_CHANGED)
    )
    return listing.join(known, "file", "left").withColumn("status", status)


def table_owners(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """The one file that may own each table name: a known file before a new one,
    then the smallest name. Any other file of that table name is a collision."""
    known = manifest.select("table_name", F.col("file_path").alias("file"), F.lit(0).alias("_new"))
    seen = listing.select("table_name", "file", F.lit(1).alias("_new")).unionByName(known)
    return seen.groupBy("table_name").agg(F.min_by("file", F.struct("_new", "file")).alias("owner"))


def upsert_manifest(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert or update by file name; the latest write wins."""
    return upsert(manifest, rows, ["file_path"], ["updated_at", "file_hash"])


def _load_all(warehouse: Warehouse, wanted: list) -> list[tuple]:
    """Replace the tables of the files; a failure is a report row, not an end."""
    spark, done = warehouse.spark, []
    named = {files.plain_path(r["path"]): r for r in wanted if r["ext"] == ".csv" and r["file_hash"] is not None}

    def result(row, rows: int, error: str | None) -> None:
        done.append((row["file"], row["table_name"], "Failed" if error else row["status"], rows, error, row["file_hash"]))

    for row in wanted:
        if row["ext"] != ".csv":
            result(row, 0, f"Unsupported file type: {row['ext']}")
        elif row["file_hash"] is None:
            result(row, 0, "cannot be read")
    groups, errors = files.read_groups(spark, [r["path"] for r in named.values()])
    for path, error in errors.items():
        result(named[path], 0, error)
    for group in groups:
        filled = {path: named[path]["table_name"] for path, n in group.counts.items() if n}
        try:
            if filled:
                owners = spark.createDataFrame(list(filled.items()), "_path string, _table string")
                whole = group.rows.join(F.broadcast(owners), "_path").drop("_path", "_row")
                warehouse.replace_many(whole, "_table", list(filled.values()))
            for path in group.counts:
                if path not in filled:
                    warehouse.replace(named[path]["table_name"], group.rows.drop("_path", "_row").limit(0))
                result(named[path], group.counts[path], None)
        except Exception as problem:  # noqa: BLE001
            message = str(problem).splitlines()[0] if str(problem) else type(problem).__name__
            known = {r[0] for r in done}
            for path in group.counts:
                if named[path]["file"] not in known:
                    result(named[path], 0, message)
    return done


def ingest_listing(warehouse: Warehouse, listing: DataFrame) -> DataFrame:
    """Ingest the changed files of a listing (``path, file, ext, table_name, file_hash``).

    Unchanged files are never parsed. The driver holds names of changed files
    only; headers, types and tables are jobs over many files at once. Of files
    that share a base name the newest is taken and the others are reported.
    """
    spark = warehouse.spark
    manifest = stage(warehouse.read(MANIFEST_TABLE, S.MANIFEST), "manifest")
    listing = stage(listing, "listing")
    newest = listing.groupBy("file").agg(
        F.max_by(F.struct("path", "ext", "table_name", "file_hash"), F.struct("modificationTime", "path")).alias("_f")
    )
    candidates = newest.select("file", "_f.path", "_f.ext", "_f.table_name", "_f.file_hash")
    owners = table_owners(candidates, manifest)
    judged = manifest_status(candidates, manifest).join(owners, "table_name", "left")
    status = F.when(F.col("owner") != F.col("file"), F.lit("Name collision")).otherwise(F.col("status"))
    judged = stage(judged.withColumn("status", status), "judged")

    changed = judged.where(F.col("status").isin(S.STATUS_NEW, S.STATUS_CHANGED))
    loaded = _load_all(warehouse, changed.select("path", "file", "ext", "table_name", "status", "file_hash").collect())
    done = spark.createDataFrame(loaded, REPORT)

    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = done.where("error IS NULL").select(
        F.col("file").alias("file_path"), "table_name", "file_hash", F.col("rows").alias("row_count"),
        now.alias("updated_at"),
    )
    if any(row[4] is None for row in loaded):
        warehouse.replace(MANIFEST_TABLE, upsert_manifest(manifest, rows))
    skipped = judged.where(~F.col("status").isin(S.STATUS_NEW, S.STATUS_CHANGED)).select(
        "file",
        "table_name",
        "status",
        F.coalesce("_old_rows", F.lit(0)).cast("bigint").alias("rows"),
        F.when(F.col("status") == "Name collision", F.concat(F.lit("table name taken by "), "owner")).alias("error"),
        "file_hash",
    )
    older = listing.join(candidates.select("file", F.col("path").alias("_newest")), "file").where("path <> _newest").select(
        "file", "table_name", F.lit("Name collision").alias("status"), F.lit(0).cast("bigint").alias("rows"),
        F.concat(F.lit("same file name as "), "_newest").alias("error"), "file_hash",
    )
    return done.unionByName(skipped).unionByName(older)


def ingest_folder(warehouse: Warehouse, root: str) -> DataFrame:
    """Ingest every table file below ``root``; returns the per-file report."""
    spark: SparkSession = warehouse.spark
    listed = files.list_files(spark, root).where(F.col("kind") == "table")
    hashed = files.hash_files(spark, root)
    return ingest_listing(warehouse, listed.join(hashed, "path", "left"))


def load_folder(warehouse: Warehouse, root: str) -> list[str]:
    """Plain variant: every CSV below ``root`` replaces its table, no manifest; of equal table names the last path stays."""
    from gleaner.functions.text import table_name_plain

    listed = files.list_files(warehouse.spark, root).where(F.col("ext") == ".csv").withColumn("_table", table_name_plain("path"))
    last = listed.groupBy("_table").agg(F.max("path").alias("path")).select(
        "path", F.col("_table").alias("file"), F.lit(".csv").alias("ext"), F.col("_table").alias("table_name"),
        F.lit("").alias("status"), F.lit("").alias("file_hash"),
    )
    for _, table, _, _, error, _ in _load_all(warehouse, last.collect()):
        if error:
            raise files.Unreadable(f"{table}: {error}")
    return warehouse.tables()
