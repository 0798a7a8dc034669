"""Versioned Parquet tables with a pointer, and the catalog over them.

A table is replaced by writing a complete new version and then switching a
one-line pointer file. Readers see the old version or the new one, whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINTER = "_current"
# Start of the names of folders that hold versions of several tables.
BATCHES = "batch-"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


class Warehouse:
    """Named tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _pointer(self, table: str) -> str:
        return f"{self.root}/{table}/{POINTER}"

    def exists(self, table: str) -> bool:
        files, target = _file_system(self.spark, self._pointer(table))
        return files.exists(target)

    def location(self, table: str) -> str:
        """Folder of the current version."""
        files, target = _file_system(self.spark, self._pointer(table))
        stream = files.open(target)
        try:
            version = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        version = version.strip()
        return f"{self.root}/{version}" if version.startswith(BATCHES) else f"{self.root}/{table}/{version}"

    def replace(self, table: str, df: DataFrame) -> None:
        """Write a new version of ``table`` and switch to it."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{table}/{version}")
        self._switch(table, version)

    def replace_many(self, rows: DataFrame, name: str, tables: list[str]) -> None:
        """New versions of many tables of one schema in one job; column ``name`` tells whose a row is."""
        batch = f"{BATCHES}{uuid.uuid4().hex}"
        rows.write.partitionBy(name).parquet(f"{self.root}/{batch}")
        for table in tables:
            self._switch(table, f"{batch}/{name}={table}")

    def _switch(self, table: str, version: str) -> None:
        """Write the pointer aside and rename it over the old one, in one step of the file system."""
        files, target = _file_system(self.spark, self._pointer(table))
        fresh = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._pointer(table)}-{uuid.uuid4().hex}")
        stream = files.create(fresh, True)
        try:
            stream.write(bytearray(version, "utf-8"))
        finally:
            stream.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else files.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        context.rename(files.makeQualified(fresh), files.makeQualified(target), options)

    def read(self, table: str, schema: T.StructType | None = None) -> DataFrame:
        """Current version; with a schema, an absent table reads as empty."""
        if schema is not None and not self.exists(table):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(self.location(table))

    def tables(self) -> list[str]:
        """Names of the tables, sorted."""
        files, target = _file_system(self.spark, self.root)
        if not files.exists(target):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(target) if s.isDirectory())
        return [n for n in names if self.exists(n)]

    def register(self) -> list[str]:
        """Make every table a temporary view."""
        names = self.tables()
        for name in names:
            self.read(name).createOrReplaceTempView(name)
        return names


def catalog_names(spark: SparkSession) -> DataFrame:
    """Registered tables and views, internal ones left out."""
    names = [(t.name,) for t in spark.catalog.listTables() if not t.name.startswith("sqlite_")]
    return spark.createDataFrame(sorted(names), "table_name string")


def has_tables(spark: SparkSession) -> bool:
    return any(not t.name.startswith("sqlite_") for t in spark.catalog.listTables())
