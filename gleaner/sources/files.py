"""File listings, content hashes and typed CSV tables."""

from __future__ import annotations

import csv
import hashlib
import io
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import text as X
from gleaner.session import stage
from gleaner.sources.records import quoted_records

# --- Fixed values -----------------------------------------------------------
# Words a data frame library reads as missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# ----------------------------------------------------------------------------

# Larger files are hashed as a stream instead of as one value in memory.
WHOLE_FILE_BYTES = 64 << 20
_BLOCK = 1 << 20
# Files hashed at once where only Hadoop's file systems reach them.
_STREAMS = 8

_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"
_BOOLEAN = r"^(True|False|TRUE|FALSE|true|false)$"


def plain_path(path: str) -> str:
    """A path as it is compared: local ones without a scheme."""
    return re.sub(r"^file:/+", "/", path)


def _plain(column: Column) -> Column:
    """As :func:`plain_path`, for the escaped path that Spark gives with a row."""
    return F.regexp_replace(F.url_decode(F.replace(column, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``: path, length, base name, extension, table name.

    Spark's readers leave out files without content; those are added from the
    listing that the reader holds anyway.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = [(re.sub("^file:/+", "file:/", unquote(p)),) for p in sorted(found.inputFiles())]
    named = spark.createDataFrame(named, "path string")
    read = found.select("path", "length", "modificationTime")
    known = read.select(_slashes("path").alias("_known"))
    empty = named.join(known, _slashes("path") == F.col("_known"), "left_anti")
    empty = empty.select("path", F.lit(0).cast("bigint").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))
    return describe(read.unionByName(empty))


def _slashes(column: str) -> Column:
    return F.regexp_replace(column, "^file:/+", "/")


def describe(files: DataFrame) -> DataFrame:
    """Add the names and the kind a file listing is routed by."""
    return files.select(
        "*",
        X.base_name("path").alias("file"),
        X.extension("path").alias("ext"),
        X.file_kind("path", wide=True).alias("kind"),
        X.table_name("path").alias("table_name"),
    )


def _opened(path: str):
    """A byte stream of a local file, or of any file that Arrow's file systems reach."""
    if path.startswith("file:") or "://" not in path:
        return open(re.sub(r"^file:/+", "/", path), "rb")
    from pyarrow import fs

    # Hadoop's names of the scheme that Arrow knows as s3.
    system, where = fs.FileSystem.from_uri(quote(re.sub("^s3[an]://", "s3://", path), safe=":/@?=&%"))
    return system.open_input_stream(where)


def _stream_digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        digests = []
        for path in batch["path"]:
            digest = hashlib.sha256()
            try:
                with _opened(path) as stream:
                    while block := stream.read(_BLOCK):
                        digest.update(block)
                digests.append(digest.hexdigest())
            except Exception:  # noqa: BLE001  a file that Arrow does not reach is one row without a hash
                digests.append(None)
        yield batch.assign(file_hash=digests)


def _hadoop_hashes(spark: SparkSession, paths: list[str]) -> list[tuple[str, str | None]]:
    """Paths and SHA-256 through the file systems that Spark's readers use; each file is a stream in the driver's JVM."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def digest(path: str) -> tuple[str, str | None]:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            stream = where.getFileSystem(conf).open(where)
            try:
                return path, jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
            finally:
                stream.close()
        except Exception:  # noqa: BLE001  one unreadable file is one row without a hash
            return path, None

    with ThreadPoolExecutor(_STREAMS) as pool:
        return list(pool.map(digest, paths))


def stream_hashes(paths: DataFrame) -> DataFrame:
    """``path`` and SHA-256, each file read as a stream; NULL for a file that cannot be read.

    The size of a file never has to fit in memory. Tasks read through Arrow's
    file systems; what those do not reach, as a scheme they do not know, the
    driver reads through Hadoop's, so a file that Spark can read has a hash.
    """
    spark = paths.sparkSession
    spread = paths.select("path").repartition(spark.sparkContext.defaultParallelism * 4, "path")
    hashed = stage(spread.mapInPandas(_stream_digest, "path string, file_hash string"), "hashes")
    # Names only, and only of files that Arrow did not reach.
    missed = [r["path"] for r in hashed.where("file_hash IS NULL").collect()]
    if not missed:
        return hashed
    again = spark.createDataFrame(_hadoop_hashes(spark, missed), "path string, file_hash string")
    return hashed.where("file_hash IS NOT NULL").unionByName(again)


def hash_files(spark: SparkSession, root: str, limit: int = WHOLE_FILE_BYTES) -> DataFrame:
    """``path`` and SHA-256 of every file below ``root``.

    Small files are hashed in the JVM from their content, larger ones as a
    stream in the task they fall to.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = found.where(F.col("length") <= limit).select("path", F.sha2("content", 256).alias("file_hash"))
    large = found.where(F.col("length") > limit).select("path")
    nothing = F.lit(hashlib.sha256().hexdigest())
    empty = list_files(spark, root).where(F.col("length") == 0).select("path", nothing.alias("file_hash"))
    return small.unionByName(stream_hashes(large)).unionByName(empty)


def requested_paths(requested: DataFrame, listing: DataFrame) -> DataFrame:
    """Requested names with their listed path; the base name is tried second."""
    # min() makes one row per name, so a name listed often stays one match.
    by_path = listing.groupBy("path").agg(F.min("path").alias("_exact"))
    by_base = listing.groupBy(X.base_name("path").alias("_base")).agg(F.min("path").alias("_fallback"))
    return (
        requested.withColumn("_base", X.base_name("path"))
        .join(by_path, "path", "left")
        .join(by_base, "_base", "left")
        .withColumn("found", F.coalesce("_exact", "_fallback"))
        .drop("_base", "_exact", "_fallback")
    )


def _unique_names(header: list[str | None]) -> list[str]:
    """Column names of a header row: blanks named, repeats suffixed ``.1``, ``.2``."""
    out: list[str] = []
    repeats: dict[str, int] = {}
    for i, raw in enumerate(header):
        name = raw if raw else f"Unnamed: {i}"
        wanted = name
        while wanted in out:
            repeats[name] = repeats.get(name, 0) + 1
            wanted = f"{name}.{repeats[name]}"
        out.append(wanted)
    return out


def _cell(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


# Column for what stands beyond the header, and a word no cell holds: an empty cell is not an absent one.
_WIDE, _ABSENT = "_wide", "\x00\x00"


class Unreadable(ValueError):
    """The file is not a table."""


_OPTIONS = {"escape": '"', "mode": "PERMISSIVE", "nullValue": _ABSENT}


def _open_quotes() -> Column:
    """The line ends inside quotes, or leaves them."""
    return F.size(F.split("value", '"')) % 2 == 0


def survey(spark: SparkSession, paths: list[str]) -> dict[str, tuple[tuple[str, ...], bool]]:
    """Column names of each file and whether its quotes hold line breaks, for all files in one job; files without a line are left out."""
    lines = spark.read.text(paths).where("value <> ''")
    lines = lines.select("value", _plain(F.col("_metadata.file_path")).alias("path"), F.monotonically_increasing_id().alias("at"))
    # One row per file.
    seen = lines.groupBy("path").agg(F.min_by("value", "at").alias("header"), F.bool_or(_open_quotes()).alias("quoted")).collect()
    broken = {row["path"] for row in seen if row["header"].count('"') % 2}
    # A header with a line break is the first record, not the first line; one row per such file.
    whole = {}
    if broken:
        first = quoted_records(spark, sorted(broken)).where("header").select(_plain(F.col("path")).alias("path"), "record")
        whole = {r["path"]: r["record"] for r in first.collect()}
    out = {}
    for row in seen:
        header = whole[row["path"]] if row["path"] in broken else row["header"].lstrip("\ufeff")
        names = next(csv.reader(io.StringIO(header, newline="")))
        out[row["path"]] = (tuple(_unique_names(names)), row["quoted"])
    return out


def _text_rows(spark: SparkSession, paths: list[str], names: tuple[str, ...], multi_line: bool) -> DataFrame:
    """Rows of files with one header, every column as text and missing words as NULL; ``_wide``, ``_path`` and ``_row`` beside them.

    With ``multi_line`` the rows are cut by ranges and staged, so that they are read from the files once.
    """
    if multi_line:
        return _quoted_rows(spark, paths, names)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, _WIDE)])
    rows = spark.read.options(**_OPTIONS).option("header", True).option("enforceSchema", True).schema(schema).csv(paths)
    return rows.select(*_missing(names), _cell(_WIDE), _plain(F.col("_metadata.file_path")).alias("_path"), F.monotonically_increasing_id().alias("_row"))


def _missing(names: tuple[str, ...]) -> list[Column]:
    return [F.when(~_cell(n).isin(*MISSING), _cell(n)).alias(n) for n in names]


def _quoted_rows(spark: SparkSession, paths: list[str], names: tuple[str, ...]) -> DataFrame:
    """As :func:`_text_rows`, for files with line breaks inside quotes; ``_row`` rises in file order of one file only."""
    body = quoted_records(spark, paths).where(~F.col("header"))
    fields = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    cells = F.from_csv("record", fields, {**_OPTIONS, "multiLine": "true"})
    rows = body.select(cells.alias("_cells"), _plain(F.col("path")).alias("_path"), (F.col("start") + F.col("n")).alias("_row"))
    named = [F.col("_cells")[f"c{i}"].alias(n) for i, n in enumerate((*names, _WIDE))]
    return rows.select(*named, "_path", "_row").select(*_missing(names), _cell(_WIDE), "_path", "_row")


def _checks(names: tuple[str, ...]) -> list[Column]:
    out = [F.count(F.lit(1)).alias("rows"), F.count(_cell(_WIDE)).alias("wide")]
    for i, name in enumerate(names):
        cell = _cell(name)
        whole = F.trim(cell).try_cast("bigint").isNotNull()
        out += [
            F.count(cell).alias(f"n{i}"),
            # A missing cell decides nothing: integers with gaps stay integers.
            F.every(F.when(cell.isNotNull(), cell.rlike(_INTEGER) & whole)).alias(f"i{i}"),
            F.every(cell.rlike(_NUMBER) | cell.rlike(_INFINITE)).alias(f"d{i}"),
            F.every(cell.rlike(_BOOLEAN)).alias(f"b{i}"),
        ]
    return out


def _types(names: tuple[str, ...], seen) -> tuple[str, ...]:
    """Narrowest of bigint, double, boolean, string per column."""
    out = []
    for i in range(len(names)):
        if seen is None or seen[f"n{i}"] == 0:
            out.append("double")
        else:
            kinds = (("i", "bigint"), ("d", "double"), ("b", "boolean"))
            out.append(next((kind for letter, kind in kinds if seen[f"{letter}{i}"]), "string"))
    return tuple(out)


def _typed(rows: DataFrame, names: tuple[str, ...], types: tuple[str, ...]) -> list[Column]:
    out = []
    for name, kind in zip(names, types):
        cell = _cell(name)
        if kind in ("bigint", "double"):
            cell = F.trim(cell).try_cast(kind)
        elif kind == "boolean":
            cell = F.lower(cell) == "true"
        out.append(cell.alias(name))
    return out


def _wide_error(names: tuple[str, ...], n: int) -> str:
    return f"{n} rows have more than {len(names)} fields"


class Group:
    """Files with equal names and types: ``rows`` holds them all, with ``_path`` and ``_row``; ``counts`` their rows by path."""

    def __init__(self, rows: DataFrame, names: tuple[str, ...], counts: dict[str, int]):
        self.rows, self.names, self.counts = rows, names, counts


def read_groups(spark: SparkSession, paths: list[str]) -> tuple[list[Group], dict[str, str]]:
    """Typed tables of many files, and an error for each file that is none.

    One job looks at the headers of all files, one per distinct header at the
    types of its files; the number of jobs follows the schemas, not the files.
    """
    wanted = {plain_path(p): p for p in paths}
    known = survey(spark, paths) if paths else {}
    errors = {p: "no columns to parse from file" for p in wanted if p not in known}
    by_header: dict[tuple, list[str]] = {}
    for path, shape in known.items():
        by_header.setdefault(shape, []).append(path)
    groups = []
    for (names, quoted), own in sorted(by_header.items()):
        rows = _text_rows(spark, [wanted[p] for p in own], names, quoted)
        seen = {r["_path"]: r for r in rows.groupBy("_path").agg(*_checks(names)).collect()}
        by_types: dict[tuple, dict[str, int]] = {}
        for path in own:
            got = seen.get(path)
            if got is not None and got["wide"]:
                errors[path] = _wide_error(names, got["wide"])
            else:
                by_types.setdefault(_types(names, got), {})[path] = got["rows"] if got is not None else 0
        for types, counts in sorted(by_types.items()):
            # Staged records are not cut again.
            part = rows.where(F.col("_path").isin(*counts)) if quoted else _text_rows(spark, [wanted[p] for p in counts], names, quoted)
            groups.append(Group(part.select(*_typed(part, names, types), "_path", "_row"), names, counts))
    return groups, errors


def read_csv(
    spark: SparkSession, path: str, multi_line: bool | None = None, row_column: str | None = None
) -> DataFrame:
    """A CSV file, or a folder of files with one header, with inferred column types; dates stay text.

    Quoted line breaks are found by themselves unless ``multi_line`` says so; a
    row wider than the header is an error. ``row_column`` adds a number that
    rises in file order.
    """
    shapes = survey(spark, [path])
    if not shapes:
        raise Unreadable("no columns to parse from file")
    names = next(iter(shapes.values()))[0]
    quoted = any(q for _, q in shapes.values()) if multi_line is None else multi_line
    rows = _text_rows(spark, [path], names, quoted)
    seen = rows.agg(*_checks(names)).head()
    if seen["wide"]:
        raise Unreadable(_wide_error(names, seen["wide"]))
    place = [F.col("_row").alias(row_column)] if row_column else []
    return rows.select(*place, *_typed(rows, names, _types(names, seen)))
