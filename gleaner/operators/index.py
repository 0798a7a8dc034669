"""What the files of a chunk table hold, kept beside them: which ids, and counts per source.

Every data file is described once, by the first call that needs it after the
write. A description counts only while its file is listed, and a listed file
without one is described before anything is answered, so a write that breaks off
at any point (of the table or of the index) and a table written by other means
never leave a wrong answer behind. Descriptions of files that were replaced are
passed over; once they outnumber the files, the index is made anew.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.sizes import broadcast_if_small

FILE = ["collection", "bucket", "file"]
IDS_PER_WORD = 4  # between 2 and 4 ids share 64 bits, as words are a power of two
BITS = 4

TABLES = {
    "files": "collection string, bucket int, file string, run string, words bigint",
    "sources": "collection string, bucket int, file string, run string, source string, chunks bigint, first string, rows bigint",
    "ids": "collection string, bucket int, file string, run string, words bigint, word bigint, bits bigint",
}


def words_for(rows: Column) -> Column:
    """Words of the filter of ``rows`` ids, a power of two."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(rows / IDS_PER_WORD, F.lit(1.0))))).cast("bigint")


def word_of(id_: str, words: str) -> Column:
    return F.xxhash64(id_).bitwiseAND(F.col(words) - 1)


def bits_of(id_: str) -> Column:
    """The bits of an id in its word, four at most."""
    drawn, one = F.xxhash64(id_, F.lit(1)), F.lit(1).cast("bigint")
    bits = None
    for i in range(BITS):
        place = F.shiftrightunsigned(drawn, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bit = F.call_function("shiftleft", one, place)
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return bits


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def listing(chunks: DataFrame) -> set[tuple]:
    """``(collection, bucket, file)`` of the files that ``chunks`` reads: the names Spark has listed, nothing of them is read."""
    found = (name.rsplit("/", 3)[1:] for name in chunks.inputFiles())
    # The address is escaped once, the value in a folder's name once more.
    return {(unquote(unquote(c)).partition("=")[2], int(b.partition("=")[2]), f) for c, b, f in found}


class ChunkIndex:
    """Id filters and counts of the files of the chunk table at ``path``.

    A filter is a blocked Bloom filter as rows: an id sets up to four bits of one
    64-bit word of its file. Asking is an equality join on the word.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self.root = f"{path}/_index"

    def _kept(self, table: str) -> DataFrame:
        folder = f"{self.root}/{table}"
        if not exists(self.spark, folder):
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(folder)

    def _append(self, table: str, rows: DataFrame) -> None:
        names = [field.split()[0] for field in TABLES[table].split(", ")]
        rows.select(*names).write.mode("append").parquet(f"{self.root}/{table}")

    def forget(self) -> None:
        """Drop all descriptions; the next call makes them anew."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def current(self, chunks: DataFrame) -> dict[tuple, tuple]:
        """``(run, words)`` of every listed file, describing those that are new.

        ``chunks`` reads the table. Only names pass the driver, which lists them
        for any scan. Of a file described twice (two callers at once) one run counts.
        """
        listed = listing(chunks)
        runs = self._runs()
        missing = sorted(listed - runs.keys())
        if missing:
            if len(runs.keys() - listed) > len(listed):
                self.forget()
                runs, missing = {}, sorted(listed)
            runs |= self._describe(chunks, missing)
        return {file: runs[file] for file in listed}

    def _runs(self) -> dict[tuple, tuple]:
        runs: dict[tuple, tuple] = {}
        for row in self._kept("files").select(*FILE, "run", "words").collect():
            file, one = tuple(row[:3]), tuple(row[3:])
            runs[file] = min(one, runs.get(file, one))
        return runs

    def _frame(self, described: dict[tuple, tuple]) -> DataFrame:
        rows = [(*file, *one) for file, one in described.items()]
        return broadcast_if_small(self.spark.createDataFrame(rows, "collection string, bucket int, file string, run string, words bigint"))

    def _describe(self, chunks: DataFrame, files: list[tuple]) -> dict[tuple, tuple]:
        run = uuid.uuid4().hex
        named = of_files(chunks, files).select("collection", "bucket", F.col("_metadata.file_name").alias("file"), "id", "source", "rows")
        numbered = F.when(F.col("rows").isNotNull(), F.col("id"))
        asked = self._frame({file: (run, 1) for file in files}).drop("words")
        counts = named.join(asked, FILE).groupBy(*FILE, "run", "source").agg(
            F.count(F.lit(1)).alias("chunks"), F.min(numbered).alias("first"), F.min_by("rows", numbered).alias("rows")
        )
        self._append("sources", counts)
        totals = self._kept("sources").where(F.col("run") == run).groupBy(*FILE).agg(words_for(F.sum("chunks")).alias("words")).collect()
        # A file without rows has a description too.
        described = dict.fromkeys(files, (run, 1)) | {tuple(t[:3]): (run, t[3]) for t in totals}
        now = self._frame(described)
        words = named.join(now, FILE).select(*FILE, "run", "words", word_of("id", "words").alias("word"), bits_of("id").alias("bits"))
        words = words.groupBy(*FILE, "run", "words", "word").agg(F.bit_or("bits").alias("bits"))
        # In the order of the words, so that few ids need few row groups.
        self._append("ids", words.sortWithinPartitions("collection", "words", "word"))
        # Last: a run counts from here on.
        self._append("files", now)
        return described

    def sources(self, chunks: DataFrame) -> DataFrame:
        """``collection, source, n, r``: chunks of every source and the rows that its first chunk with a number names."""
        now = self._frame(self.current(chunks))
        kept = self._kept("sources").join(now, [*FILE, "run"], "left_semi")
        return kept.groupBy("collection", "source").agg(F.sum("chunks").alias("n"), F.min_by("rows", "first").alias("r"))

    def holding(self, chunks: DataFrame, wanted: DataFrame) -> list[tuple]:
        """Names ``(collection, bucket, file)`` of the files that may hold an id of ``wanted`` (``collection, id``).

        No file that holds one is left out; of the others about one in two
        hundred is named for each id.
        """
        now = self.current(chunks)
        sizes = sorted({words for _, words in now.values()})  # powers of two
        if not sizes:
            return []
        probes = wanted.select("collection", "id", F.explode(F.array(*[F.lit(s).cast("bigint") for s in sizes])).alias("words"))
        probes = probes.select("collection", "words", word_of("id", "words").alias("word"), bits_of("id").alias("need")).distinct()
        hit = self._kept("ids").join(probes, ["collection", "words", "word"]).where(F.col("bits").bitwiseAND(F.col("need")) == F.col("need"))
        found = [tuple(r) for r in hit.select(*FILE, "run").distinct().collect()]
        return sorted(f[:3] for f in found if f[:3] in now and now[f[:3]][0] == f[3])


def of_files(chunks: DataFrame, files: list[tuple]) -> DataFrame:
    """``chunks`` cut to files by their names: partitions and files are left out by the scan itself.

    Rows of a file with a listed name in another listed partition may come along.
    """
    inside = F.lit(False)
    for name in sorted({f[0] for f in files}):
        inside = inside | ((F.col("collection") == name) & F.col("bucket").isin(*sorted({f[1] for f in files if f[0] == name})))
    return chunks.where(inside & F.col("_metadata.file_name").isin(*sorted({f[2] for f in files})) if files else F.lit(False))

