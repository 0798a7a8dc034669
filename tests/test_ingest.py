from __future__ import annotations

import hashlib
import os
from pathlib import Path

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleaner import schemas as S
from gleaner.operators import upsert
from gleaner.plans import tables
from gleaner.sources import files
from gleaner.sources.tables import Warehouse
from gleaner.streaming import arrivals
from gleaner.streaming.arrivals import arrival_reports, ingest_arrivals


def write(folder: Path, name: str, text: str) -> Path:
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path


def report(df):
    return {r["file"]: (r["status"], r["rows"]) for r in df.collect()}


def test_csv_types_and_names(spark, tmp_path):
    path = write(
        tmp_path,
        "a.csv",
        'n,gap,f,b,d,s,n,,empty\n1,1,1.5,True,2024-01-05,"x, ""y""",7,u,\n-2,NA,2e3,false,2024-01-06,null,8,v,N/A\n3,3,inf,TRUE,2024-01-07,n/a,9,w,NaN\n',
    )
    df = files.read_csv(spark, str(path))
    assert dict(df.dtypes) == {
        "n": "bigint", "gap": "bigint", "f": "double", "b": "boolean", "d": "string", "s": "string", "n.1": "bigint",
        "Unnamed: 7": "string", "empty": "double",
    }
    rows = [tuple(r) for r in df.collect()]
    assert rows[0] == (1, 1, 1.5, True, "2024-01-05", 'x, "y"', 7, "u", None)
    assert rows[1][1] is None and rows[1][2] == 2000.0 and rows[1][5] is None


def test_csv_header_only_and_quoted_newline(spark, tmp_path):
    empty = files.read_csv(spark, str(write(tmp_path, "h.csv", "a,b\n")))
    assert empty.columns == ["a", "b"] and empty.count() == 0
    quoted = files.read_csv(spark, str(write(tmp_path, "q.csv", 'a,b\n"x\ny",1\n')))
    assert [tuple(r) for r in quoted.collect()] == [("x\ny", 1)]


def test_big_integers_fall_back_to_double(spark, tmp_path):
    df = files.read_csv(spark, str(write(tmp_path, "b.csv", "a\n99999999999999999999\n1\n")))
    assert df.dtypes == [("a", "double")]


def test_wide_rows_are_refused_and_short_ones_filled(spark, tmp_path):
    with pytest.raises(files.Unreadable):
        files.read_csv(spark, str(write(tmp_path, "w.csv", "a,b\n1,2\n3,4,5\n")))
    short = files.read_csv(spark, str(write(tmp_path, "s.csv", "a,b\n1\n3,4\n")))
    assert sorted(map(str, short.collect())) == sorted(["Row(a=1, b=None)", "Row(a=3, b=4)"])


def test_odd_files_are_all_reported(spark, tmp_path):
    up = tmp_path / "up load"
    warehouse = Warehouse(spark, str(tmp_path / "db"))
    write(up, "2023/sales.csv", "a,b\n1,x\n")
    write(up, "2024/sales.csv", "a,b\n1,x\n2,y\n")
    write(up, "with blank.csv", 'a,b\n1,"x\ny"\n2,"z"\n')
    write(up, "wide.csv", "a,b\n3,4,5\n")
    write(up, "none.csv", "")
    write(up, "h%20+.csv", "k\n7\n")
    got = sorted((r["file"], r["status"], r["rows"]) for r in tables.ingest_folder(warehouse, str(up)).collect())
    assert len(got) == 6 and [g for g in got if g[0] != "sales.csv"] == [
        ("h%20+.csv", S.STATUS_NEW, 1), ("none.csv", "Failed", 0), ("wide.csv", "Failed", 0), ("with blank.csv", S.STATUS_NEW, 2),
    ]
    assert sorted(g[1] for g in got if g[0] == "sales.csv") == ["Name collision", S.STATUS_NEW]
    assert sorted(tuple(r) for r in warehouse.read("with_blank").collect()) == [(1, "x\ny"), (2, "z")]
    for limit in (0, 10**9):
        hashed = {r["path"].split("/")[-1]: r["file_hash"] for r in files.hash_files(spark, str(up), limit).collect()}
        assert hashed["with blank.csv"] == hashlib.sha256((up / "with blank.csv").read_bytes()).hexdigest()
        assert hashed["none.csv"] == hashlib.sha256(b"").hexdigest()


def test_a_chunk_missing_inside_a_page_is_seen(spark, monkeypatch):
    read = upsert.ChunkTable.read

    def one_less(self, *a, **b):
        rows = read(self, *a, **b)
        place = rows.groupBy("page").agg(F.count("*").alias("n"), F.min("chunk_no").alias("lo")).orderBy(F.desc("n"), "page").head()
        if place is None:  # before the write
            return rows
        lost.append(place["page"])
        return rows.where((F.col("page") != place["page"]) | (F.col("chunk_no") != place["lo"] + place["n"] // 2))

    lost = []
    monkeypatch.setattr(upsert.ChunkTable, "read", one_less)
    got = entry.queries()["stored_paged_docs"](spark, SMALL).where("page IS NOT NULL").select("page", "covers").collect()
    assert {r["page"] for r in got if not r["covers"]} == {lost[-1]} and len(got) > 1


def test_hashes(spark, tmp_path):
    body = b"k,v\n1,2\n" * 1000
    (tmp_path / "x.csv").write_bytes(body)
    want = hashlib.sha256(body).hexdigest()
    for limit in (0, 10**9):
        assert [r["file_hash"] for r in files.hash_files(spark, str(tmp_path), limit).collect()] == [want]


def test_a_store_only_spark_reads_gives_hashes_for_any_size(spark, tmp_path):
    up = tmp_path / "in"
    write(up, "small one.csv", "k\n1\n")
    write(up, "large.csv", "k,v\n" + "1,2\n" * 1000)
    want = {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in up.iterdir()}
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.hashes.link./in", f"file://{up}")
    for limit in (0, 100, 10**9):
        assert {r["path"].split("/")[-1]: r["file_hash"] for r in files.hash_files(spark, "viewfs://hashes/in", limit).collect()} == want
    warehouse = Warehouse(spark, str(tmp_path / "db"))
    ingest_arrivals(warehouse, "viewfs://hashes/in/*.csv", str(tmp_path / "mark")).awaitTermination()
    assert report(arrival_reports(warehouse)) == {"small one.csv": (S.STATUS_NEW, 1), "large.csv": (S.STATUS_NEW, 1000)}
    gone = spark.createDataFrame([("viewfs://hashes/in/gone.csv",), (f"file:{up}/gone.csv",)], "path string")
    assert [r["file_hash"] for r in files.stream_hashes(gone).collect()] == [None, None]


def test_incremental_folder(spark, tmp_path):
    up = tmp_path / "up"
    warehouse = Warehouse(spark, str(tmp_path / "db"))
    write(up, "One Table.csv", "a,b\n1,x\n2,y\n")
    write(up, "deep/two.csv", "c\n1\n")
    write(up, "bad.csv", "\n")
    write(up, "sheet.xlsx", "not decoded")
    write(up, "note.txt", "ignored")
    first = report(tables.ingest_folder(warehouse, str(up)))
    assert first == {
        "One Table.csv": (S.STATUS_NEW, 2), "two.csv": (S.STATUS_NEW, 1), "bad.csv": ("Failed", 0), "sheet.xlsx": ("Failed", 0),
    }
    assert warehouse.tables() == ["meta_ingest", "one_table", "two"]
    before = warehouse.location("two")
    write(up, "One Table.csv", "a,b\n1,x\n2,y\n3,z\n")
    second = report(tables.ingest_folder(warehouse, str(up)))
    assert second["One Table.csv"] == (S.STATUS_CHANGED, 3) and second["two.csv"] == (S.STATUS_SAME, 1)
    assert warehouse.location("two") == before
    assert warehouse.read("one_table").count() == 3
    manifest = {r["file_path"]: r["row_count"] for r in warehouse.read(tables.MANIFEST_TABLE).collect()}
    assert manifest == {"One Table.csv": 3, "two.csv": 1}
    warehouse.register()
    assert spark.sql("SELECT sum(a) AS s FROM one_table").head()["s"] == 6


def test_name_collision_is_reported(spark, tmp_path):
    up = tmp_path / "up"
    warehouse = Warehouse(spark, str(tmp_path / "db"))
    write(up, "a b.csv", "x\n1\n")
    write(up, "a-b.csv", "x\n2\n")
    got = report(tables.ingest_folder(warehouse, str(up)))
    assert got == {"a b.csv": (S.STATUS_NEW, 1), "a-b.csv": ("Name collision", 0)}
    assert report(tables.ingest_folder(warehouse, str(up)))["a b.csv"] == (S.STATUS_SAME, 1)


def test_stream_runs_once_per_arrival(spark, tmp_path):
    up = tmp_path / "up"
    warehouse = Warehouse(spark, str(tmp_path / "db"))
    pattern, checkpoint = str(up / "*" / "*.csv"), str(tmp_path / "cp")

    def run():
        ingest_arrivals(warehouse, pattern, checkpoint).awaitTermination()
        return sorted((r["batch_id"], r["file"], r["status"]) for r in arrival_reports(warehouse).collect())

    write(up, "v1/t.csv", "a\n1\n")
    assert run() == [(0, "t.csv", S.STATUS_NEW)]
    assert len(run()) == 1
    write(up, "v2/t.csv", "a\n1\n2\n")
    write(up, "v2/u.csv", "a\n1\n")
    assert run()[1:] == [(1, "t.csv", S.STATUS_CHANGED), (1, "u.csv", S.STATUS_NEW)]
    assert warehouse.read("t").count() == 2


def test_a_file_written_over_is_ingested_again(spark, tmp_path):
    up = tmp_path / "up"
    warehouse = Warehouse(spark, str(tmp_path / "db"))
    pattern, checkpoint = str(up / "*.csv"), str(tmp_path / "cp")

    def run(**options):
        ingest_arrivals(warehouse, pattern, checkpoint, **options).awaitTermination()
        path = f"{warehouse.root}/_ingest_reports"
        return sorted((r["batch_id"], r["file"], r["status"], r["rows"]) for r in arrival_reports(warehouse).collect()) if os.path.exists(path) else []

    assert run() == []  # nothing matches yet
    write(up, "t.csv", "a\n1\n")
    write(up, "u.csv", "a\n1\n")
    first = [(0, "t.csv", S.STATUS_NEW, 1), (0, "u.csv", S.STATUS_NEW, 1)]
    assert run() == first
    write(up, "t.csv", "a\n1\n2\n")
    os.utime(up / "u.csv", (1, 1))  # the same content, another time
    assert run() == [*first, (1, "t.csv", S.STATUS_CHANGED, 2), (1, "u.csv", S.STATUS_SAME, 1)]
    assert warehouse.read("t").count() == 2 and len(run()) == 4
    for i in range(5):
        os.utime(write(up, f"m{i}.csv", f"k\n{i}\n"), (100 + i, 100 + i))
    assert [r[:2] for r in run(max_files=2)[4:]] == [(2, "m0.csv"), (2, "m1.csv"), (3, "m2.csv"), (3, "m3.csv"), (4, "m4.csv")]


def test_a_replayed_batch_ingests_nothing_twice(spark, tmp_path, monkeypatch):
    up = tmp_path / "up"
    warehouse = Warehouse(spark, str(tmp_path / "db"))
    pattern, checkpoint = str(up / "*.csv"), str(tmp_path / "cp")
    write(up, "t.csv", "a\n1\n")
    plain = arrivals.ingest_listing

    def broken(*args):
        plain(*args).collect()
        raise RuntimeError("lost after the tables were written")

    monkeypatch.setattr(arrivals, "ingest_listing", broken)
    with pytest.raises(Exception, match="lost after"):
        ingest_arrivals(warehouse, pattern, checkpoint).awaitTermination()
    monkeypatch.setattr(arrivals, "ingest_listing", plain)
    before = warehouse.location("t")
    write(up, "late.csv", "a\n1\n")
    ingest_arrivals(warehouse, pattern, checkpoint).awaitTermination()
    got = sorted((r["batch_id"], r["file"], r["status"]) for r in arrival_reports(warehouse).collect())
    assert got == [(0, "t.csv", S.STATUS_SAME), (1, "late.csv", S.STATUS_NEW)] and warehouse.location("t") == before


def test_requested_paths_fall_back_to_base_name(spark, tmp_path):
    listing = spark.createDataFrame([("/in/a.pdf",), ("/in/b.pdf",), ("/other/b.pdf",)], "path string")
    asked = spark.createDataFrame([("/in/a.pdf",), ("/gone/b.pdf",), ("/gone/c.pdf",)], "path string")
    got = {r["path"]: r["found"] for r in files.requested_paths(asked, listing).collect()}
    assert got == {"/in/a.pdf": "/in/a.pdf", "/gone/b.pdf": "/in/b.pdf", "/gone/c.pdf": None}


def test_table_files_to_chunks(spark, tmp_path):
    import pandas as pd

    from gleaner.functions.splitter import split_text
    from gleaner.functions.text import base_name, extension
    from gleaner.operators.upsert import ChunkTable
    from gleaner.plans.chunking import ingest_table_files

    body = "k,name\n" + "".join(f"{i},row {i * 37 % 101}\n" for i in range(400, 0, -1))
    paths = [str(write(tmp_path, "t.csv", body)), str(write(tmp_path, "h.csv", "a,b\n")), str(write(tmp_path, "x.xlsx", "?")), None]
    listing = spark.createDataFrame([(p, f"f{i}" if p is None else p) for i, p in enumerate(paths)], "path string, name string")
    listing = listing.select("path", base_name("name").alias("file"), extension("name").alias("ext"))
    store = ChunkTable(spark, str(tmp_path / "store"), buckets=2)
    got = {r["name"]: (r["rows"], r["chunks"]) for r in ingest_table_files(store, listing).collect()}
    want = [c for _, c in split_text(pd.read_csv(paths[0]).to_csv(index=False))]
    assert got == {"t.csv": (400, len(want)), "h.csv": (0, 0), "x.xlsx": (0, 0), "f3": (0, 0)}
    assert [r["document"] for r in store.read().orderBy("chunk_no").collect()] == want
