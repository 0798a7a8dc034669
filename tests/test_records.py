from __future__ import annotations

import csv
import io
import random

import pytest

from gleaner.sources import files, records


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def table(rows: int, seed: int, end: str = "\n") -> tuple[bytes, list[tuple]]:
    draw = random.Random(seed)
    words = ["plain", 'say "x"', "a,b", "one\ntwo", "\n", '"', '"\n",\n', "", "é\n\n中", "x" * 3000 + "\n" + "y" * 500, "tail\n"]
    out = [(i, draw.choice(words), draw.choice(words)) for i in range(rows)]
    text = io.StringIO()
    csv.writer(text, lineterminator=end).writerows([("id", "a\nb", "c"), *out])
    return text.getvalue().encode(), out


@pytest.mark.parametrize("line", [b'"a"', b'x"y', b'"a,b', b'x,"', b'"a"b,"c', b'"""', b'""""', b'"a""', b',"",""",', b""])
def test_state_of_a_line(line):
    # Character by character.
    def slowly(inside):
        start, i = not inside, 0
        while i < len(line):
            c = line[i : i + 1]
            if inside:
                if c == b'"':
                    if line[i + 1 : i + 2] == b'"':
                        i += 1
                    else:
                        inside = False
            elif c == b'"' and start:
                inside = True
            start = not inside and c == b","
            i += 1
        return inside

    assert records.ends_open(line, False) == slowly(False)
    assert records.ends_open(line, True) == slowly(True)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_over_many_ranges(spark, small_ranges, tmp_path, end):
    body, want = table(150, 5, end)
    (tmp_path / "t.csv").write_bytes(b"\xef\xbb\xbf" + body)
    frame = files.read_csv(spark, str(tmp_path / "t.csv"), row_column="at")
    assert frame.columns == ["at", "id", "a\nb", "c"] and dict(frame.dtypes)["id"] == "bigint"
    got = [tuple(r)[1:] for r in sorted(frame.collect(), key=lambda r: r["at"])]
    assert got == [(i, a or None, b or None) for i, a, b in want]


def test_ranges_do_not_change_the_rows(spark, tmp_path):
    body, want = table(200, 6)
    (tmp_path / "t.csv").write_bytes(body)
    whole = files.read_csv(spark, str(tmp_path / "t.csv")).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        cut = files.read_csv(spark, str(tmp_path / "t.csv")).collect()
        read = records.quoted_records(spark, [str(tmp_path / "t.csv")])
        assert read.select("start").distinct().count() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(tuple, cut)) == sorted(map(tuple, whole)) and len(whole) == len(want)


def test_many_files_of_one_header(spark, small_ranges, tmp_path):
    wanted = {}
    for name in ("one", "two", "empty"):
        body, want = table({"one": 90, "two": 30, "empty": 0}[name], len(name) * 7 + ord(name[0]))
        (tmp_path / f"{name}.csv").write_bytes(body)
        wanted[str(tmp_path / f"{name}.csv")] = want
    (tmp_path / "broken.csv").write_bytes(b'id,"a\nb",c\n1,"x\ny",z,too much\n')
    paths = [*wanted, str(tmp_path / "broken.csv")]
    groups, errors = files.read_groups(spark, paths)
    assert list(errors) == [str(tmp_path / "broken.csv")]
    got: dict[str, list] = {}
    for group in groups:
        assert group.names == ("id", "a\nb", "c")
        for path, n in group.counts.items():
            assert n == len(wanted[path])
            own = group.rows.where(group.rows["_path"] == path).collect()
            got[path] = [tuple(r)[:3] for r in sorted(own, key=lambda r: r["_row"])]
    assert got == {p: [(i, a or None, b or None) for i, a, b in w] for p, w in wanted.items()}


def test_odd_bytes_blank_lines_and_a_quote_left_open(spark, small_ranges, tmp_path):
    (tmp_path / "o.csv").write_bytes(b'\n\na,b\n"x\n1",\xff\n\ny,"never\nclosed,\n' + b"z" * 25_000 + b"\n")
    read = records.quoted_records(spark, [str(tmp_path / "o.csv")])
    got = [r["record"] for r in sorted(read.collect(), key=lambda r: (r["start"], r["n"]))]
    assert got == ["a,b", '"x\n1",�', 'y,"never\nclosed,\n' + "z" * 25_000 + "\n"]
    (tmp_path / "none.csv").write_bytes(b"")
    assert records.quoted_records(spark, [str(tmp_path / "none.csv")]).count() == 0
