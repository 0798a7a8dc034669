"""Names of typed SQL, against the sqlite3 module of the standard library."""

from __future__ import annotations

import sqlite3
import time

import pytest

from gleaner.plans.names import respelled
from gleaner.plans.sql import run_sql, try_sql

MOMENTS = ["2024-01-31", "2024-02-29 23:59:59", "2023-12-31 12:00", "1969-07-20 20:17:40", "2000-01-01T00:00:00", "12:34", "2460310.5", None, "no date", "2024-02-30x"]
MODIFIERS = [(), ("+1 day",), ("-1 month",), ("+1 month", "start of month"), ("start of year", "+90 minutes"), ("weekday 0",), ("weekday 3", "-7 days"), ("+1.5 hours",), ("-2 years", "+10 seconds"), ("start of day",)]


def both(spark, statement, spelled=None):
    own = sqlite3.connect(":memory:").execute(spelled or statement).fetchall()
    got = [tuple(r) for r in run_sql(spark, statement, None).collect()]
    return got, own


@pytest.mark.parametrize("call", ["date({})", "time({})", "datetime({})", "julianday({})", "unixepoch({})", "strftime('%Y-%m-%d %H:%M:%S %j %w %W %s %%', {})"])
def test_dates(spark, call):
    rows = ", ".join("(CAST(NULL AS STRING))" if x is None else f"('{x}')" for x in MOMENTS)
    # One-argument date() and time() stay Spark's.
    used = [m or (("+0 days",) if call in ("date({})", "time({})") else ()) for m in MODIFIERS]
    calls = ", ".join(call.format(", ".join(["x", *(f"'{m}'" for m in more)])) + f" AS c{i}" for i, more in enumerate(used))
    got, own = both(spark, f"SELECT {calls} FROM (VALUES {rows}) AS t(x)", f"SELECT {calls} FROM (SELECT column1 AS x FROM (VALUES {rows.replace('STRING', 'TEXT')}))")
    for x, a, b in zip(MOMENTS, got, own):
        assert [round(v, 6) if isinstance(v, float) else v for v in a] == [round(v, 6) if isinstance(v, float) else v for v in b], x


def test_literals(spark):
    got, own = both(spark, "SELECT date('2024-01-31', '+1 month') AS a, strftime('%d.%m.', '2024-02-29', 'start of month') AS b")
    assert got == own and run_sql(spark, "SELECT date('now', '+0 days') AS a", None).collect()[0][0] >= "2024"


def test_seconds_as_moments(spark):
    got, own = both(spark, "SELECT datetime('1700000000', 'unixepoch') AS a, date('1700000000', 'unixepoch', '+1 month') AS b, datetime('-5', 'unixepoch') AS c")
    assert got == own


@pytest.mark.parametrize("pattern", ["*", "a*", "?b", "[ab]c*", "[^ab]*", "a.c", "a|b", "(x)", "a+", "a$", "^a", "*\n*", "", "[a-c][0-9]"])
def test_glob(spark, pattern):
    texts = ["", "a", "ab", "abc", "ac", "bc", "cc", "a.c", "a|b", "(x)", "a+", "aa", "a$", "^a", "x\ny", "b7", "A"]
    rows = ", ".join(f"('{t}')" for t in texts)
    got, own = both(spark, f"SELECT x, glob('{pattern}', x) AS g FROM (VALUES {rows}) AS t(x)", f"SELECT column1, glob('{pattern}', column1) FROM (VALUES {rows})")
    assert sorted(got) == sorted((x, bool(g)) for x, g in own)


def test_aggregates(spark):
    rows = "(1, 'a', 1.5), (1, 'b', NULL), (2, 'c', 2.0), (2, NULL, 0.5), (3, NULL, NULL)"
    statement = "SELECT k, total(v) AS t, group_concat(x) AS g, group_concat(x, '-') AS h, iif(total(v) > 1, 'much', 'little') AS i, max(k, 2) AS m, min(k, NULL) AS n FROM {} GROUP BY k ORDER BY k"
    got, own = both(spark, statement.format(f"(VALUES {rows}) AS t(k, x, v)"), statement.format(f"(SELECT column1 AS k, column2 AS x, column3 AS v FROM (VALUES {rows}))"))
    assert [r[:2] + (set((r[2] or "").split(",")),) + r[4:] for r in got] == [r[:2] + (set((r[2] or "").split(",")),) + r[4:] for r in own]
    empty = run_sql(spark, "SELECT total(id) AS t, group_concat(id) AS g, count(*) AS n FROM range(0)", None).collect()
    assert [tuple(r) for r in empty] == [(0.0, None, 0)]
    running = run_sql(spark, "SELECT id, total(id) OVER (ORDER BY id) AS t, total(id) OVER (PARTITION BY id % 2) AS u FROM range(4)", None).collect()
    assert sorted(tuple(r) for r in running) == [(0, 0.0, 2.0), (1, 1.0, 4.0), (2, 3.0, 2.0), (3, 6.0, 4.0)]


def test_json(spark):
    text = '{"a": 1, "b": "x y", "c": [1, {"d": null}], "e": null, "f": true, "g": 1.5, "h": {}}'
    got, own = both(spark, f"SELECT key, type FROM json_each('{text}')")
    assert sorted(got) == sorted(own)
    got, own = both(spark, "SELECT key, value, type FROM json_each('[10, \"x\", false, [2]]')")
    assert sorted((k, v if t != "false" else None, t) for k, v, t in got) == sorted((str(k), str(v) if t != "false" else None, t) for k, v, t in own)
    got, own = both(spark, f"SELECT json_extract('{text}', '$.b') AS x, json_type('{text}') AS t, json_valid('{{') AS v, json_valid('1 2') AS w, json_valid('[1]') AS u")
    assert got == [(own[0][0], own[0][1], bool(own[0][2]), bool(own[0][3]), bool(own[0][4]))]
    assert run_sql(spark, "SELECT json_group_array(id) AS j FROM range(1)", None).collect()[0][0] == "[0]"


def test_only_calls_are_spelled_anew():
    for same in ["SELECT 'total(x)' AS \"group_concat(y)\" FROM t", "SELECT a -- total(x)\nFROM t /* iif(a, b, c) */", "SELECT max(x), min(x), date(x), time(x), total FROM t",
                 "SELECT DATE '2024-01-01'", "SELECT subtotal(x)", "SELECT total(x", "SELECT `iif(`", "SELECT 'it''s total(x)'"]:
        assert respelled(same) == same
    assert respelled("SELECT iif(a > max(b, 1), 'x, (', iif(c, 1, 2))") == "SELECT if(a > if((b) IS NULL OR (1) IS NULL, NULL, greatest(b, 1)), 'x, (', if(c, 1, 2))"
    assert respelled("SELECT Total (DISTINCT x) FILTER (WHERE y) OVER (PARTITION BY z)") == "SELECT coalesce(sum(DISTINCT CAST(x AS DOUBLE)) FILTER (WHERE y) OVER (PARTITION BY z), 0.0D)"


def test_errors_at_run_time_are_text(spark):
    for statement in ("SELECT CAST('a' AS INT)", "SELECT 1 / 0", "SELECT nothing", "DELETE FROM x", "SELECT json_type('{')"):
        assert str(try_sql(spark, statement)).startswith("SQL error: ")
    rows = try_sql(spark, "SELECT id, CAST(NULL AS STRING) AS s, ARRAY(id) AS a FROM range(100) ORDER BY id")
    assert rows.count() == 50 and rows.columns == ["id", "s", "a"] and rows.first()["a"] == [0]
    assert try_sql(spark, "SELECT 1 AS x WHERE 1 > 2").count() == 0


def test_an_endless_statement_is_ended(spark):
    began = time.time()
    told = try_sql(spark, "SELECT count(*) FROM range(100000000000) a CROSS JOIN range(1000) b WHERE (a.id * 31 + b.id) % 1000003 = 7", seconds=3)
    assert told == "SQL error: ended after 3 seconds" and time.time() - began < 60
    assert try_sql(spark, "SELECT 1 AS x").collect()[0]["x"] == 1
