from __future__ import annotations

import json
from collections import defaultdict

import pytest

from gleaner.llm import chat, queries
from helpers import SMALL

TOOLS = {"add": {"properties": {"a": {"type": "integer"}, "b": {"type": "number"}}, "required": ["a", "b"], "additionalProperties": False}}


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def brute(rows, schemas):
    """Events conversation by conversation, in plain loops."""
    talks = defaultdict(list)
    for number, (conv, turn, role, text) in enumerate(rows):
        for pos, (kind, cid, refs, problem, line) in enumerate(chat.events_of(role, text, schemas)):
            turn_key = chat.LAST if turn is None else turn
            talks[conv].append({"conv": conv, "own": turn, "turn": turn_key, "pos": pos, "kind": kind, "id": cid, "refs": refs, "problem": problem, "json": line, "n": number})
    out = []
    for events in talks.values():
        calls, results = {}, {}
        for e in sorted(events, key=lambda e: (e["turn"], e["pos"], e["n"])):
            if e["id"]:
                {"call": calls, "result": results}[e["kind"]].setdefault(e["id"], e)
        place = {}

        def put(cid, path=()):
            if cid in place or cid in path:
                return place.get(cid)
            e = calls[cid]
            t, d = e["turn"], 0
            for r in e["refs"]:
                if r in calls:
                    got = put(r, (*path, cid))
                    if got is None:
                        return None
                    t, d = max(t, got[0], results[r]["turn"] if r in results else -1), max(d, got[1] + 2)
            place[cid] = (t, d)
            return place[cid]

        for cid in calls:
            put(cid)
        for e in events:
            e["t"], e["d"], e["linked"] = e["turn"], 0, None if e["kind"] == "message" else False
            if e["kind"] == "call" and calls.get(e["id"]) is e:
                e["linked"] = e["id"] in results
                e["t"], e["d"] = place.get(e["id"], (e["turn"], 0))
                if not e["problem"]:
                    if any(r not in calls for r in e["refs"]):
                        e["problem"] = "reference to no call"
                    elif e["id"] not in place:
                        e["problem"] = "circle of references"
            if e["kind"] == "result" and results.get(e["id"]) is e and e["id"] in calls:
                t, d = place.get(e["id"], (calls[e["id"]]["turn"], 0))
                e["t"], e["d"], e["linked"] = max(e["turn"], t), d + 1, True
        events.sort(key=lambda e: (e["t"], e["d"], e["turn"], e["pos"], e["n"]))
        out += [(e["conv"], i, e["own"], e["kind"], e["id"], e["linked"], e["problem"], e["json"]) for i, e in enumerate(events)]
    return sorted(out, key=repr)


def answer(df):
    assert df.columns == ["conv_id", "position", "turn", "kind", "call_id", "linked", "problem", "json"]
    return sorted([tuple(r) for r in df.collect()], key=repr)


ROWS = [
    (1, 0, "user", "Hi\n\"you\""), (1, 1, "assistant", call(("x", "add", {"b": 1.5, "a": 1}), ("y", "add", {"a": {"$ref": "x"}, "b": 2}), content="Wait")),
    (1, 2, "tool", result("y", "3")), (1, 5, "tool", result("x", [1, {"b": 1, "a": 2}])), (1, 6, "assistant", "Done"), (1, 7, "tool", result("x", "again")),
    (2, 0, "assistant", call(("p", "add", {"a": {"$ref": "q"}, "b": 1}), ("q", "add", {"a": {"$ref": "p"}, "b": 1}), ("r", "add", {"a": {"$ref": "none"}, "b": 1}))),
    (2, 1, "assistant", call(("s", "sub", {}), ("t", "add", {"a": True, "b": 1}), ("u", "add", {"a": 1}), ("v", "add", {"a": 1, "b": 2, "c": 3}), ("w", "add", "no"))),
    (3, 0, "tool", "{not json"), (3, None, "tool", result("lost", "z")), (3, 1, None, None), (None, 0, "user", ""), (None, 1, "assistant", '{"a": 1}'),
    (4, 3, "assistant", call(("late", "add", '{"a": 1, "b": 2}'))), (4, 1, "tool", result("late", "3")), (4, 2, "user", "é" * 50_000),
]


def test_against_plain_loops(spark):
    frame = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    assert answer(chat.format_chats(frame, TOOLS)) == brute(ROWS, TOOLS)


def test_given_conversations(spark):
    chats = queries.tool_traffic(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    rows = [tuple(r) for r in chats.collect()]
    got = answer(queries.op7_chat(spark, SMALL))
    assert got == brute(rows, queries.TOOLS)
    problems = {r[6] for r in got}
    assert {None, "unknown tool", "missing words"} <= problems and any(r[5] is False for r in got)


def test_derived_calls_hold_whole_texts(spark):
    texts = {turn: f'{turn} "quoted" \\ \t\n\u0001 \u00e9\u6f22 ' + "word " * 200 + f"end {turn}" for turn in range(1, 60, 2)}
    frame = spark.createDataFrame([(1, turn, "assistant", text) for turn, text in texts.items()], "conv_id long, turn int, role string, text string")
    asked = [json.loads(r["text"]) for r in queries.tool_traffic(frame).collect() if r["text"].startswith('{"tool_calls"')]
    calls = [c for a in asked for c in a["tool_calls"] if c["name"] != "count"]
    assert calls and all(c["arguments"]["text"] == texts[int(c["id"].split("-")[1])] for c in calls)
    lines = [r["json"] for r in chat.format_chats(queries.tool_traffic(frame), queries.TOOLS).collect()]
    for c in calls:
        assert sum(chat.canonical(texts[int(c["id"].split("-")[1])]) in line for line in lines) >= 2  # the call and the turn itself


def test_extra_columns_and_empty(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a", 9)], "conv_id long, turn long, role string, text string, event int")
    assert answer(chat.format_chats(frame, TOOLS)) == brute([(1, 0, "user", "a")], TOOLS)
    assert chat.format_chats(frame.limit(0), TOOLS).count() == 0


def test_odd_json_ends_no_job(spark):
    half = '{"tool_calls":[{"id":"\\ud800","name":"add","arguments":{"a":1,"b":2,"\\udc00":"\\ud83d"}}]}'
    rows = [(1, 0, "assistant", half), (1, 1, "tool", '{"tool_call_id":"\\ud800","content":"\\udfff \\ud83d\\ude00"}')]
    rows += [(2, i, "assistant", '{"tool_calls":[{"id":"n","name":"add","arguments":{"a":1,"b":%s}}]}' % v) for i, v in enumerate(["NaN", "Infinity", "-1e400", "1e300"])]
    rows += [(3, 0, "assistant", '{"tool_calls":' + "[" * 100_000), (3, 1, "assistant", '{"tool_calls":[7, null, {"id": 5}]}')]
    got = answer(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOLS))
    assert got == brute(rows, TOOLS)
    own = {(r[0], r[2]): r for r in got}
    assert own[1, 0][4:7] == ("\\ud800", True, "unknown \\udc00")
    assert own[1, 1][7] == '{"content":"\\udfff \U0001f600","id":"\\ud800","role":"tool","type":"result"}'
    assert json.loads(own[1, 0][7])["arguments"]["\udc00"] == "\ud83d"
    assert [own[2, i][3] for i in range(4)] == ["message"] * 3 + ["call"]
    for r in got:
        json.loads(r[7], parse_constant=lambda name: pytest.fail(name))


NESTED = {
    "go": {
        "type": "object", "required": ["where"], "additionalProperties": False,
        "properties": {
            "mode": {"enum": ["slow", 1, None]},
            "where": {"type": "object", "required": ["x"], "properties": {"x": {"type": ["number", "null"]}, "tags": {"type": "array", "items": {"type": "string"}}}},
        },
    }
}


@pytest.mark.parametrize("arguments, problem", [
    ({"where": {"x": 1}}, None), ({"where": {"x": None, "more": 1}}, None), ({"where": {}}, "missing where.x"), ({"where": {"x": "1"}}, "type of where.x"),
    ({"where": {"x": 1, "tags": ["a", 2]}}, "type of where.tags[1]"), ({"where": [], "mode": 1}, "type of where"), ({"where": {"x": 1}, "mode": True}, "value of mode"),
    ({"where": {"x": 1}, "mode": 1.0}, None), ({"where": {"$ref": "c"}, "mode": "slow"}, None), ({"other": 1, "where": {"x": 1}}, "unknown other"), ({}, "missing where"),
])
def test_schemas_at_any_depth(arguments, problem):
    assert chat.problem_of("go", arguments, NESTED) == problem


def test_schemas_that_cannot_be_checked_are_refused(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    for schema in ({"properties": {"a": {"pattern": "x"}}}, {"properties": {"a": {"type": "date"}}}, {"properties": {"a": {"items": {"minimum": 1}}}}, {"additionalProperties": {"type": "string"}}):
        with pytest.raises(ValueError, match="cannot check"):
            chat.format_chats(frame, {"t": schema})


def test_long_conversation_and_chains(spark):
    """One conversation holds nearly all turns; references make chains of several links, placed from results that come late."""
    rows = [(1, i, "user", f"turn {i}") for i in range(3000)] + [(2, 0, "user", "b")]
    rows += [(1, 100 + i, "assistant", call((f"c{i}", "add", {"a": {"$ref": f"c{i + 1}"} if i < 6 else 1, "b": {"$ref": "c6"} if i % 2 == 0 and i < 6 else 1}))) for i in range(7)]
    rows += [(1, 2000 - 7 * i, "tool", result(f"c{i}", i)) for i in range(7)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = answer(chat.format_chats(frame, TOOLS))
    assert got == brute(rows, TOOLS)
    at = {(r[3], r[4]): r[1] for r in got if r[4]}
    assert all(at["result", f"c{i + 1}"] < at["call", f"c{i}"] < at["result", f"c{i}"] for i in range(6))
