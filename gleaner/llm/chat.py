"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

An assistant message may be a JSON object with ``tool_calls``, each ``{"id", "name",
"arguments"}``; a message of the role ``tool`` may be ``{"tool_call_id", "content"}``. An
argument ``{"$ref": id}`` stands for the result of another call of the conversation. Anything
else is a plain message. A message becomes one or more events; events of a conversation are
rows from end to end, so a conversation may be of any length.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import short_batches
from gleaner.operators.numbering import number_rows
from gleaner.session import stage

#: Place of a message without a turn: after all others.
LAST = 1 << 60

_TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}


#: What a schema may say; anything else is refused, not passed over.
_KEYWORDS = {"type", "enum", "properties", "required", "additionalProperties", "items", "title", "description", "default", "examples"}
_LONE = re.compile("[\ud800-\udfff]")


def plain(text: str) -> str:
    """``text`` with halves of surrogate pairs, which are no characters, as JSON escapes."""
    return _LONE.sub(lambda half: f"\\u{ord(half[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, no blanks and characters as they are; a lone surrogate stays the escape it was."""
    return plain(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def reference(value):
    """The call an argument refers to, if it does."""
    return value["$ref"] if isinstance(value, dict) and set(value) == {"$ref"} and isinstance(value["$ref"], str) else None


def check_schemas(schemas: dict) -> None:
    """Refuse schemas that say what :func:`problem_of` does not check."""
    for name, schema in schemas.items():
        for part in _parts(schema):
            more = set(part) - _KEYWORDS if isinstance(part, dict) else {repr(part)}
            types = [] if more or "type" not in part else part["type"] if isinstance(part["type"], list) else [part["type"]]
            if more or not set(types) <= set(_TYPES) or not isinstance(part.get("additionalProperties", True), bool):
                raise ValueError(f"schema of {name}: cannot check {sorted(more) or part}")


def _parts(schema) -> Iterator:
    yield schema
    if isinstance(schema, dict):
        for own in [*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else [])]:
            yield from _parts(own)


def _equal(a, b) -> bool:
    """Equality of JSON values: true is not 1."""
    return canonical(a) == canonical(b) or (_TYPES["number"](a) and _TYPES["number"](b) and a == b)


def _fault(value, schema: dict, path: str, refers: bool = False) -> str | None:
    """The first thing wrong with a value; ``path`` names it. ``refers``: its members may stand for results of other calls."""
    if "type" in schema:
        types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(_TYPES[t](value) for t in types):
            return f"type of {path}"
    if "enum" in schema and not any(_equal(value, own) for own in schema["enum"]):
        return f"value of {path}"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for key in sorted({*schema.get("required", []), *value}):
            own = f"{path}.{key}" if path else key
            if key not in value:
                return f"missing {own}"
            if key not in known:
                if not schema.get("additionalProperties", True):
                    return f"unknown {own}"
            elif not (refers and reference(value[key]) is not None):
                found = _fault(value[key], known[key], own)
                if found:
                    return found
    if isinstance(value, list) and "items" in schema:
        for number, own in enumerate(value):
            found = _fault(own, schema["items"], f"{path}[{number}]")
            if found:
                return found
    return None


def problem_of(name, arguments, schemas: dict) -> str | None:
    """What is wrong with a call: unknown tool, no object, a missing, unknown or mistyped argument or a value none of those listed; the first by name."""
    if name not in schemas:
        return "unknown tool"
    if not isinstance(arguments, dict):
        return "arguments are no object"
    found = _fault(arguments, {k: v for k, v in schemas[name].items() if k != "type"}, "", refers=True)
    return plain(found) if found else None


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError("a number beyond doubles")
    return value


def _no_number(text: str):
    raise ValueError(f"{text} is no JSON")


def _object(text: str | None) -> dict:
    """The JSON object a text is, or an empty one. ``NaN``, ``Infinity`` and numbers beyond doubles are no JSON."""
    if not text or not text.lstrip().startswith("{"):
        return {}
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_no_number)
    except (ValueError, RecursionError):
        return {}
    return value if isinstance(value, dict) else {}


def _name(value) -> str | None:
    return plain(value) if isinstance(value, str) and value else None


def events_of(role: str | None, text: str | None, schemas: dict) -> list[tuple]:
    """(kind, call id, references, problem, JSON) of the events of a message; kinds: message, call, result."""
    body = _object(text) if role in ("assistant", "tool") else {}
    calls = body.get("tool_calls")
    if role == "assistant" and isinstance(calls, list) and calls:
        out = []
        if body.get("content"):
            out.append(("message", None, [], None, canonical({"role": role, "content": body["content"]})))
        for call in calls:
            call = call if isinstance(call, dict) else {}
            name, arguments = _name(call.get("name")), call.get("arguments")
            if isinstance(arguments, str):
                arguments = _object(arguments) or arguments
            refs = sorted({plain(r) for r in map(reference, arguments.values()) if r}) if isinstance(arguments, dict) else []
            line = canonical({"role": role, "type": "call", "id": _name(call.get("id")), "name": name, "arguments": arguments})
            out.append(("call", _name(call.get("id")), refs, problem_of(name, arguments, schemas), line))
        return out
    if role == "tool" and _name(body.get("tool_call_id")):
        line = canonical({"role": role, "type": "result", "id": body["tool_call_id"], "content": body.get("content")})
        return [("result", _name(body["tool_call_id"]), [], None, line)]
    return [("message", None, [], None, canonical({"role": role, "content": text}))]


def _parsed(schemas: dict):
    names = ["conv_id", "turn", "pos", "kind", "call_id", "refs", "problem", "json"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")]):
                rows += [(conv, turn, pos, *event) for pos, event in enumerate(events_of(role, text, schemas))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, types)], names)

    return run


def _placed(calls: DataFrame, links: DataFrame) -> DataFrame:
    """``event, t, d`` of calls: the turn from which a call can stand, and its depth among equals.

    A round meets the calls placed in the last one with the references that are still open, and places the calls
    that have none left; there are as many rounds as the longest chain of references has links. Calls
    in a circle are never placed.
    """
    edges = calls.select("conv", "event", F.explode("refs").alias("ref")).join(
        links.select("conv", F.col("call_id").alias("ref"), F.col("call").alias("needed"), "result_turn"), ["conv", "ref"]
    )
    edges = stage(edges.select("event", "needed", "result_turn"), "chat-edges")
    waiting = edges.select("event").distinct()
    turns = calls.select("event", "turn")
    done = stage(turns.join(waiting, "event", "left_anti").select("event", F.col("turn").alias("t"), F.lit(0).alias("d")), "chat-placed")
    placed, fresh, told = done, done, None
    while not fresh.isEmpty():
        met = stage(edges.join(fresh.withColumnRenamed("event", "needed"), "needed", "left"), "chat-met")
        edges = met.filter("t IS NULL").select("event", "needed", "result_turn")
        new = met.filter("t IS NOT NULL").select("event", F.greatest("t", F.coalesce("result_turn", F.lit(-LAST))).alias("after"), F.col("d").alias("depth"))
        told = new if told is None else told.unionByName(new)
        # What is told of calls that still wait goes on as one row each.
        known = told.groupBy("event").agg(F.max("after").alias("after"), F.max("depth").alias("depth"))
        known = stage(known.join(edges.select("event").distinct().withColumn("open", F.lit(True)), "event", "left"), "chat-told")
        told = known.filter("open").drop("open")
        # A call stands after the result it refers to, and that result after its own call.
        ready = known.filter("open IS NULL").join(turns, "event")
        fresh = stage(ready.select("event", F.greatest("turn", "after").alias("t"), (F.col("depth") + 2).alias("d")), "chat-placed")
        placed = placed.unionByName(fresh)
    return placed


def format_chats(messages: DataFrame, schemas: dict) -> DataFrame:
    """``conv_id, position, turn, kind, call_id, linked, problem, json`` for every event of ``messages`` (``conv_id``, ``turn``, ``role``, ``text``).

    Calls and results meet by conversation and identifier; of several with one
    identifier the first by turn counts, the others and those without a
    counterpart are not ``linked`` (null for plain messages). ``position`` numbers a
    conversation's events from 0 so that a result follows its call and a call the results it
    refers to, otherwise in the order of turns. ``problem`` names what ``schemas`` (JSON
    schemas by tool: ``type``, ``enum``, ``properties``, ``required``, ``additionalProperties``, ``items``, at any
    depth; others are refused) finds wrong, or a reference to no call or in a circle. A null conversation is one
    conversation, a null turn comes last; repeated rows are events of their own. A text
    that is no JSON object (one with ``NaN`` or a number beyond doubles is none) is a plain message;
    halves of surrogate pairs stay escapes. A long conversation is numbered by ranges, not in one task.
    """
    check_schemas(schemas)
    spark = messages.sparkSession
    short_batches(spark)
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    types = "conv_id long, turn long, pos int, kind string, call_id string, refs array<string>, problem string, json string"
    events = rows.mapInArrow(_parsed(schemas), types).withColumn("event", F.monotonically_increasing_id())
    events = events.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    events = stage(events.withColumn("own_turn", F.col("turn")).withColumn("turn", F.coalesce("turn", F.lit(LAST))), "chat-events")

    def first_of(kind: str):
        own = events.filter((F.col("kind") == kind) & F.col("call_id").isNotNull()).groupBy("conv", "call_id")
        return own.agg(F.min(F.struct("turn", "pos", "event")).alias("first")).select(
            "conv", "call_id", F.col("first.event").alias(kind), F.col("first.turn").alias(f"{kind}_turn")
        )

    calls, results = first_of("call"), first_of("result")
    links = stage(calls.join(results.hint("shuffle_hash"), ["conv", "call_id"], "left"), "chat-links")
    owners = events.filter("kind = 'call'").join(links.select(F.col("call").alias("event")), "event", "left_semi")
    owned = stage(owners.select("conv", "event", "turn", "refs"), "chat-calls")
    places = _placed(owned, links)
    told = links.join(places, links["call"] == places["event"], "left")
    ends = told.select(
        F.col("call").alias("event"), F.coalesce("t", "call_turn").alias("t"), F.coalesce("d", F.lit(0)).alias("d"),
        F.col("result").isNotNull().alias("paired"), F.col("t").isNull().alias("circle"),
    ).unionByName(
        told.filter("result IS NOT NULL").select(
            F.col("result").alias("event"), F.greatest("result_turn", F.coalesce("t", "call_turn")).alias("t"),
            (F.coalesce("d", F.lit(0)) + 1).alias("d"), F.lit(True).alias("paired"), F.lit(False).alias("circle"),
        )
    )
    lost = owned.select("conv", "event", F.explode("refs").alias("call_id")).join(links.select("conv", "call_id"), ["conv", "call_id"], "left_anti")
    lost = lost.select("event").distinct().withColumn("lost", F.lit(True))
    whole = events.join(ends, "event", "left").join(lost, "event", "left")
    problem = F.coalesce("problem", F.when(F.col("lost"), F.lit("reference to no call")), F.when(F.col("circle"), F.lit("circle of references")))
    whole = stage(
        whole.select(
            "conv", "conv_id", "own_turn", "turn", "pos", "kind", "call_id", "json", "event", problem.alias("problem"),
            F.coalesce("t", "turn").alias("t"), F.coalesce("d", F.lit(0)).alias("d"),
            F.when(F.col("kind") != "message", F.coalesce("paired", F.lit(False))).alias("linked"),
        ),
        "chat-whole",
    )
    placed = number_rows(whole, ["conv"], ["conv", "t", "d", "turn", "pos", "event"], "position")
    return placed.select("conv_id", "position", F.col("own_turn").alias("turn"), "kind", "call_id", "linked", "problem", "json")
