"""Chat formatting: tool calls linked to their results, ordered, checked against schemas, and written as canonical JSON.

Input are turns (conv_id, turn, role, text). The text of an assistant turn may be a JSON object with ``tool_calls``: a list of
``{"id", "name", "arguments": {...}}``; an argument ``{"$result": id}`` stands for the result of another call. The text of a tool
turn is a JSON object ``{"tool_call_id", "content"}``. Every other text is a plain message.

* Links: calls and results meet by a join on (conv_id, identifier). Of repeated identifiers the first call (by turn, then place) and
  the first result count; later ones are ``repeated``. A result without a call is an ``orphan``, a call without one is ``open``.
* Order: a plain message keeps its turn. A call depends on the calls whose results it takes; its level is one more than the highest of theirs
  (found by joins, one round per level). Calls of one turn are ordered by level and place, and a result follows its call. Calls in a circle of
  dependencies, or on an identifier that does not exist, are ``unresolved`` and keep their place.
* Schemas: {name: {"required": [...], "properties": {argument: kind}}}. A kind is a JSON type, a list of types, or a schema of its own with any
  of ``type``, ``enum``, ``properties``, ``required`` (of an object) and ``items`` (of an array). Other messages, and tools without a schema, have none.
* One row per message: keys sorted, no spaces, non-ASCII kept, so equal messages have equal bytes. No conversation is ever gathered, so one with a
  third of all turns is only a key that recurs; positions come from range partitions of (conversation, sort keys) and their totals.

Null text is an empty message; JSON that does not parse, holds NaN or numbers beyond a double, or is nested deeper than ``DEEPEST`` is plain text.
Half of a surrogate pair is written as its escape, in identifiers too. Rows with a null conv_id form a conversation of their own. Repeated rows
are messages of their own. Extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.llm.common import keep
from feedops.plans.ranked import numbered

#: Levels of nesting in a call or result.
DEEPEST = 200
KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def escaped(text: str) -> str:
    """Half surrogate pairs, which no text in UTF-8 may hold, as escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical(value: object) -> str:
    return escaped(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


def fits(value: object, kind: str | list | dict) -> bool:
    """Whether an argument is of a kind; a reference to a result fits any."""
    if isinstance(value, dict) and set(value) == {"$result"}:
        return True
    if isinstance(kind, list):
        return any(fits(value, k) for k in kind)
    if isinstance(kind, str):
        return isinstance(value, KINDS.get(kind, ())) and (kind == "boolean" or not isinstance(value, bool))
    if "type" in kind and not fits(value, kind["type"]):
        return False
    if "enum" in kind and canonical(value) not in {canonical(e) for e in kind["enum"]}:
        return False
    if isinstance(value, dict):
        known = kind.get("properties", {})
        return all(k in value for k in kind.get("required", [])) and all(fits(v, known[k]) for k, v in value.items() if k in known)
    return not isinstance(value, list) or "items" not in kind or all(fits(v, kind["items"]) for v in value)


def valid(arguments: object, schema: dict | None) -> bool | None:
    if schema is None:
        return None
    if not isinstance(arguments, dict):
        return False
    properties = schema.get("properties", {})
    return all(k in arguments for k in schema.get("required", [])) and all(k in properties and fits(v, properties[k]) for k, v in arguments.items())


def needs(arguments: object) -> list[str]:
    """Identifiers of the results that arguments refer to."""
    if isinstance(arguments, dict):
        if set(arguments) == {"$result"} and isinstance(arguments["$result"], str):
            return [escaped(arguments["$result"])]
        return sorted({n for v in arguments.values() for n in needs(v)})
    return sorted({n for v in arguments for n in needs(v)}) if isinstance(arguments, list) else []


MESSAGES = "conv_id long, turn long, place int, kind string, id string, valid boolean, needs array<string>, body string"


def _number(digits: str) -> float:
    found = float(digits)
    if math.isinf(found):
        raise ValueError(f"{digits} is beyond a double")
    return found


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _depth(value: object) -> int:
    levels, inside = 0, [value]
    while inside:
        levels += 1
        inside = [v for x in inside if isinstance(x, (dict, list)) for v in (x.values() if isinstance(x, dict) else x)]
    return levels


def _object(text: str) -> dict | None:
    if not text.lstrip().startswith("{"):
        return None
    try:
        found = json.loads(text, parse_float=_number, parse_constant=_no_number)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) and _depth(found) <= DEEPEST else None


def messages_of(turn: int | None, role: str | None, text: str | None, schemas: dict) -> list[tuple]:
    """(place, kind, id, valid, needs, body) of the messages in one turn; the body is canonical JSON."""
    text = text or ""
    found = _object(text) if role in ("assistant", "tool") else None
    if found and role == "tool" and isinstance(found.get("tool_call_id"), str):
        return [(0, "result", escaped(found["tool_call_id"]), None, [], canonical({"role": "tool", "tool_call_id": found["tool_call_id"], "content": found.get("content")}))]
    calls = found.get("tool_calls") if found and role == "assistant" else None
    if isinstance(calls, list) and calls and all(isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("name"), str) for c in calls):
        rows = []
        if found.get("content"):
            rows.append((0, "message", None, None, [], canonical({"role": "assistant", "content": found["content"]})))
        for place, call in enumerate(calls, 1):
            arguments = call.get("arguments", {})
            body = canonical({"role": "assistant", "tool_call": {"id": call["id"], "name": call["name"], "arguments": arguments}})
            rows.append((place, "call", escaped(call["id"]), valid(arguments, schemas.get(call["name"])), needs(arguments), body))
        return rows
    return [(0, "message", None, None, [], canonical({"role": role, "content": text}))]


def messages(turns: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, t, *m) for c, t, role, text in zip(*(x.to_pylist() for x in batch.columns)) for m in messages_of(t, role, text, schemas)]
            if rows:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["conv_id", "turn", "place", "kind", "id", "valid", "needs", "body"])

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, MESSAGES)


def levels(calls: DataFrame) -> DataFrame:
    """(conv, id, level) of calls (conv, id, needs): 0 without needs, else one more than the highest level of the calls it needs; calls in circles or with unknown needs are left out."""
    waits = keep(calls.select("conv", "id", F.explode("needs").alias("need")).distinct(), "needs")
    ready = calls.join(waits.select("conv", "id").distinct(), ["conv", "id"], "left_anti").select("conv", "id", F.lit(0).alias("level"))
    if waits.isEmpty():
        return ready
    done = keep(ready, "levels")
    while True:
        # calls all of whose needs are done
        state = waits.join(done.select("conv", F.col("id").alias("need"), "level"), ["conv", "need"], "left")
        new = state.groupBy("conv", "id").agg(F.count("*").alias("n"), F.count("level").alias("known"), (F.max("level") + 1).alias("level")).filter("n = known")
        new = keep(new.select("conv", "id", "level"), "levels")
        if new.isEmpty():
            return done
        waits = keep(waits.join(new, ["conv", "id"], "left_anti"), "needs")
        done = keep(done.unionByName(new), "levels")


def link(turns: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, position, turn, kind, call_id, status, level, schema, json): all messages in order, from position 0 in each conversation.

    ``status``: plain, linked, open, orphan, repeated or unresolved; ``level`` is -1 where there is none; ``schema``: valid, invalid or none.
    """
    found = keep(messages(turns, schemas).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), "messages")
    place = F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), "place", "body")
    tools = found.filter("kind <> 'message'").withColumn("at", place)
    first = tools.groupBy("conv", "id").agg(
        F.min(F.when(F.col("kind") == "call", F.col("at"))).alias("call"), F.min(F.when(F.col("kind") == "result", F.col("at"))).alias("result"),
        F.min(F.when(F.col("kind") == "call", F.struct("at", "needs"))).alias("with_needs"),
    )
    first = keep(first, "identifiers")
    level = levels(first.filter("call IS NOT NULL").select("conv", "id", F.col("with_needs.needs").alias("needs")))
    first = first.join(level, ["conv", "id"], "left")
    is_call = F.col("kind") == "call"
    own = F.when(is_call, F.col("call")).otherwise(F.col("result"))
    status = (
        F.when(F.col("kind") == "message", "plain").when(F.struct("at.turn", "at.place", "at.body") != own, "repeated")
        .when(~is_call, F.when(F.col("call").isNull(), "orphan").otherwise("linked"))
        .when(F.col("level").isNull(), "unresolved").when(F.col("result").isNull(), "open").otherwise("linked")
    )
    joined = found.withColumn("at", place).join(first.drop("with_needs"), ["conv", "id"], "left").withColumn("status", status)
    follows = (F.col("kind") == "result") & F.col("status").isin("linked", "repeated") & F.col("call").isNotNull()
    leads = F.when(follows, F.col("call")).otherwise(F.col("at"))
    calls = is_call | follows
    keys = [
        leads["turn"], F.when(calls, F.coalesce("level", F.lit(0))).otherwise(-1), leads["place"], follows.cast("int"), F.col("at.turn"), F.col("at.place"), F.col("body"),
    ]
    names = [f"k{i}" for i in range(len(keys))]
    rows = joined.select("conv", "conv_id", *[k.alias(n) for k, n in zip(keys, names)], "turn", "kind", F.col("id").alias("call_id"), "status", "level", "valid")
    placed = numbered(rows, names, "position", within=["conv"])
    return placed.select(
        "conv_id", (F.col("position") - 1).alias("position"), "turn", "kind", "call_id", "status", F.coalesce("level", F.lit(-1)).alias("level"),
        F.when(F.col("valid"), "valid").when(~F.col("valid"), "invalid").otherwise("none").alias("schema"), F.col(names[-1]).alias("json"),
    )
