"""Chat formatting with linked tool calls.

An assistant's text may hold `<tool_call>{"id", "name", "arguments"}</tool_call>` blocks; a message of role `tool` holds
`<tool_result>{"id", "content"}</tool_result>` blocks. Calls and results are hash-joined by conversation and identifier. A
call may use other calls' results (`{"$result": id}` anywhere in its arguments); events are put in an order in which every
result follows its call and every call follows the results that it uses. Arguments are checked against JSON schemas.
Every event becomes one line of canonical JSON, so no conversation is ever gathered.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, remove, work_dir, written

_BLOCK = re.compile(r"<(tool_call|tool_result)>(.*?)</\1>", re.DOTALL)
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
#: Keywords that are checked, and those that say nothing about a value. A schema with any other is refused.
_CHECKED = set("type enum const required properties additionalProperties items minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern minItems maxItems uniqueItems minProperties maxProperties anyOf oneOf allOf not".split())
_SILENT = set("title description default examples format deprecated readOnly writeOnly $schema $id $comment".split())
#: Characters of all schemas together, which go to every executor.
SCHEMA_CHARS = 4_000_000
#: Levels of nested JSON; a deeper block stays text.
DEPTH = 100
#: Uses of results in one conversation that one task puts in order; a longer conversation is put in order by rounds of joins.
USES = 200_000
_EVENT = "turn long, part long, role string, kind string, call_id string, name string, arguments string, content string, uses array<string>, error string"


def canonical(value: object) -> str:
    """JSON with sorted keys, without blanks, in plain UTF-8; halves of surrogate pairs, which UTF-8 can't hold, stay escaped."""
    return _whole(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


def _whole(text: str) -> str:
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _same(a: object, b: object) -> bool:
    """Equality of JSON values: true isn't 1, but 1 is 1.0."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def check_schema(schema: object, at: str = "#") -> None:
    """Raise unless every keyword of the schema is one that `schema_errors` checks or that says nothing."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at} is no schema")
    if unknown := sorted(set(schema) - _CHECKED - _SILENT):
        raise ValueError(f"{at}: keywords that are not supported: {', '.join(unknown)}")
    if "pattern" in schema:
        re.compile(schema["pattern"])
    if schema.get("multipleOf", 1) <= 0:
        raise ValueError(f"{at}: multipleOf must be positive")
    below = [*schema.get("properties", {}).items(), *[(k, schema[k]) for k in ("additionalProperties", "items", "not") if k in schema]]
    for k in ("anyOf", "oneOf", "allOf"):
        below += [(f"{k}/{i}", x) for i, x in enumerate(schema.get(k, []))]
    for k, x in below:
        check_schema(x, f"{at}/{k}")


def schema_errors(value: object, schema: dict | bool, at: str = "$") -> list[str]:
    """Where a value differs from a schema that `check_schema` has passed."""
    if schema is True or isinstance(value, dict) and set(value) == {"$result"}:
        return []  # what a result stands for is known only when the call is made
    if schema is False:
        return [f"{at}: not allowed"]
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and not _same(value, schema["const"]):
        out.append(f"{at}: not the constant")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        out += _sized(len(value), schema, "Properties", at)
        for k, v in value.items():
            out += schema_errors(v, known.get(k, schema.get("additionalProperties", True)), f"{at}.{k}")
    if isinstance(value, list):
        out += _sized(len(value), schema, "Items", at)
        if schema.get("uniqueItems") and any(_same(x, y) for i, x in enumerate(value) for y in value[:i]):
            out.append(f"{at}: repeated items")
        for i, v in enumerate(value):
            out += schema_errors(v, schema.get("items", True), f"{at}[{i}]")
    if isinstance(value, str):
        out += _sized(len(value), schema, "Length", at)
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    if _is(value, "number"):
        if not schema.get("minimum", value) <= value <= schema.get("maximum", value):
            out.append(f"{at}: out of range")
        elif "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"] or "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
            out.append(f"{at}: out of range")
        if "multipleOf" in schema and not _multiple(value, schema["multipleOf"]):
            out.append(f"{at}: not a multiple")
    for x in schema.get("allOf", []):
        out += schema_errors(value, x, at)
    if "anyOf" in schema and all(schema_errors(value, x, at) for x in schema["anyOf"]):
        out.append(f"{at}: none of anyOf")
    if "oneOf" in schema and sum(not schema_errors(value, x, at) for x in schema["oneOf"]) != 1:
        out.append(f"{at}: not one of oneOf")
    if "not" in schema and not schema_errors(value, schema["not"], at):
        out.append(f"{at}: not excluded")
    return out


def _sized(n: int, schema: dict, what: str, at: str) -> list[str]:
    return [] if schema.get(f"min{what}", 0) <= n <= schema.get(f"max{what}", n) else [f"{at}: {what.lower()}"]


def _multiple(value: int | float, of: int | float) -> bool:
    return value % of == 0 if isinstance(value, int) and isinstance(of, int) else abs(value) < 1e300 and (value / of).is_integer()


def _is(value: object, kind: str) -> bool:
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    return isinstance(value, _TYPES.get(kind, object))


def _deep(value: object) -> bool:
    """Whether a value is nested over DEPTH levels."""
    level = [value]
    for _ in range(DEPTH):
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
        if not level:
            return False
    return True


def _used(value: object) -> set[str]:
    """Identifiers of the results that arguments refer to."""
    if isinstance(value, dict):
        if set(value) == {"$result"} and isinstance(value["$result"], str):
            return {_whole(value["$result"])}
        return set().union(*map(_used, value.values()))
    return set().union(*map(_used, value)) if isinstance(value, list) else set()


def _name(value: object) -> str | None:
    return None if value is None else _whole(value) if isinstance(value, str) else canonical(value)


def events_of(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[dict]:
    """The events of one message in order: what it says, its calls or its results. A block that isn't a JSON object stays text."""
    out, rest, at, text = [], [], 0, text or ""
    wanted = {"assistant": "tool_call", "tool": "tool_result"}.get(role)
    for m in _BLOCK.finditer(text):
        if m[1] != wanted:
            continue
        try:
            body = json.loads(m[2])
            canonical(body)
        except (ValueError, RecursionError):
            continue
        if not isinstance(body, dict) or _deep(body):
            continue
        rest.append(text[at : m.start()])
        at = m.end()
        event = {"kind": wanted.removeprefix("tool_"), "call_id": _name(body.get("id")), "name": None, "arguments": None, "content": None, "uses": [], "error": None}
        if wanted == "tool_call":
            given = body.get("arguments", {})
            event |= {"name": _name(body.get("name")), "arguments": canonical(given), "uses": sorted(_used(given))}
            schema = schemas.get(event["name"])
            errors = ["unknown tool"] if schema is None else schema_errors(given, schema)
            event["error"] = _whole("; ".join(errors)) or None
        else:
            event["content"] = canonical(body.get("content"))
        out.append(event)
    said = "".join([*rest, text[at:]])
    if said.strip() or not out:
        out.insert(0, {"kind": "text", "call_id": None, "name": None, "arguments": None, "content": said, "uses": [], "error": None})
    return out


def _events(messages: DataFrame, schemas: dict[str, dict], cols: tuple[str, str, str, str]) -> DataFrame:
    bounded_batches(messages.sparkSession)
    conv, turn, role, text = cols
    kind_of = messages.schema[conv].dataType
    named = messages[conv] if isinstance(kind_of, T.IntegralType) else messages[conv].cast("string")
    sent = messages.select(named.alias("conv_id"), messages[turn].try_cast("long").alias("turn"), messages[role].cast("string").alias("role"), messages[text].cast("string").alias("text"))
    schema = T.StructType([T.StructField("conv_id", sent.schema["conv_id"].dataType), *T._parse_datatype_string(_EVENT).fields])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    names = schema.names[4:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c, t, r, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rows += [(c, t, part, r, *[e[n] for n in names]) for part, e in enumerate(events_of(r, body, schemas))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], schema.names)

    return sent.mapInArrow(run, schema)


def _first(events: DataFrame, kind: str) -> DataFrame:
    """Of calls (or results) with one identifier the first counts."""
    place = F.struct("turn", "part", F.coalesce("error", F.lit("")).alias("e"), F.coalesce("arguments", "content").alias("a"))
    return events.where((F.col("kind") == kind) & F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min(place).alias("first"), F.max_by("uses", "turn").alias("uses"))


def linked_chat(messages: DataFrame, schemas: dict[str, dict] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for every event: conv_id, after_turn, after_part, depth, turn, part, kind, linked, valid, json.

    Sorted by the columns from after_turn to part, a conversation's events are in topological order: (after_turn, after_part) is
    the latest place among an event and all that it depends on, and depth the length of the longest chain of those. `linked`
    says whether a call has a result or a result its call (null for text); `valid` whether a call's arguments fit its tool's
    schema and it isn't part of a cycle (null for others). Null texts count as empty; null conversations, turns and roles stay
    null, and null conversations link nothing. Conversations that aren't whole numbers are strings; a turn that is no number is
    null. A schema with a keyword that isn't checked is refused. Of events that repeat an identifier the first call and the first result are
    linked, and every repetition keeps its own row. No rows, no events.
    """
    schemas = schemas or {}
    for name, schema in schemas.items():
        check_schema(schema, name)
    if sum(len(canonical(s)) for s in schemas.values()) > SCHEMA_CHARS:
        raise ValueError("the schemas are too large to send to every executor")
    events = _events(messages, schemas, (conv_col, turn_col, role_col, text_col))
    folder = work_dir(messages.sparkSession, "chat")
    events = written(events, f"{folder}/events")
    key = ["conv_id", "call_id"]
    calls = _first(events, "call").select(*key, F.col("first.turn").alias("call_turn"), F.col("first.part").alias("call_part"))
    results = _first(events, "result").select(*key, F.lit(True).alias("answered"))
    uses = events.where("kind = 'call' and size(uses) > 0 and call_id is not null").select(*key, "turn", "part", F.explode("uses").alias("used"))
    places = written(_places(calls, uses, folder), f"{folder}/places")
    joined = events.join(places, key, "left").join(results, key, "left")
    own = F.struct("turn", "part")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    after = F.when(is_call, F.greatest(own, F.coalesce("after", own))).when(is_result, F.greatest(own, F.coalesce("after", own))).otherwise(own)
    depth = F.when(is_call, F.coalesce("depth", F.lit(0))).when(is_result, F.coalesce(F.col("depth") + 1, F.lit(0))).otherwise(F.lit(0))
    linked = F.when(is_call, F.coalesce("answered", F.lit(False))).when(is_result, F.col("depth").isNotNull())
    error = F.when(is_call & F.col("cyclic"), F.concat_ws("; ", "error", F.lit("cycle"))).otherwise(F.col("error"))
    out = joined.select("conv_id", after["turn"].alias("after_turn"), after["part"].alias("after_part"), depth.cast("long").alias("depth"), "turn", "part", "role", "kind", "call_id", "name", "arguments", "content", linked.alias("linked"), error.alias("error"))
    return _lines(out)


def _places(calls: DataFrame, uses: DataFrame, folder: str) -> DataFrame:
    """Where each call stands at the earliest: (conv_id, call_id, after, depth, cyclic).

    A conversation's uses are put in order by one task; one of over USES of them by rounds, each of which places the calls whose
    used results all belong to placed calls. What can't be placed is part of a cycle, or uses such a part.
    """
    key = ["conv_id", "call_id"]
    own = F.struct(F.col("call_turn").alias("turn"), F.col("call_part").alias("part"))
    calls = calls.select(*key, own.alias("own"))
    first = uses.select(*key, "used", F.struct("turn", "part").alias("own")).join(calls, [*key, "own"], "left_semi")  # of repeated calls the first
    known = calls.select("conv_id", F.col("call_id").alias("used"), F.col("own").alias("used_own"))
    waiting = written(first.join(known, ["conv_id", "used"]).select(*key, "own", "used", "used_own").distinct(), f"{folder}/uses")
    placed = calls.join(waiting, key, "left_anti").select(*key, F.col("own").alias("after"), F.lit(0).alias("depth"), F.lit(False).alias("cyclic"))
    if waiting.isEmpty():
        return placed
    long = written(waiting.groupBy("conv_id").count().where(F.col("count") > USES).select("conv_id"), f"{folder}/long")
    placed = placed.unionByName(_ordered(waiting.join(long, "conv_id", "left_anti")))
    if long.isEmpty():
        return placed
    return placed.unionByName(_in_rounds(waiting.join(long, "conv_id", "left_semi"), folder))


def _ordered(uses: DataFrame) -> DataFrame:
    """The places of the calls in `uses`, a conversation at a time."""
    schema = T.StructType([uses.schema["conv_id"], uses.schema["call_id"], *T._parse_datatype_string("after struct<turn:long,part:long>, depth int, cyclic boolean").fields])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["conv_id"] != now:
                    yield out(now, held)
                    held = []
                now = row["conv_id"]
                held.append(row)
        if held:
            yield out(now, held)

    def out(conv, rows: list[dict]) -> pa.RecordBatch:
        found = [(conv, call, {"turn": p[0], "part": p[1]}, depth, cyclic) for call, p, depth, cyclic in ordered(rows)]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], schema.names)

    return uses.repartition("conv_id").sortWithinPartitions("conv_id", "call_id", "used").mapInArrow(run, schema)


def _place(own: dict) -> tuple:
    """A place that can be compared; null comes first, as in Spark."""
    return tuple(-(1 << 63) if own[k] is None else own[k] for k in ("turn", "part"))


def ordered(uses: list[dict]) -> list[tuple[str, tuple, int, bool]]:
    """(call, after, depth, cyclic) of the calls of one conversation that use results: each one's latest place among those of all
    that it depends on, and the longest chain of those."""
    own = {u["used"]: u["used_own"] for u in uses} | {u["call_id"]: u["own"] for u in uses}
    needs, users = defaultdict(set), defaultdict(list)
    for u in uses:
        needs[u["call_id"]].add(u["used"])
        users[u["used"]].append(u["call_id"])
    after, depth = {c: _place(p) for c, p in own.items()}, dict.fromkeys(own, 0)
    left = {c: len(n) for c, n in needs.items()}
    ready, done = [c for c in own if c not in needs], set()
    while ready:
        c = ready.pop()
        done.add(c)
        for user in users[c]:
            after[user], depth[user] = max(after[user], after[c]), max(depth[user], depth[c] + 2)
            left[user] -= 1
            if not left[user]:
                ready.append(user)
    known = {_place(p): (p["turn"], p["part"]) for p in own.values()}
    return [(c, known[after[c] if c in done else _place(own[c])], depth[c] if c in done else 0, c not in done) for c in needs]


def _in_rounds(uses: DataFrame, folder: str) -> DataFrame:
    """The same by joins: as many rounds as the longest chain has calls, each over the calls that are left."""
    key = ["conv_id", "call_id"]
    users = uses.select("conv_id", F.col("call_id").alias("used")).distinct().withColumn("waits", F.lit(True))
    uses = uses.join(users, ["conv_id", "used"], "left")
    given = lambda c: F.when(F.col("waits").isNull(), c)  # noqa: E731  what needs nothing is placed already
    waiting = uses.select(*key, "own", "used", given(F.col("used_own")).alias("after"), given(F.lit(0)).alias("depth"))
    waiting, turn, parts = written(waiting, f"{folder}/waiting-0"), 0, []
    while True:
        turn += 1
        ready = waiting.groupBy(*key, "own").agg(F.max("after").alias("after"), F.max("depth").alias("under"), F.count_if(F.col("depth").isNull()).alias("missing")).where("missing = 0")
        ready = written(ready.select(*key, F.greatest("own", "after").alias("after"), (F.col("under") + 2).alias("depth"), F.lit(False).alias("cyclic")), f"{folder}/ready-{turn}")
        if ready.isEmpty():
            break
        parts.append(ready)
        told = ready.select("conv_id", F.col("call_id").alias("used"), F.col("after").alias("new_after"), F.col("depth").alias("new_depth"))
        rest = waiting.join(ready.select(*key), key, "left_anti").join(told, ["conv_id", "used"], "left")
        waiting = written(rest.select(*key, "own", "used", F.coalesce("after", "new_after").alias("after"), F.coalesce("depth", "new_depth").alias("depth")), f"{folder}/waiting-{turn}")
        remove(uses.sparkSession, f"{folder}/waiting-{turn - 1}")
    cyclic = waiting.groupBy(*key).agg(F.first("own").alias("after")).select(*key, "after", F.lit(0).alias("depth"), F.lit(True).alias("cyclic"))
    return reduce(DataFrame.unionByName, parts, cyclic)


def _lines(events: DataFrame) -> DataFrame:
    names = events.columns
    out = "after_turn long, after_part long, depth long, turn long, part long, kind string, linked boolean, valid boolean, json string"
    schema = T.StructType([events.schema["conv_id"], *T._parse_datatype_string(out).fields])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def line(e: dict) -> str:
        said = {"conv_id": e["conv_id"], "turn": e["turn"], "role": e["role"], "type": e["kind"]}
        if e["kind"] == "text":
            said["content"] = e["content"]
        else:
            said |= {"id": e["call_id"], "linked": e["linked"]}
            if e["kind"] == "call":
                said |= {"name": e["name"], "arguments": json.loads(e["arguments"]), "valid": e["error"] is None}
                said |= {"error": e["error"]} if e["error"] else {}
            else:
                said["content"] = json.loads(e["content"])
        return canonical(said)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [dict(zip(names, x, strict=True)) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            cols = [[r[n] for r in rows] for n in ("conv_id", "after_turn", "after_part", "depth", "turn", "part", "kind", "linked")]
            cols.append([r["error"] is None if r["kind"] == "call" else None for r in rows])
            cols.append([line(r) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], schema.names)

    return events.mapInArrow(run, schema)
