import json
import random

import pytest

from palimpsest.llm import chat
from palimpsest.llm.queries import op3_chat_formatting

SCHEMA = "conv_id long, turn long, role string, text string, kind string, after string, depth string, json string"
TOOLS = {"add": {"type": "object", "properties": {"a": {"type": "number"}, "b": {"type": "integer", "minimum": 0}}, "required": ["a"], "additionalProperties": False}}


def call(i, args=None, name="add"):
    return f"<tool_call>{json.dumps({'id': i, 'name': name, 'arguments': {'a': 1} if args is None else args})}</tool_call>"


def result(i, content="ok"):
    return f"<tool_result>{json.dumps({'id': i, 'content': content})}</tool_result>"


MESSAGES = [
    (1, 0, "user", "é please"), (1, 1, "assistant", "Let me see. " + call("x") + call("y", {"b": -1, "c": 2})), (1, 2, "tool", result("x", {"z": 1, "a": [1, "é"]})), (1, 3, "assistant", "done"),
    (2, 0, "tool", result("q")), (2, 1, "assistant", call("q", {"a": {"$result": "r"}})), (2, 2, "assistant", call("r")), (2, 3, "tool", result("r")),
    (3, 0, "assistant", call("a", {"a": {"$result": "b"}}) + call("b", {"a": {"$result": "a"}})),
    (4, 0, "assistant", "<tool_call>{broken</tool_call> <tool_call>[1]</tool_call>"), (4, 1, "user", call("user")), (4, 2, None, None), (None, 0, "user", "nobody"), (4, None, "user", "when"),
    (5, 0, "assistant", call("d") + call("d", {"a": 2})), (5, 1, "tool", result("d", 1) + result("d", 2)), (5, 2, "tool", result("lost")), (5, 3, "assistant", call("u", name="nothing") + call(7)), (5, 4, "tool", result(7)),
    (1, 0, "user", "é please"),
]


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.createDataFrame([(*m, "k", "a", "d", "j") for m in MESSAGES], SCHEMA)
    found = chat.linked_chat(docs, TOOLS).collect()
    return sorted(found, key=lambda r: [(x is not None, x) for x in (r.conv_id, r.after_turn, r.after_part, r.depth, r.turn, r.part)])


def _of(rows, conv):
    return [(r.kind, json.loads(r.json)) for r in rows if r.conv_id == conv]


def test_links_validity_and_canonical_lines(rows):
    one = _of(rows, 1)
    assert [k for k, _ in one] == ["text", "text", "text", "call", "call", "result", "text"]
    x, y, r = (e for k, e in one if k != "text")
    assert x["linked"] and x["valid"] and r["linked"] and r["content"] == {"a": [1, "é"], "z": 1}
    assert not y["linked"] and not y["valid"] and y["error"] == "$.a: missing; $.b: out of range; $.c: not allowed"
    for row in rows:
        assert row.json == json.dumps(json.loads(row.json), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_topological_order(rows):
    two = [(k, e.get("id")) for k, e in _of(rows, 2)]
    assert two.index(("call", "r")) < two.index(("result", "r"))
    assert two.index(("call", "r")) < two.index(("call", "q")) < two.index(("result", "q"))


def test_cycles_are_invalid_and_end(rows):
    assert all(not e["valid"] and e["error"] == "cycle" for k, e in _of(rows, 3)) and len(_of(rows, 3)) == 2


def test_odd_messages(rows):
    four = _of(rows, 4)
    assert [k for k, _ in four] == ["text"] * 4 and {e["content"] for _, e in four} >= {"", "when", MESSAGES[10][3], MESSAGES[9][3]}
    assert len(_of(rows, None)) == 1 and len(rows) == sum(len(chat.events_of(m[2], m[3], TOOLS)) for m in MESSAGES)


def test_repeated_and_unknown_identifiers(rows):
    five = _of(rows, 5)
    assert len(five) == 8
    assert [e["linked"] for k, e in five if e["id"] == "lost"] == [False]
    assert [e["error"] for k, e in five if e["id"] == "u"] == ["unknown tool"]
    assert all(e["linked"] for k, e in five if e["id"] in ("d", "7"))


def test_a_long_chain_of_results(spark):
    docs = [(1, 0, "assistant", "".join(call(str(i), {"a": {"$result": str(i + 1)}} if i < 9 else None) for i in range(10)))]
    found = chat.linked_chat(spark.createDataFrame(docs, "conv_id long, turn long, role string, text string"), TOOLS).collect()
    order = sorted(found, key=lambda r: (r.after_turn, r.after_part, r.depth, r.turn, r.part))
    assert [json.loads(r.json)["id"] for r in order] == [str(i) for i in range(9, -1, -1)]


def test_schema_checks():
    ok = {"type": ["object", "null"], "properties": {"s": {"type": "string", "minLength": 2, "pattern": "^a"}, "l": {"type": "array", "items": {"enum": [1, 2]}}, "n": {"type": "integer", "maximum": 3}, "t": {"const": True}}, "additionalProperties": {"type": "boolean"}}
    good = [None, {}, {"s": "ab"}, {"l": [1, 2]}, {"n": 3}, {"n": 2.0}, {"t": True}, {"x": False}]
    bad = [1, [], {"s": "a"}, {"s": "bb"}, {"l": [3]}, {"n": 4}, {"n": True}, {"n": 1.5}, {"t": False}, {"x": 1}]
    assert all(not chat.schema_errors(v, ok) for v in good) and all(chat.schema_errors(v, ok) for v in bad)


def test_schema_keywords():
    cases = [
        ({"properties": {"a": True, "b": False}}, [{"a": 1}, {}], [{"b": 1}]), ({"enum": [True, 2]}, [True, 2, 2.0], [1, False]), ({"const": 0}, [0, 0.0], [False]),
        ({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, [2, 1.5, "x"], [1, 3]), ({"multipleOf": 0.5}, [1, 1.5], [1.2]), ({"multipleOf": 3}, [9, 10**400 * 3], [10]),
        ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, [[1], [1, True]], [[], [1, 2, 3], [1, 1.0]]), ({"minProperties": 1, "maxProperties": 1}, [{"a": 1}], [{}, {"a": 1, "b": 2}]),
        ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, ["a", 6], [4]), ({"oneOf": [{"type": "number"}, {"minimum": 5}]}, [4], [6]), ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, [1], [3]),
        ({"not": {"type": "null"}}, [1], [None]), ({"items": False}, [[]], [[1]]), ({"additionalProperties": False, "properties": {"x": {}}}, [{"x": []}], [{"y": 1}]),
    ]
    for schema, good, bad in cases:
        chat.check_schema(schema)
        assert all(not chat.schema_errors(v, schema) for v in good) and all(chat.schema_errors(v, schema) for v in bad), schema
    for schema in ({"$ref": "#/x"}, {"properties": {"a": {"minimun": 1}}}, {"items": {"anyOf": [{"unknown": 1}]}}, {"multipleOf": 0}, [1]):
        with pytest.raises(ValueError):
            chat.check_schema(schema)


def test_a_schema_that_cannot_be_checked_is_refused(spark):
    with pytest.raises(ValueError, match="not supported"):
        chat.linked_chat(spark.createDataFrame([], SCHEMA), {"t": {"$ref": "#"}})


def test_odd_identifiers_surrogates_and_depth(spark):
    deep = "[" * 5000 + "]" * 5000
    texts = [
        '<tool_call>{"id":"\\ud800","name":"add","arguments":{"a":"\\udfff","\\ud800":1}}</tool_call>', f'<tool_call>{{"id":1,"arguments":{deep}}}</tool_call>',
        '<tool_call>{"id":{"x":[null]},"name":7,"arguments":1e999}</tool_call>', '<tool_call>{"id":["y"],"name":7,"arguments":{"$result":"\\ud800"}}</tool_call>',
    ]
    rows = [(c, t, "assistant", x) for c in ("one", "", "12", None) for t, x in zip(("1", "x", None, "9"), texts, strict=True)]
    found = chat.linked_chat(spark.createDataFrame(rows, "conv_id string, turn string, role string, text string"), TOOLS).collect()
    assert len(found) == 16 and {r.conv_id for r in found} == {"one", "", "12", None} and {r.turn for r in found} == {1, 9, None}
    first = next(json.loads(r.json) for r in found if r.conv_id == "one" and r.turn == 1)
    assert first["id"] == "\\ud800" and first["arguments"] == {"a": "\udfff", "\ud800": 1} and not first["valid"]
    assert sorted(r.kind for r in found if r.conv_id == "one") == ["call", "call", "text", "text"]
    assert [r.depth for r in found if r.conv_id == "12" and r.turn == 9] == [2]


def brute_places(messages, schemas):
    """Each call's place and depth by recursion, and which calls are on or behind a cycle."""
    own, uses = {}, {}
    for c, t, role, text in sorted((m for m in messages if m[0] is not None), key=lambda m: (m[0], m[1])):
        for part, e in enumerate(chat.events_of(role, text, schemas)):
            if e["kind"] == "call" and (c, e["call_id"]) not in own:
                own[c, e["call_id"]], uses[c, e["call_id"]] = (t, part), e["uses"]

    def visit(k, path):
        if k in path:
            return None
        found = [visit((k[0], u), path | {k}) for u in uses[k] if (k[0], u) in own]
        if None in found:
            return None
        return max([own[k], *(p for p, _ in found)]), max([0, *(d + 2 for _, d in found)])

    return {k: visit(k, frozenset()) or (own[k], 0, "cyclic") for k in own}


@pytest.mark.parametrize("uses", [0, 4, 10**6])
def test_random_graphs_as_by_brute_force(spark, monkeypatch, uses):
    """Whether one task puts a conversation in order, or rounds of joins do."""
    monkeypatch.setattr(chat, "USES", uses)
    rng = random.Random(uses)
    messages = []
    for c in range(8):
        for t in range(7):
            names = rng.sample("abcdefghij", rng.randrange(3))
            text = "".join(call(n, {"a": {"$result": rng.choice("abcdefghijz")}, "b": {"$result": rng.choice("abcdefghijz")}} if rng.random() < 0.5 else None) for n in names)
            messages.append((c, t, "assistant", text))
    want = brute_places(messages, TOOLS)
    assert any(len(x) == 3 for x in want.values()) and any(x[1] > 2 for x in want.values())
    found = chat.linked_chat(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string"), TOOLS).collect()
    seen = set()
    for r in sorted(found, key=lambda r: (r.conv_id, r.turn, r.part)):
        e = json.loads(r.json)
        if r.kind == "call" and (r.conv_id, e["id"]) not in seen:
            seen.add((r.conv_id, e["id"]))
            place = want[r.conv_id, e["id"]]
            assert ((r.after_turn, r.after_part), r.depth) == place[:2] and ("cycle" in e.get("error", "")) == (len(place) == 3)
    assert seen == set(want)


def test_empty_table_and_query(spark, sf_dir):
    assert chat.linked_chat(spark.createDataFrame([], SCHEMA)).count() == 0
    table = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    got = op3_chat_formatting(spark, sf_dir).collect()
    kinds = {k: sum(r.kind == k for r in got) for k in ("text", "call", "result")}
    assert kinds == {"text": len(table), "call": sum(m.role == "user" for m in table.values()), "result": sum(m.role == "assistant" for m in table.values())}
    for r in got:
        m, e = table[r.conv_id, r.turn], json.loads(r.json)
        before, after = (table.get((r.conv_id, r.turn + d)) for d in (-1, 1))
        if r.kind == "text":
            assert e == {"conv_id": r.conv_id, "turn": r.turn, "role": m.role, "type": "text", "content": m.text}
        elif r.kind == "call":
            back = 0
            while (x := table.get((r.conv_id, r.turn - 2 * back - 2))) and x.role == "user":
                back += 1
            assert e["arguments"]["question"] == m.text and e["valid"] == bool(m.text) and e["linked"] == bool(after and after.role == "assistant") and r.depth == 2 * back
        else:
            assert e["content"] == m.text and e["linked"] == bool(before and before.role == "user")
