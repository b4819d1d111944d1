import json

from feedops.llm import chats

SCHEMAS = {"add": {"required": ["a", "b"], "properties": {"a": "number", "b": "number"}}, "say": {"properties": {"text": "string"}}}
SCHEMA = "conv_id long, turn long, role string, text string, level string"


def calls(*items, content=None):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in items]})


def result(i, value):
    return json.dumps({"tool_call_id": i, "content": value})


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in chats.link(frame, SCHEMAS).collect()), key=lambda r: (str(r[0]), r[1]))


def test_links_order_and_schemas(spark):
    rows = [
        (1, 0, "user", "add é"), (1, 1, "assistant", calls(("c2", "say", {"text": {"$result": "c1"}}), ("c1", "add", {"b": 2, "a": 1}), ("c3", "add", {"a": "x", "b": 1}), content="hm")),
        (1, 2, "tool", result("c2", "said")), (1, 3, "tool", result("c1", 3)), (1, 4, "tool", result("zz", 0)), (1, 5, "assistant", "done"),
    ]
    got = run(spark, rows)
    assert [(r[1], r[2], r[3], r[4], r[5], r[6], r[7]) for r in got] == [
        (0, 0, "message", None, "plain", -1, "none"), (1, 1, "message", None, "plain", -1, "none"), (2, 1, "call", "c1", "linked", 0, "valid"),
        (3, 3, "result", "c1", "linked", 0, "none"), (4, 1, "call", "c3", "open", 0, "invalid"), (5, 1, "call", "c2", "linked", 1, "valid"),
        (6, 2, "result", "c2", "linked", 1, "none"), (7, 4, "result", "zz", "orphan", -1, "none"), (8, 5, "message", None, "plain", -1, "none"),
    ]
    assert got[2][8] == '{"role":"assistant","tool_call":{"arguments":{"a":1,"b":2},"id":"c1","name":"add"}}'
    assert got[0][8] == '{"content":"add é","role":"user"}'


def test_circles_repeats_and_early_results(spark):
    rows = [
        (2, 0, "tool", result("e", 1)), (2, 1, "assistant", calls(("e", "other", {}))), (2, 2, "assistant", calls(("e", "other", {"n": 1}))), (2, 3, "tool", result("e", 2)),
        (2, 4, "assistant", calls(("x", "say", {"text": {"$result": "y"}}), ("y", "say", {"text": {"$result": "x"}}), ("u", "say", {"text": {"$result": "gone"}}))),
    ]
    got = [(r[2], r[3], r[4], r[5]) for r in run(spark, rows)]
    assert got == [
        (1, "call", "e", "linked"), (0, "result", "e", "linked"), (3, "result", "e", "repeated"), (2, "call", "e", "repeated"),
        (4, "call", "x", "unresolved"), (4, "call", "y", "unresolved"), (4, "call", "u", "unresolved"),
    ]


def test_odd_rows(spark):
    rows = [(None, None, None, None), (3, 0, "assistant", "{not json"), (3, 1, "tool", "{}"), (3, 2, "assistant", '{"tool_calls": []}'), (3, 2, "assistant", '{"tool_calls": []}'), (3, 3, "user", "long " * 50_000)]
    got = run(spark, rows)
    assert len(got) == 6 and {r[5] for r in got} == {"plain"}
    assert [r[1] for r in got if r[0] == 3] == [0, 1, 2, 3, 4]
    assert run(spark, []) == []


def test_levels_of_a_chain(spark):
    chain = spark.createDataFrame([("k", str(i), [str(i - 1)] if i else []) for i in range(7)], "conv string, id string, needs array<string>")
    assert {r.id: r.level for r in chats.levels(chain).collect()} == {str(i): i for i in range(7)}


def test_half_surrogates_are_escaped(spark):
    rows = [(1, 0, "assistant", '{"tool_calls":[{"id":"a\\ud800","name":"say","arguments":{"text":"x\\udc00 \\ud83d\\ude00"}}]}'), (1, 1, "tool", '{"tool_call_id":"a\\ud800","content":"\\ud800"}')]
    got = run(spark, rows)
    assert [(r[3], r[4], r[5], r[7]) for r in got] == [("call", "a\\ud800", "linked", "valid"), ("result", "a\\ud800", "linked", "none")]
    assert got[0][8] == '{"role":"assistant","tool_call":{"arguments":{"text":"x\\udc00 \U0001f600"},"id":"a\\ud800","name":"say"}}'
    assert all(json.loads(r[8]) for r in got)


def test_what_is_no_json_stays_plain(spark):
    deep = lambda n: '{"tool_calls":[{"id":"d","name":"other","arguments":' + "[" * n + "]" * n + "}]}"
    texts = [deep(100), deep(1500), deep(100_000), calls(("n", "add", {"a": float("nan"), "b": 1})), '{"tool_call_id":"n","content":1e999}', '{"tool_call_id":"n","content":' + "9" * 6000 + "}"]
    got = run(spark, [(1, i, "tool" if '"tool_call_id"' in t else "assistant", t) for i, t in enumerate(texts)])
    assert [r[3] for r in got] == ["call"] + ["message"] * 5
    assert all(json.loads(r[8])["content"] == t for r, t in list(zip(got, texts))[1:])


def test_kinds():
    place = {"type": "object", "required": ["x"], "properties": {"x": "integer", "tags": {"type": "array", "items": {"enum": ["a", 1]}}}}
    schema = {"properties": {"n": ["integer", "null"], "p": place, "e": {"enum": ["on", None]}, "u": "unheard-of"}}
    good = [{"n": None}, {"n": 3}, {"p": {"x": 1, "more": True}}, {"p": {"x": 1, "tags": ["a", 1, 1]}}, {"e": None}, {"p": {"x": {"$result": "c"}}}, {}]
    bad = [{"n": "3"}, {"n": True}, {"p": {}}, {"p": {"x": "1"}}, {"p": {"x": 1, "tags": ["b"]}}, {"p": {"x": 1, "tags": [True]}}, {"e": "off"}, {"u": 1}, {"z": 1}]
    assert all(chats.valid(a, schema) for a in good) and not any(chats.valid(a, schema) for a in bad)
