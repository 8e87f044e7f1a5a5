import inspect
import json
import random

import pytest

from skarn.llm import toolcalls
from skarn.llm.queries import op1_tool_calls


def call(i, name="search", **args):
    return {"id": i, "type": "function", "function": {"name": name, "arguments": json.dumps(args)}}


def turn(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": list(calls)})


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def test_query(spark, sf01):
    rows = spark.read.parquet(f"{sf01}/conversations.parquet").collect()
    got = {(r.conv_id, r.turn): r for r in op1_tool_calls(spark, sf01).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert json.loads(got[r.conv_id, r.turn].json) == {"role": r.role, "content": r.text}


ROWS = [
    (1, 0, "user", "hello\n  \"quoted\""),
    (1, 1, "assistant", turn(call("a", query="x"), call("b", query={"$ref": "a"}, limit=3), content="let me see")),
    (1, 2, "tool", result("a")),
    (1, 3, "tool", result("b")),
    (1, 4, "tool", result("b")),
    (2, 0, "tool", result("a")),
    (2, 1, "assistant", turn(call("a", query="x"))),
    (2, 2, "assistant", "text <tool_call>{\"id\": \"t\", \"name\": \"calculate\", \"arguments\": {\"expression\": 1}}</tool_call> more"),
    (2, 3, "tool", "<tool_response>{\"tool_call_id\": \"t\", \"content\": 5.0}</tool_response>"),
    (3, 0, "assistant", turn(call("p", query={"$ref": "q"}), call("q", query={"$ref": "p"}), call("r", query={"$ref": "q"}))),
    (3, 1, "tool", result("z")),
    (3, 2, "assistant", "{not json"),
    (3, 3, "assistant", turn(call("lonely", query="x", bad=1))),
    (None, 0, "assistant", turn(call("n", "unknown", any=1))),
    (None, 1, "tool", result("n")),
    (4, 0, None, None),
]


def test_statuses_levels_and_json(spark):
    turns = spark.createDataFrame([(*r, "k", "s") for r in ROWS], "conv_id long, turn long, role string, text string, kind string, seq string")
    got = toolcalls.link(turns).collect()
    by = {(r.conv, r.turn, r.kind, r.call_id): r for r in got}
    status = {k: r.status for k, r in by.items() if r.kind != "message"}
    assert status == {
        (1, 1, "call", "a"): "linked",
        (1, 1, "call", "b"): "linked",
        (1, 2, "result", "a"): "linked",
        (1, 3, "result", "b"): "linked",
        (1, 4, "result", "b"): "duplicate",
        (2, 0, "result", "a"): "early",
        (2, 1, "call", "a"): "linked",
        (2, 2, "call", "t"): "invalid",
        (2, 3, "result", "t"): "linked",
        (3, 0, "call", "p"): "cycle",
        (3, 0, "call", "q"): "cycle",
        (3, 0, "call", "r"): "cycle",
        (3, 1, "result", "z"): "orphan",
        (3, 3, "call", "lonely"): "invalid",
        (None, 0, "call", "n"): "linked",
        (None, 1, "result", "n"): "linked",
    }
    a, b = by[1, 1, "call", "a"], by[1, 1, "call", "b"]
    assert a.level < by[1, 2, "result", "a"].level <= b.level < by[1, 3, "result", "b"].level
    assert b.json == '{"arguments":{"limit":3,"query":{"$ref":"a"}},"id":"b","name":"search"}'
    assert by[1, 1, "message", None].json == '{"content":"let me see","role":"assistant"}'
    assert by[2, 2, "message", None].json == '{"content":"text  more","role":"assistant"}'
    assert by[2, 3, "result", "t"].json == '{"content":5,"tool_call_id":"t"}'
    assert by[3, 2, "message", None].json == '{"content":"{not json","role":"assistant"}'
    assert by[4, 0, "message", None].json == '{"content":"","role":null}'
    assert len(got) == len(ROWS) + 16
    assert toolcalls.link(turns.limit(0)).count() == 0


def test_long_chains_are_ordered(spark):
    rows = [(1, k, "assistant", turn(call(f"c{k}", query={"$ref": f"c{k - 1}"} if k else "go"))) for k in range(12)]
    got = toolcalls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("kind = 'call'").collect()
    assert [r.level for r in sorted(got, key=lambda r: r.turn)] == [2 * k + 1 for k in range(12)]


def test_a_bound_on_rounds_is_no_cycle(spark):
    rows = [(1, k, "assistant", turn(call(f"c{k}", query={"$ref": f"c{k - 1}"} if k else "x"))) for k in range(5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    with pytest.raises(RuntimeError):
        toolcalls.link(turns, max_rounds=2)
    assert inspect.signature(toolcalls.link).parameters["max_rounds"].default is None  # no chain is too long


def test_canonical_json():
    assert toolcalls.canonical({"b": [1.0, True, None, 0.5, "é\n"], "a": {}}) == '{"a":{},"b":[1,true,null,0.5,"é\\n"]}'
    assert toolcalls.problem({"query": ""}, toolcalls.TOOLS["search"]) == "$.query: length"
    assert toolcalls.problem({"query": "x", "limit": 0}, toolcalls.TOOLS["search"]) == "$.limit: range"
    assert toolcalls.problem([1, "x"], {"type": "array", "items": {"type": "integer"}}) == "$[1]: not integer"
    assert toolcalls.problem("x", {"enum": ["y"]}) == "$: not in enum"
    assert toolcalls.problem({"a": 1}, {"additionalProperties": {"type": "string"}}) == "$.a: not string"
    assert toolcalls.problem([1, 1.0], {"uniqueItems": True}) == "$: repeated items"
    assert toolcalls.problem(3, {"anyOf": [{"type": "string"}, {"minimum": 5}]}) == "$: fits none"
    assert toolcalls.problem(3, {"oneOf": [{"type": "integer"}, {"minimum": 5}], "multipleOf": 3, "exclusiveMinimum": 2}) is None
    assert toolcalls.problem("ab", {"pattern": "^a.$", "const": "ab", "not": {"type": "null"}}) is None


def test_lone_surrogates_long_texts_and_repeated_rows(spark):
    lone = '{"tool_calls":[{"id":"\\ud800","name":"x","arguments":{"\\udfff":1}}]}'
    long = turn(call("long", query="y" * 1_000_000), content="z" * 1_000_000)
    rows = [(1, 0, "assistant", lone), (2, 0, "assistant", long), (2, 0, "assistant", long), (2, 1, "tool", result("long")), (2, 1, "tool", result("long"))]
    got = toolcalls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 10
    first = next(r for r in got if r.conv == 1 and r.kind == "call")
    assert first.call_id == "\\ud800" and first.json == '{"arguments":{"\\udfff":1},"id":"\\ud800","name":"x"}'
    assert {r.status for r in got if r.conv == 2 and r.kind != "message"} == {"linked"}


def brute_status(rows):
    """(conv, turn, seq) -> (status, level) of calls and results, conversation by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        events = [(t, q, e) for _, t, role, text in own for q, e in enumerate(toolcalls.events(role, text, toolcalls.TOOLS)) if q]
        calls, results = {}, {}
        for t, q, e in events:
            (calls if e["kind"] == "call" else results).setdefault(e["call_id"], (t, q, e))

        def depth(i, seen=()):
            if i in seen:
                return None
            below = [depth(n, (*seen, i)) for n in calls[i][2]["needs"] if n in calls]
            return None if None in below else max(below, default=-1) + 1

        for t, q, e in events:
            i, is_call = e["call_id"], e["kind"] == "call"
            level = depth(i) if i in calls else None
            if (calls if is_call else results)[i][:2] != (t, q):
                status = "duplicate"
            elif i not in calls:
                status = "orphan"
            elif not is_call and (t, q) < calls[i][:2]:
                status = "early"
            elif level is None:
                status = "cycle"
            elif is_call and e["problem"]:
                status = "invalid"
            else:
                status = "linked" if i in results else "unanswered"
            out[conv, t, q] = status, None if level is None else 2 * level + (1 if is_call else 2)
    return out


def test_generated_conversations_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(120):
        names = [f"c{k}" for k in range(rng.randrange(1, 8))]
        for t in range(rng.randrange(2, 9)):
            if rng.random() < 0.55:
                made = [call(rng.choice(names), rng.choice(["search", "calculate", "other"]), **{rng.choice(["query", "expression", "limit"]): rng.choice(["x", 3, {"$ref": rng.choice(names)}, [{"$ref": rng.choice(names)}]])}) for _ in range(rng.randrange(1, 4))]
                rows.append((conv, t, "assistant", turn(*made)))
            else:
                rows.append((conv, t, "tool", result(rng.choice([*names, "stray"]))))
    got = toolcalls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("kind <> 'message'").collect()
    want = brute_status(rows)
    assert {(r.conv, r.turn, r.seq): (r.status, r.level) for r in got} == want
    assert {s for s, _ in want.values()} == {"duplicate", "orphan", "early", "cycle", "invalid", "linked", "unanswered"}
