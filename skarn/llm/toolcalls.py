"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

A turn may hold tool calls, as a JSON object with ``tool_calls`` or in ``<tool_call>`` tags, and
results, as a JSON object with ``tool_call_id`` in a tool turn or in ``<tool_response>`` tags.
Every turn gives one row for itself and one per call and result in it.  Calls and results are
hash-joined by (conversation, identifier); the first call and the first result of an identifier
are linked.  An argument ``{"$ref": id}`` makes a call depend on another's result; levels of the
resulting graph are found by relaxation from its roots, so that ordering rows by (level, turn,
seq) puts everything behind what it needs.  Arguments are checked against the tool's schema and
all JSON is written canonically (sorted keys, no blanks, shortest numbers).

A conversation is never gathered in one task: rows are keyed by identifier within conversation,
and levels are columns to sort by.  A round of levels touches only the calls settled in the round
before and what still waits for them; there are as many rounds as the longest chain has calls.

Defined results: a null text is empty; text that is not well-formed JSON is plain; a lone surrogate
escape in JSON stays an escape; texts of any length are read whole; repeated rows each give rows,
of calls and results all but the first by place are ``duplicate`` and identical ones share a status;
a null conversation is one of its own; a call in a cycle, or behind one, has status ``cycle`` and no
level; an empty table gives no rows; further columns are left out, so their names can't clash.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.core.durable import cut

#: Production schemas of tools; calls to other tools are well-formed but unchecked.
TOOLS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}
_LONE = re.compile("[\ud800-\udfff]")
_TAGS = re.compile(r"<tool_(call|response)>(.*?)</tool_\1>", re.S)


def plain(text: str) -> str:
    """The text with lone surrogates, which UTF-8 does not have, as escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; equal values have equal text."""
    if isinstance(value, bool) or value is None or isinstance(value, int):
        return json.dumps(value)
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not a JSON number")
        return str(int(value)) if value.is_integer() and abs(value) < 2**53 else repr(value)
    if isinstance(value, str):
        return plain(json.dumps(value, ensure_ascii=False))
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"


def problem(value, schema: dict, at: str = "$") -> str | None:
    """The first way in which a value breaks a JSON schema (the keywords that tools use)."""
    kind = schema.get("type")
    fits = {
        "object": isinstance(value, dict),
        "array": isinstance(value, list),
        "string": isinstance(value, str),
        "boolean": isinstance(value, bool),
        "null": value is None,
        "integer": isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer(),
        "number": isinstance(value, int | float) and not isinstance(value, bool),
    }
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return None  # another call's result stands here
    if kind and not any(fits[k] for k in ([kind] if isinstance(kind, str) else kind)):
        return f"{at}: not {kind}"
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return f"{at}: not in enum"
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        return f"{at}: not the constant"
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            return f"{at}: length"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            return f"{at}: pattern"
    if fits["number"]:
        low, high = schema.get("exclusiveMinimum", -math.inf), schema.get("exclusiveMaximum", math.inf)
        if not schema.get("minimum", value) <= value <= schema.get("maximum", value) or not low < value < high:
            return f"{at}: range"
        if "multipleOf" in schema and value % schema["multipleOf"]:
            return f"{at}: no multiple"
    for part in schema.get("allOf", ()):
        if found := problem(value, part, at):
            return found
    if "anyOf" in schema and all(problem(value, part, at) for part in schema["anyOf"]):
        return f"{at}: fits none"
    if "oneOf" in schema and sum(problem(value, part, at) is None for part in schema["oneOf"]) != 1:
        return f"{at}: does not fit one"
    if "not" in schema and problem(value, schema["not"], at) is None:
        return f"{at}: excluded"
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return f"{at}: number of items"
        if schema.get("uniqueItems") and len(set(map(canonical, value))) < len(value):
            return f"{at}: repeated items"
        return next((p for k, x in enumerate(value) if (p := problem(x, schema.get("items", {}), f"{at}[{k}]"))), None)
    if isinstance(value, dict):
        own = schema.get("properties", {})
        for k in schema.get("required", ()):
            if k not in value:
                return f"{at}.{k}: missing"
        for k in sorted(value):
            if k in own:
                if found := problem(value[k], own[k], f"{at}.{k}"):
                    return found
            elif (more := schema.get("additionalProperties", True)) is False:
                return f"{at}.{k}: unknown"
            elif isinstance(more, dict) and (found := problem(value[k], more, f"{at}.{k}")):
                return found
    return None


def references(value) -> list[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"}:
            return [str(value["$ref"])]
        value = list(value.values())
    return [r for x in value for r in references(x)] if isinstance(value, list) else []


def _loads(text: str):
    try:
        value = json.loads(text)
        canonical(value)
    except (ValueError, RecursionError):
        return None
    return value


def _call(value, tools: dict) -> dict | None:
    if not isinstance(value, dict):
        return None
    function = value.get("function") if isinstance(value.get("function"), dict) else value
    if "name" not in function or "id" not in value:
        return None
    given = function.get("arguments", {})
    arguments = _loads(given) if isinstance(given, str) else given
    name = str(function["name"])
    if arguments is None and isinstance(given, str):
        found = "$: not JSON"
    else:
        found = problem(arguments, tools.get(name, {"type": "object"}))
    body = {"arguments": given if arguments is None else arguments, "id": str(value["id"]), "name": name}
    return {"kind": "call", "call_id": plain(str(value["id"])), "problem": found and plain(found), "needs": sorted(set(map(plain, references(arguments)))), "json": canonical(body)}


def _result(value) -> dict | None:
    if not isinstance(value, dict) or "tool_call_id" not in value:
        return None
    body = {"content": value.get("content"), "tool_call_id": str(value["tool_call_id"])}
    return {"kind": "result", "call_id": plain(str(value["tool_call_id"])), "problem": None, "needs": [], "json": canonical(body)}


def events(role: str | None, text: str | None, tools: dict) -> list[dict]:
    """The turn itself, then its calls and results in order."""
    text = text or ""
    found: list[dict | None] = []
    rest = text
    stripped = text.strip()
    if stripped.startswith("{") and isinstance(whole := _loads(stripped), dict):
        if isinstance(whole.get("tool_calls"), list):
            found = [_call(x, tools) for x in whole["tool_calls"]]
            content = whole.get("content")
            rest = content if isinstance(content, str) else "" if content is None else canonical(content)
        elif role == "tool":
            found = [_result(whole)]
            rest = ""
        if None in found:
            found, rest = [], text
    if not found and "<tool_" in text:
        pieces = [(m, (_call(v, tools) if m[1] == "call" else _result(v)) if (v := _loads(m[2])) is not None else None) for m in _TAGS.finditer(text)]
        found = [e for _, e in pieces if e]
        for m, e in reversed(pieces):
            rest = rest[: m.start()] + rest[m.end() :] if e else rest
    turn = {"kind": "message", "call_id": None, "problem": None, "needs": [], "json": canonical({"content": rest, "role": role})}
    return [turn, *(e for e in found if e)]


_EVENT = pa.struct([("kind", pa.string()), ("call_id", pa.string()), ("problem", pa.string()), ("needs", pa.list_(pa.string())), ("json", pa.string())])
_TYPE = T.ArrayType(
    T.StructType([*(T.StructField(n, T.StringType()) for n in ("kind", "call_id", "problem")), T.StructField("needs", T.ArrayType(T.StringType())), T.StructField("json", T.StringType())])
)


def _parser(tools: dict):
    @F.arrow_udf(_TYPE)
    def parse(role: pa.Array, text: pa.Array) -> pa.Array:
        return pa.array([events(r.as_py(), t.as_py(), tools) for r, t in zip(role, text, strict=True)], pa.list_(_EVENT))

    return parse


def _levels(calls: DataFrame, max_rounds: int | None) -> DataFrame:
    """(conv, call_id, level) of the linked calls that are in no cycle and behind none; a chain takes a round per call."""
    needs = cut(calls.select("conv", "call_id", F.explode("needs").alias("need")))
    k, n = calls.select("conv", F.col("call_id").alias("need")).alias("k"), needs.alias("n")
    needs = cut(n.join(k, F.col("n.conv").eqNullSafe(F.col("k.conv")) & (F.col("n.need") == F.col("k.need"))).select("n.conv", "n.call_id", "n.need"))
    waiting = cut(needs.groupBy("conv", "call_id").agg(F.count(F.lit(1)).alias("left")))
    same = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.call_id") == F.col(f"{b}.call_id"))
    free = calls.select("conv", "call_id").alias("c").join(waiting.alias("w"), same("c", "w"), "left_anti")
    settled = [cut(free.withColumn("level", F.lit(0)))]
    for k in itertools.count(1):
        if waiting.limit(1).count() == 0 or settled[-1].limit(1).count() == 0:
            break
        if max_rounds is not None and k > max_rounds:
            raise RuntimeError(f"levels are not settled after {max_rounds} rounds")
        news, n = settled[-1].alias("d"), needs.alias("n")
        met = n.join(news, F.col("n.conv").eqNullSafe(F.col("d.conv")) & (F.col("n.need") == F.col("d.call_id"))).groupBy("n.conv", "n.call_id").agg(F.count(F.lit(1)).alias("met"))
        after = waiting.alias("w").join(met.alias("m"), same("w", "m"), "left").select("w.conv", "w.call_id", (F.col("left") - F.coalesce("met", F.lit(0))).alias("left"))
        after = cut(after)
        settled.append(after.where("left = 0").select("conv", "call_id", F.lit(k).alias("level")))  # its last need came in the round before, so no need is deeper
        waiting = after.where("left > 0")
    return functools.reduce(DataFrame.unionByName, settled)


def link(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tools: dict | None = None, max_rounds: int | None = None) -> DataFrame:
    """conv, turn, seq, role, kind, call_id, status, problem, level, json: a row per turn, call and result."""
    tools = TOOLS if tools is None else tools
    parsed = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.posexplode(_parser(tools)(F.col(role_col), F.col(text_col))).alias("seq", "e")
    )
    rows = cut(parsed.select("conv", "turn", "role", "seq", "e.*"))
    tool = rows.where("call_id is not null")
    place = F.struct("turn", "seq", "json")
    is_call = F.col("kind") == "call"
    by_id = cut(
        tool.groupBy("conv", "call_id").agg(
            F.min(F.when(is_call, place)).alias("first_call"),
            F.min(F.when(~is_call, place)).alias("first_result"),
            F.min_by(F.when(is_call, F.col("needs")), F.when(is_call, place)).alias("needs"),
        )
    )
    called = by_id.where("first_call is not null")
    levels = _levels(called.select("conv", "call_id", "needs"), max_rounds)
    b, v = by_id.alias("b"), levels.alias("v")
    keyed = b.join(v, F.col("b.conv").eqNullSafe(F.col("v.conv")) & (F.col("b.call_id") == F.col("v.call_id")), "left").select(
        F.col("b.conv").alias("k_conv"), F.col("b.call_id").alias("k_id"), "first_call", "first_result", F.col("v.level").alias("depth")
    )
    joined = tool.join(keyed, F.col("conv").eqNullSafe(F.col("k_conv")) & (F.col("call_id") == F.col("k_id")))
    own = F.when(is_call, F.col("first_call")).otherwise(F.col("first_result"))
    status = (
        F.when(place != own, "duplicate")
        .when(F.col("first_call").isNull(), "orphan")
        .when(~is_call & (place < F.col("first_call")), "early")
        .when(F.col("depth").isNull(), "cycle")
        .when(is_call & F.col("problem").isNotNull(), "invalid")
        .when(F.col("first_result").isNull(), "unanswered")
        .otherwise("linked")
    )
    level = F.when(F.col("depth").isNotNull(), 2 * F.col("depth") + F.when(is_call, 1).otherwise(2))
    out = ("conv", "turn", "seq", "role", "kind", "call_id")
    linked = joined.select(*out, status.alias("status"), "problem", level.alias("level"), "json")
    plain = rows.where("call_id is null").select(*out, F.lit("plain").alias("status"), "problem", F.lit(0).alias("level"), "json")
    return plain.unionByName(linked)
