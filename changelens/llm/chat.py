"""Chat formatting: links tool calls with their results and serialises every message as canonical JSON.

A message of the assistant whose text is a JSON object with ``tool_calls`` (a list of ``{"id", "name", "arguments"}``, arguments an object or its
JSON text) makes calls; a message of the role ``tool`` whose text is a JSON object with ``tool_call_id`` brings a result. Calls and results meet in a
hash join on (conversation, identifier), so a conversation of any length is spread over tasks and never gathered. Messages are parsed twice: once for calls and
results, which are kept for the joins, and once for the plain ones, which pass by. Each message carries its place:
conversations read in the order of (``order_turn``, ``order_rank``, ``turn``), in which a result never stands before its call.

Calls of one message that use each other's results (an argument string ``$id``) are put in topological order inside the message.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Mapping
from graphlib import CycleError, TopologicalSorter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import materialize

PARSED = "kind string, content string, result_of string, calls array<struct<id:string,name:string,arguments:string,valid:boolean,problem:string>>, cyclic boolean"
TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}
REFERENCE = re.compile(r"\$([\w-]+)")


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and unescaped text; whole floats are written as integers."""

    def plain(v):
        if isinstance(v, float) and math.isfinite(v) and v == int(v) and abs(v) < 2**53:
            return int(v)
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def problem_of(value, schema: Mapping, at: str = "$") -> str | None:
    """The first place where a value breaks a schema (``type``, ``enum``, ``required``, ``properties``, ``additionalProperties``, ``items``, bounds)."""
    kind = schema.get("type")
    kinds = kind if isinstance(kind, list) else [kind] if kind else []
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kinds and not any(
        number and (k == "number" or k == "integer" and value == int(value)) if k in ("number", "integer") else isinstance(value, TYPES.get(k, object)) for k in kinds
    ):
        return f"{at}: type"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: enum"
    if number and (value < schema.get("minimum", value) or value > schema.get("maximum", value)):
        return f"{at}: bounds"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for key in schema.get("required", ()):
            if key not in value:
                return f"{at}.{key}: required"
        for key in sorted(value):
            if key in known:
                if found := problem_of(value[key], known[key], f"{at}.{key}"):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{at}.{key}: not allowed"
    if isinstance(value, list) and isinstance(schema.get("items"), Mapping):
        for i, item in enumerate(value):
            if found := problem_of(item, schema["items"], f"{at}[{i}]"):
                return found
    return None


def _object(text) -> dict | None:
    if not isinstance(text, str) or not text.lstrip().startswith("{"):
        return None
    try:
        found = json.loads(text, parse_constant=lambda name: None)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _call(item, schemas: Mapping[str, Mapping]) -> dict:
    item = item if isinstance(item, dict) else {}
    arguments, problem = item.get("arguments"), None
    if isinstance(arguments, str):
        try:
            arguments = json.loads(arguments)
        except (ValueError, RecursionError):
            problem = "$: not JSON"
    name = item.get("name")
    schema = schemas.get(name) if isinstance(name, str) else None
    if problem is None and not isinstance(arguments, dict):
        problem = "$: type"
    if problem is None and schema is not None:
        problem = problem_of(arguments, schema)
    return {
        "id": None if item.get("id") is None else str(item["id"]), "name": None if name is None else str(name),
        "arguments": canonical(arguments), "valid": False if problem else None if schema is None else True, "problem": problem,
    }


def _ordered(calls: list[dict]) -> tuple[list[dict], bool]:
    """Calls after those whose results they use, else as they came; a cycle leaves them as they came."""
    place = {c["id"]: i for i, c in reversed(list(enumerate(calls))) if c["id"] is not None}
    graph = TopologicalSorter({i: {place[r] for r in REFERENCE.findall(c["arguments"]) if r in place and place[r] != i} for i, c in enumerate(calls)})
    out: list[dict] = []
    try:
        graph.prepare()
    except CycleError:
        return calls, True
    ready: list[int] = []
    while graph.is_active():
        ready = sorted([*ready, *graph.get_ready()])
        first = ready.pop(0)
        out.append(calls[first])
        graph.done(first)
    return out, False


def parse(messages: DataFrame, schemas: Mapping[str, Mapping] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message with its kind (``text``, ``calls`` or ``result``), content and calls."""
    schemas = dict(schemas or {})

    @F.pandas_udf(PARSED)
    def rows(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for roles, said_texts in batches:
            out = []
            for role, text in zip(roles, said_texts, strict=True):
                said = _object(text) if role in ("assistant", "tool") else None
                if role == "assistant" and said and isinstance(said.get("tool_calls"), list) and said["tool_calls"]:
                    calls, cyclic = _ordered([_call(item, schemas) for item in said["tool_calls"]])
                    out.append(("calls", canonical(said.get("content")), None, calls, cyclic))
                elif role == "tool" and said and said.get("tool_call_id") is not None:
                    out.append(("result", canonical(said.get("content")), str(said["tool_call_id"]), [], False))
                else:
                    out.append(("text", canonical(text if isinstance(text, str) else None), None, [], False))
            yield pd.DataFrame(out, columns=["kind", "content", "result_of", "calls", "cyclic"])

    picked = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return picked.select("conv_id", "turn", "role", rows("role", "text").alias("m")).select("conv_id", "turn", "role", "m.*")


def format_chat(messages: DataFrame, schemas: Mapping[str, Mapping] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per message: ``conv_id``, ``turn``, ``order_turn``, ``order_rank``, ``kind``, ``status``, ``n_calls``, ``n_invalid`` and ``message`` (canonical JSON).

    ``status``: a result is ``linked``, ``orphan`` (no call with its identifier) or ``repeated`` (an earlier result answered the call); a message with
    calls is ``answered`` if each of them is linked, else ``open``, or ``cyclic`` if its calls use each other; other messages are ``plain``. Of several
    calls with one identifier in a conversation the first by turn counts, of one message's the first in order. ``n_invalid`` counts calls whose
    arguments break their tool's schema or are no object; tools without a schema are not judged beyond that. A null conversation or identifier links
    with nothing; a null text is the content ``null``, a null role the role ``null``; text that is not the JSON described is plain text. Repeated
    rows are messages each; an empty table gives an empty result; other columns are not read.
    """
    every = parse(messages, schemas, conv_col, turn_col, role_col, text_col)
    parsed = materialize(every.filter("kind <> 'text'"))
    call = parsed.filter("kind = 'calls' AND conv_id IS NOT NULL").select("conv_id", "turn", F.posexplode("calls").alias("at", "call")).filter("call.id IS NOT NULL")
    first_call = call.groupBy("conv_id", F.col("call.id").alias("result_of")).agg(F.min(F.struct("turn", "at", "call.name")).alias("c"))
    first_result = parsed.filter("kind = 'result' AND conv_id IS NOT NULL").groupBy("conv_id", "result_of").agg(F.min("turn").alias("first_turn"))
    linked = first_call.join(first_result, ["conv_id", "result_of"], "full").select(
        "conv_id", "result_of", F.col("c.turn").alias("call_turn"), F.col("c.at").alias("call_at"), F.col("c.name").alias("call_name"), "first_turn"
    )
    answers = linked.filter("call_turn IS NOT NULL AND first_turn IS NOT NULL").groupBy("conv_id", F.col("call_turn").alias("turn")).agg(F.count("*").alias("answered"))
    plain = every.filter("kind = 'text'").select("*", F.lit("plain").alias("status"), F.col("turn").alias("order_turn"), F.lit(0).alias("order_rank"), F.lit(None).cast("string").alias("call_name"))
    calls = parsed.filter("kind = 'calls'").join(answers, ["conv_id", "turn"], "left").select(
        *parsed.columns, F.when(F.col("cyclic"), "cyclic").when(F.coalesce("answered", F.lit(0)) >= F.size("calls"), "answered").otherwise("open").alias("status"),
        F.col("turn").alias("order_turn"), F.lit(0).alias("order_rank"), F.lit(None).cast("string").alias("call_name"),
    )
    results = parsed.filter("kind = 'result'").join(linked, ["conv_id", "result_of"], "left").select(
        *parsed.columns, F.when(F.col("call_turn").isNull(), "orphan").when(F.col("turn") > F.col("first_turn"), "repeated").otherwise("linked").alias("status"),
        F.greatest("turn", "call_turn").alias("order_turn"), F.when(F.col("call_turn") >= F.col("turn"), F.col("call_at") + 1).otherwise(0).alias("order_rank"), "call_name",
    )
    joined = plain.unionByName(calls).unionByName(results)
    return joined.select(
        "conv_id", "turn", "order_turn", "order_rank", "kind", "status", F.size("calls").cast("long").alias("n_calls"),
        F.size(F.filter("calls", lambda c: ~F.coalesce(c["valid"], F.lit(True)))).cast("long").alias("n_invalid"), _message().alias("message"),
    )


def _message():
    """Canonical JSON of a message: its keys in order, each with text that is canonical already."""
    quoted = lambda column: F.when(column.isNotNull(), _quote(column)).otherwise("null")
    call = lambda c: F.concat(F.lit('{"arguments":'), c["arguments"], F.lit(',"id":'), quoted(c["id"]), F.lit(',"name":'), quoted(c["name"]), F.lit("}"))
    calls = F.when(F.col("kind") == "calls", F.concat(F.lit(',"tool_calls":['), F.array_join(F.transform("calls", call), ","), F.lit("]"))).otherwise("")
    name = F.when(F.col("kind") == "result", F.concat(F.lit(',"name":'), quoted(F.col("call_name")))).otherwise("")
    result = F.when(F.col("kind") == "result", F.concat(F.lit(',"tool_call_id":'), quoted(F.col("result_of")))).otherwise("")
    return F.concat(F.lit('{"content":'), F.col("content"), name, F.lit(',"role":'), quoted(F.col("role")), result, calls, F.lit("}"))


def _quote(column):
    """A JSON string of a short name; its quotes, backslashes and control characters are escaped as in the content."""
    return F.substring(F.to_json(F.struct(column.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(column.alias("v")))) - 6)
