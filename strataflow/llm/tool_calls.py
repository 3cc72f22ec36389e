"""Chat formatting: link tool calls to their results, order them and write canonical JSON.

Calls come from assistant messages (``{"tool_calls": [{"id", "name", "arguments"}]}``), results from tool
messages (``{"tool_call_id", "content"}``). They are hash-joined by (conversation, identifier). A call
depends on each call whose result its arguments quote as ``"$result:ID"``; calls are ordered by the length
of their longest chain of dependencies, then by turn and position. Arguments are checked against a schema
per tool, and each linked call becomes one line of canonical JSON (sorted keys, no spaces, no escapes).

Conversations are never gathered: a line carries its sort key (level, turn, position, then the line itself).

Defined cases: text that is not such JSON holds no calls; calls without result keep a null result; of
several results the earliest turn counts; results without call are left out; calls in or after a cycle have
a null level and status ``cyclic``; references to unknown calls make status ``unresolved``; calls equal
in all fields count once; other calls with one identifier all stay, with status ``ambiguous``, the level of their
longest chain and the identifier's result; calls without identifier stay, with status ``no id`` and no result; a
null conversation is one of its own; arguments that are no JSON (NaN and infinite numbers are none) or nested deeper than the
parser follows stay as text, with an error; lone surrogates are written as escapes; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.llm.common import NO_ID, stage

CALLS_JSON = "struct<tool_calls: array<struct<id: string, name: string, arguments: string>>>"
RESULT_JSON = "struct<tool_call_id: string, content: string>"
_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}


def check_arguments(arguments: dict, schema: dict | None) -> list[str]:
    """What is wrong with a call's arguments, in order; schema has ``properties`` (name -> type) and ``required``."""
    if schema is None:
        return ["unknown tool"]
    found = [f"missing {name}" for name in schema.get("required", ()) if name not in arguments]
    for name in sorted(arguments):
        kind = schema["properties"].get(name)
        if kind is None:
            found.append(f"unexpected {name}")
        elif not isinstance(arguments[name], _KINDS[kind]) or kind in ("integer", "number") and isinstance(arguments[name], bool):
            found.append(f"{name} is not {kind}")
    return found


_LONE = re.compile("[\ud800-\udfff]")


def escaped(text: str) -> str:
    """The text with lone surrogates, which no UTF-8 can hold, as their JSON escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """Sorted keys, no blanks; ValueError for NaN and infinite numbers, which are no JSON."""
    return escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


def parse_calls(messages: DataFrame) -> DataFrame:
    """conv_id, turn, pos, id, name, arguments (JSON text) and node of each call.

    The node is the identifier, or for calls without one a text that no reference can name.
    """
    parsed = messages.filter("role = 'assistant'").select(F.coalesce("conv_id", F.lit(NO_ID)).alias("conv_id"), "turn", F.from_json("text", CALLS_JSON).alias("j"))
    calls = (parsed.select("conv_id", "turn", F.posexplode("j.tool_calls").alias("pos", "c")).filter("c IS NOT NULL")
             .select("conv_id", "turn", "pos", "c.*").distinct())
    unnamed = F.concat(F.lit('"'), F.sha2(F.to_json(F.struct("turn", "pos", "name", "arguments")), 256))
    return calls.withColumn("node", F.coalesce("id", unnamed))


def parse_results(messages: DataFrame) -> DataFrame:
    """conv_id, id, result_turn, result: the earliest result of each identifier."""
    parsed = messages.filter("role = 'tool'").select(F.coalesce("conv_id", F.lit(NO_ID)).alias("conv_id"), "turn", F.from_json("text", RESULT_JSON).alias("j"))
    first = F.min(F.struct("turn", F.col("j.content").alias("content"))).alias("first")
    return (parsed.filter("j.tool_call_id IS NOT NULL").groupBy("conv_id", F.col("j.tool_call_id").alias("id")).agg(first)
            .select("conv_id", "id", F.col("first.turn").alias("result_turn"), F.col("first.content").alias("result")))


def call_levels(calls: DataFrame) -> DataFrame:
    """conv_id, id, level (0: no dependency; null: cyclic), unresolved: whether a reference names no call.

    One row per identifier: calls that share one have all their dependencies in common.
    """
    refs = F.array_distinct(F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(r'"\$result:([^"]+)"'), 1))
    edges = calls.select("conv_id", "id", F.explode(refs).alias("needs")).distinct()
    calls = stage(calls.select("conv_id", "id").distinct(), "call-ids")
    known = calls.select("conv_id", F.col("id").alias("needs"), F.lit(True).alias("known"))
    edges = stage(edges.join(known, ["conv_id", "needs"], "left"), "call-edges")
    lost = edges.filter("known IS NULL").select("conv_id", "id").distinct().withColumn("unresolved", F.lit(True))
    edges = edges.filter("known").select("conv_id", "id", "needs")
    ready = stage(calls.join(edges, ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    done, waiting, level = [ready], stage(edges, "call-edges"), 0
    while not waiting.isEmpty():  # one round per link of the longest chain; each reads only what still waits
        level += 1
        left = stage(waiting.join(ready.select("conv_id", F.col("id").alias("needs")).hint("merge"), ["conv_id", "needs"], "left_anti"), "call-edges")
        ready = waiting.select("conv_id", "id").distinct().join(left.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti").withColumn("level", F.lit(level))
        ready = stage(ready, "levels", done=(waiting,))
        if ready.isEmpty():
            break
        done.append(ready)
        waiting = left
    levels = stage(reduce(DataFrame.unionByName, done), "levels", done=tuple(done))
    return (calls.select("conv_id", "id").join(levels, ["conv_id", "id"], "left").join(lost, ["conv_id", "id"], "left")
            .withColumn("unresolved", F.coalesce("unresolved", F.lit(False))))


def link_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call: conv_id, level, turn, pos, call_id, result_turn, status, errors, line."""
    calls = stage(parse_calls(messages), "calls")
    results = parse_results(messages).withColumnRenamed("id", "node")
    levels = call_levels(calls.drop("id").withColumnRenamed("node", "id")).withColumnRenamed("id", "node")
    shared = calls.groupBy("conv_id", "node").agg((F.count(F.lit(1)) > 1).alias("ambiguous"))
    joined = calls.join(results.hint("shuffle_hash"), ["conv_id", "node"], "left").join(levels, ["conv_id", "node"]).join(shared, ["conv_id", "node"]).drop("node")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            lines, errors = [], []
            for call_id, name, raw, result in zip(part["id"], part["name"], part["arguments"], part["result"], strict=True):
                line = lambda value: canonical({"call": {"arguments": value, "id": call_id, "name": name}, "result": result})  # noqa: B023, E731
                try:
                    arguments = json.loads(raw, parse_constant=_no_number) if raw else {}
                    found = check_arguments(arguments, schemas.get(name)) if isinstance(arguments, dict) else ["arguments are no object"]
                    text = line(arguments)
                except ValueError:
                    text, found = line(raw), ["arguments are no JSON"]
                except RecursionError:
                    text, found = line(raw), ["arguments are nested too deep"]
                lines.append(text)
                errors.append(escaped("; ".join(found)))
            yield part.assign(line=lines, errors=errors)[[f.name for f in out.fields]]

    out = T.StructType([*(f for f in joined.schema.fields if f.name not in ("name", "arguments", "result")), T.StructField("errors", T.StringType()), T.StructField("line", T.StringType())])
    status = (F.when(F.col("id").isNull(), "no id").when(F.col("ambiguous"), "ambiguous").when(F.col("level").isNull(), "cyclic").when(F.col("unresolved"), "unresolved").when(F.col("errors") != "", "invalid")
              .when(F.col("result_turn").isNull(), "pending").otherwise("linked"))
    conv = F.when(F.col("conv_id") != NO_ID, F.col("conv_id")).alias("conv_id")
    return joined.mapInPandas(run, out).select(conv, "level", "turn", "pos", F.col("id").alias("call_id"), "result_turn", status.alias("status"), "errors", "line")


def format_chats(calls: DataFrame, path: str) -> None:
    """The lines of ``link_calls`` as text files, in order of conversation, level, turn and position.

    A sort by range of all keys: the lines of a long conversation are spread over several files that follow each other.
    """
    ordered = calls.orderBy("conv_id", F.col("level").asc_nulls_last(), "turn", "pos", "line")
    ordered.select(F.to_json(F.struct("conv_id", "level", "status", "line")).alias("value")).write.text(path)


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool traffic: a user turn is a call, the next turn's answer its result.

    A call quotes the result of the call two turns before it; every fourth one begins a new chain.
    """
    later = F.when(F.col("turn") % 8 > 1, F.concat(F.lit("$result:"), (F.col("turn") - 2).cast("string")))
    arguments = F.to_json(F.struct(F.col("text").alias("query"), later.alias("context"), F.when(F.col("turn") % 5 == 4, F.col("turn")).alias("depth")))
    call = F.to_json(F.struct(F.array(F.struct(F.col("turn").cast("string").alias("id"), F.when(F.col("turn") % 7 == 6, "lookup").otherwise("answer").alias("name"), arguments.alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct((F.col("turn") - 1).cast("string").alias("tool_call_id"), F.col("text").alias("content")))
    user = conversations.filter("role = 'user'").select("conv_id", "turn", F.lit("assistant").alias("role"), call.alias("text"))
    tool = conversations.filter("role = 'assistant'").select("conv_id", "turn", F.lit("tool").alias("role"), result.alias("text"))
    return user.unionByName(tool)


#: Schemas of the tools that ``as_tool_messages`` names.
TOOLS = {"answer": {"properties": {"query": "string", "context": "string", "depth": "integer"}, "required": ["query"]},
         "lookup": {"properties": {"query": "string", "depth": "integer"}, "required": ["query", "depth"]}}


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(as_tool_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")), TOOLS)
