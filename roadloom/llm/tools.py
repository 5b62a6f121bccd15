"""Chat formatting: tool calls linked to their results.

Calls and results meet in a hash join on conversation and identifier. Arguments are parsed and validated
against the schema of the tool's name; references in them ({"$ref": identifier}) order the calls of a
conversation: a call comes after those it refers to, by levels found round by round over all conversations at
once. Places within a conversation are numbered over a range-partitioned sort, so that a conversation of any
size is split among tasks. Each linked call is serialised as canonical JSON: sorted keys, no spaces, shortest numbers.

Defined results: rows without conversation or identifier, and results without a call, are reported as
`orphan`; of calls (or results) that share an identifier the smallest row counts, others are `repeated` (results without a turn);
turns without a role are `roleless`;
a call without a result is `unanswered`; one that refers to a missing call is `dangling`, one in or behind a
circle `cyclic` (both have no level and come last); null or unparsable arguments are not valid; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

KEY = ["conv_id", "call_id"]
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """Sorted keys, no spaces; whole floats as integers."""

    def plain(x):
        if isinstance(x, float) and x.is_integer() and abs(x) < 2**53:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return _sound(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _sound(text: str) -> str:
    """Text that UTF-8 can hold: lone surrogates as JSON escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        number = isinstance(value, int | float) and not isinstance(value, bool)
        return number and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, TYPES[kind])


def fault(value, schema: dict, at: str = "$") -> str | None:
    """The first way in which a value breaks its schema."""
    if "$ref" in value and len(value) == 1 if isinstance(value, dict) else False:
        return None  # stands for a result that is not known yet
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: not of type {kinds}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not one of the values"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            return f"{at}: length"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            return f"{at}: pattern"
    if _is(value, "number") and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return f"{at}: range"
    if isinstance(value, dict):
        if missing := [k for k in schema.get("required", []) if k not in value]:
            return f"{at}: {missing[0]} is missing"
        known = schema.get("properties", {})
        for k in sorted(value):
            if k in known:
                if found := fault(value[k], known[k], f"{at}.{k}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{at}: {k} is unknown"
    if isinstance(value, list):
        for k, x in enumerate(value if "items" in schema else []):
            if found := fault(x, schema["items"], f"{at}[{k}]"):
                return found
    return None


def references(value) -> list[str]:
    """Identifiers that a value refers to."""
    out, stack = set(), [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if len(x) == 1 and isinstance(x.get("$ref"), str):
                out.add(x["$ref"])
            stack += x.values()
        elif isinstance(x, list):
            stack += x
    return sorted(out)


def _checker(schemas: dict[str, dict]):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for call_id, name, arguments, result in zip(*(batch.column(k).to_pylist() for k in ("call_id", "name", "arguments", "result")), strict=True):
                try:
                    value = json.loads(arguments or "")
                    error = fault(value, schemas[name]) if name in schemas else "no such tool"
                    line = canonical({"arguments": value, "id": call_id, "name": name, "result": result})
                except (ValueError, RecursionError):
                    value, error = None, "not JSON"
                    line = canonical({"arguments": None, "id": call_id, "name": name, "result": result})
                rows.append((error and _sound(error), [_sound(x) for x in references(value)], line))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            kinds = {"error": pa.string(), "after": pa.list_(pa.string()), "json": pa.string()}
            keep = [c for c in batch.schema.names if c not in ("arguments", "result")]
            made = [pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, *kinds])

    return check


def _levels(calls: DataFrame, root: str) -> DataFrame:
    """conv_id, call_id, level, state: a level for every call whose references all have one."""
    edges = calls.select(*KEY, F.explode("after").alias("needs"))
    edges = common.store(edges, "edges", root)
    target = calls.select("conv_id", F.col("call_id").alias("needs"), F.lit(True).alias("there"))
    missing = edges.join(target, ["conv_id", "needs"], "left").where("there is null").select(*KEY).distinct()
    needs = edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("needed"))
    every = calls.select(*KEY).join(needs, KEY, "left").join(missing.withColumn("dangling", F.lit(True)), KEY, "left")
    every = common.store(every, "every", root)
    spark = calls.sparkSession
    fresh = common.store(every.where("needed is null").select(*KEY, F.lit(0).alias("level")), "levels/0", root)
    left = every.where("needed is not null and dangling is null").select(*KEY, F.col("needed").alias("left"), F.lit(0).alias("top"))
    left, step = common.store(left, "left0", root), 0
    while not fresh.isEmpty():
        step += 1
        # only calls of the last round, and only those that still wait
        met = fresh.withColumnRenamed("call_id", "needs").join(edges, ["conv_id", "needs"]).groupBy(*KEY).agg(F.count(F.lit(1)).alias("met"), F.max("level").alias("level"))
        told = left.join(met, KEY, "left").select(*KEY, (F.col("left") - F.coalesce("met", F.lit(0))).alias("left"), F.greatest("top", F.coalesce("level", F.lit(0))).alias("top"))
        told = common.store(told, f"told{step}", root)
        fresh = common.store(told.where("left = 0").select(*KEY, (F.col("top") + 1).alias("level")), f"levels/{step}", root)
        left = common.store(told.where("left > 0"), f"left{step}", root)
        common.forget(spark, root, f"told{step}", f"left{step - 1}")
    done = spark.read.schema("conv_id long, call_id string, level int").parquet(*(f"{root}/levels/{k}" for k in range(step + 1)))
    state = F.when(F.col("level").isNotNull(), F.lit("ordered")).when(F.col("dangling"), F.lit("dangling")).otherwise(F.lit("cyclic"))
    return every.join(done, KEY, "left").select(*KEY, "level", state.alias("state"))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running places within a conversation and task; the rows come sorted."""
    before, at, part = None, 0, TaskContext.get().partitionId()
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(batch.schema.names.index("conv_id")).to_numpy()
        new = np.ones(len(conv), dtype=bool)
        new[1:] = conv[1:] != conv[:-1]
        start = np.flatnonzero(new)
        place = np.arange(len(conv)) - np.repeat(start, np.diff(np.append(start, len(conv))))
        if conv[0] == before:
            first = int(start[1]) if len(start) > 1 else len(conv)
            place[:first] += at
        before, at = conv[-1], int(place[-1]) + 1
        made = [pa.array(place), pa.array(np.full(len(conv), part))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "place", "part"])


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], root: str | None = None) -> DataFrame:
    """Calls (conv_id, call_id, turn, name, arguments) and results (conv_id, call_id, content) to rows
    conv_id, call_id, turn, position, level, status, error, json."""
    root = root or common.shared_dir(calls.sparkSession)
    calls = calls.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"), F.col("turn").cast("long").alias("turn"), "name", "arguments")
    results = results.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"), "content")
    named = "conv_id is not null and call_id is not null"
    own = calls.where(named).groupBy(*KEY).agg(F.min(F.struct("turn", "name", "arguments")).alias("c"), F.count(F.lit(1)).alias("n"))
    answers = results.where(named).groupBy(*KEY).agg(F.min("content").alias("result"), F.lit(True).alias("answered"), F.count(F.lit(1)).alias("m"))
    joined = own.join(answers.hint("shuffle_hash"), KEY, "left").select(*KEY, "c.*", "n", "result", "answered")
    kinds = "conv_id long, call_id string, turn long, name string, n long, answered boolean, error string, after array<string>, json string"
    checked = joined.select(*KEY, "turn", "name", "n", "answered", "arguments", "result").mapInArrow(_checker(schemas), kinds)
    checked = common.store(checked, "calls", root)
    ordered = checked.join(_levels(checked, root), KEY)
    last = F.coalesce("level", F.lit(2**31 - 1))
    ordered = ordered.withColumn("rank", last)
    order = ["conv_id", "rank", "turn", "call_id"]
    spread = ordered.select(*KEY, "turn", "level", "rank", "state", "answered", "n", "error", "json").repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = "conv_id long, call_id string, turn long, level int, rank int, state string, answered boolean, n long, error string, json string, place long, part long"
    placed = common.store(spread.mapInArrow(_number, kinds), "placed", root)
    counts = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("rows"))
    window = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv_id", "part", F.coalesce(F.sum("rows").over(window), F.lit(0)).alias("offset"))
    status = F.when(F.col("state") != "ordered", F.col("state")).when(F.col("answered"), F.lit("answered")).otherwise(F.lit("unanswered"))
    columns = ["conv_id", "call_id", "turn", "position", "level", "status", "error", "json"]
    linked = placed.join(offsets, ["conv_id", "part"]).select(*KEY, "turn", (F.col("place") + F.col("offset")).alias("position"), "level", status.alias("status"), "error", "json", "n")
    none = lambda kind: F.lit(None).cast(kind)
    empty = [none("long").alias("position"), none("int").alias("level")]
    again = linked.where("n > 1").select(*KEY, "turn", F.explode(F.sequence(F.lit(2).cast("long"), "n")), *empty, F.lit("repeated").alias("status"), none("string").alias("error"), none("string").alias("json")).drop("col")
    nameless = calls.where(f"not ({named})").select(*KEY, "turn", *empty, F.lit("orphan").alias("status"), none("string").alias("error"), none("string").alias("json"))
    stray = results.where(f"not ({named})").select(*KEY).unionAll(results.where(named).join(own, KEY, "left_anti").select(*KEY))
    stray = stray.select(*KEY, none("long").alias("turn"), *empty, F.lit("orphan").alias("status"), none("string").alias("error"), none("string").alias("json"))
    # surplus results of a call; of those without one every row is an orphan
    surplus = answers.where("m > 1").join(own.select(*KEY), KEY, "left_semi")
    surplus = surplus.select(*KEY, none("long").alias("turn"), F.explode(F.sequence(F.lit(2).cast("long"), "m")), *empty, F.lit("repeated").alias("status"), none("string").alias("error"), none("string").alias("json")).drop("col")
    again = again.unionAll(surplus)
    return linked.select(*columns).unionAll(again.select(*columns)).unionAll(nameless.select(*columns)).unionAll(stray.select(*columns))


TEXT = {"type": "string", "minLength": 1}
SCHEMAS = {
    "ask": {
        "type": "object",
        "properties": {"text": TEXT, "turn": {"type": "integer", "minimum": 0}, "after": {"type": "array", "items": {"type": "object", "required": ["$ref"]}}},
        "required": ["text", "turn"],
        "additionalProperties": False,
    },
    "configure": {"type": "object", "properties": {"text": TEXT}, "required": ["text"]},
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every user and system turn as a tool call that refers to the call half as far into the conversation,
    and every assistant turn as the result of the call of the turn before it."""
    number = lambda t: F.format_string("%d:%d", "conv_id", t)
    refers = F.when(F.col("turn") > 1, F.array(F.struct(number(F.floor(F.col("turn") / 4) * 2).alias("$ref"))))
    arguments = F.when(F.col("role") == "system", F.to_json(F.struct("text"))).otherwise(F.to_json(F.struct("text", "turn", refers.alias("after"))))
    name = F.when(F.col("role") == "system", F.lit("configure")).otherwise(F.lit("ask"))
    calls = conversations.where("role <> 'assistant'").select("conv_id", number(F.col("turn")).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"))
    results = conversations.where("role = 'assistant'").select("conv_id", number(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def roleless(conversations: DataFrame) -> DataFrame:
    """A row of the columns of `link` for every turn without a role, which is neither call nor result."""
    none = lambda kind: F.lit(None).cast(kind)
    turn = F.col("turn").cast("long")
    own = [F.col("conv_id").cast("long").alias("conv_id"), F.format_string("%d:%d", "conv_id", "turn").alias("call_id"), turn.alias("turn")]
    return conversations.where("role is null").select(
        *own, none("long").alias("position"), none("int").alias("level"), F.lit("roleless").alias("status"), none("string").alias("error"), none("string").alias("json")
    )


def op7_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as calls and results (`calls_of`); every turn has a row, whatever is null in it."""
    conversations = common.table(spark, sf_dir, "conversations")
    return link(*calls_of(conversations), SCHEMAS).unionAll(roleless(conversations))
