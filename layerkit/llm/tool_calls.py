"""Operator 2: tool calls of conversations, linked, ordered, validated and written as canonical JSON.

Calls stand in the text of a message as ``<tool_call>{...}</tool_call>`` with
``id``, ``name``, ``arguments`` and, if they wait for other calls, their ids in
``after``; results as ``<tool_response>{"id": ..., "content": ...}</tool_response>``.
"""

from __future__ import annotations

import json
import math
import re
from collections import deque
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from layerkit.llm.common import map_arrow
from layerkit.session import stage

_TAGS = ("tool_call", "tool_response")
_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": (int, float),
}


def _number(value: float) -> str:
    """The one form of a number: whole ones as digits without a point; others by their shortest decimals, below 1e-6 with an exponent."""
    if not math.isfinite(value):
        raise ValueError("not a JSON number")
    if value.is_integer():
        return format(Decimal(repr(value or 0.0)).to_integral_value(), "f")
    if abs(value) >= 1e-6:
        return format(Decimal(repr(value)), "f")
    mantissa, exponent = repr(value).split("e")
    return f"{mantissa}e-{exponent.lstrip('-0')}"


def canonical(value) -> str:
    """JSON with sorted keys, no white space, and one form for equal numbers; other text as it is."""
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def schema_faults(value, schema: dict, place: str = "") -> list[str]:
    """Where a value breaks a JSON schema, in the order of the schema's words.

    Knows type, enum, required, properties, additionalProperties (false), items,
    minimum, maximum, minLength, maxLength, pattern, minItems and maxItems.
    """
    at = place or "/"
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fits = [
            isinstance(value, _TYPES[k]) and (k == "boolean" or not isinstance(value, bool))
            and (k != "integer" or isinstance(value, int) or value.is_integer()) for k in kinds
        ]
        if not any(fits):
            return [f"{at}: not {' or '.join(kinds)}"]
    faults = []
    if "enum" in schema and not any(canonical(value) == canonical(e) for e in schema["enum"]):
        faults.append(f"{at}: not listed")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        faults += [f"{place}/{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            faults += [f"{place}/{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(value):
            if k in known:
                faults += schema_faults(value[k], known[k], f"{place}/{k}")
    elif isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            faults.append(f"{at}: number of items")
        if "items" in schema:
            faults += [f for i, v in enumerate(value) for f in schema_faults(v, schema["items"], f"{place}/{i}")]
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            faults.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            faults.append(f"{at}: pattern")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
            faults.append(f"{at}: range")
    return faults


_DECODER = json.JSONDecoder()


def blocks_of(text: str, tag: str) -> list[str]:
    """JSON texts of the blocks of one kind. A tag inside a JSON string is part of it; what is no JSON ends at the next end tag."""
    start, end, out, at = f"<{tag}>", f"</{tag}>", [], 0
    while (at := text.find(start, at)) >= 0:
        at += len(start)
        begin = at + len(text[at:]) - len(text[at:].lstrip()) if text[at : at + 1].isspace() else at
        try:
            _, stop = _DECODER.raw_decode(text, begin)
            close = stop
            while text[close : close + 1].isspace():
                close += 1
            if not text.startswith(end, close):
                raise ValueError("more than JSON")
        except (ValueError, RecursionError):
            stop = close = text.find(end, at)
            if stop < 0:
                break
        out.append(text[at:stop])
        at = close + len(end)
    return out


def _blocks(messages: DataFrame) -> DataFrame:
    """Each block of both kinds: conversation, turn, ``tag``, place among those of its kind in the message, JSON text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, tags, places, texts = [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for tag in _TAGS:
                for place, block in enumerate(blocks_of(text, tag) if text else []):
                    rows.append(i)
                    tags.append(tag)
                    places.append(place)
                    texts.append(block)
        at = pa.array(rows, pa.int64())
        columns = [batch.column("conv_id").take(at), batch.column("turn").take(at), pa.array(tags, pa.string()), pa.array(places, pa.int32()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "tag", "place", "json"])

    return map_arrow(messages, run, "conv_id long, turn long, tag string, place int, json string")


def _field(name: str) -> Column:
    return F.get_json_object("json", f"$.{name}")


def link_calls(messages: DataFrame) -> DataFrame:
    """Every call with its result, joined by conversation and identifier.

    ``messages`` has ``conv_id``, ``turn``, ``text``. Returns ``conv_id``, ``turn``,
    ``place``, ``call_id``, ``name``, ``arguments``, ``after``, ``result_turn``,
    ``content`` and ``status``: ``linked``; ``no_result``; ``malformed`` for a call
    without id, name or JSON; ``repeated`` for a call whose id an earlier call of the
    conversation has. The first result behind the call counts. Results are
    reduced to one row per identifier and call before the join, so a hot
    identifier never multiplies. Null texts hold no calls; messages without a
    conversation or turn are left out; a repeated message row counts once. Of calls
    that share turn, place and id, as other messages of the same turn may bring
    them, the one with the smallest hash comes first and the others are ``repeated``.
    """
    known = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("text").cast("string")).where(
        "conv_id is not null and turn is not null"
    )
    found = stage(_blocks(known).distinct(), "blocks")
    calls = found.where("tag = 'tool_call'").select(
        "conv_id", "turn", "place", F.xxhash64("json").alias("tie"), _field("id").alias("call_id"), _field("name").alias("name"),
        F.coalesce(_field("arguments"), F.lit("{}")).alias("arguments"),
        F.from_json(F.coalesce(_field("after"), F.lit("[]")), "array<string>").alias("after"),
    )
    sound = F.col("call_id").isNotNull() & F.col("name").isNotNull()
    calls = stage(calls.withColumn("sound", sound), "tool-calls")
    at = F.struct("turn", "place", "tie")
    first = calls.where("sound").groupBy("conv_id", "call_id").agg(F.min(at).alias("first"))
    results = found.where("tag = 'tool_response'").select(
        "conv_id", _field("id").alias("call_id"), F.struct("turn", "place").alias("at"), _field("content").alias("content"),
    )
    behind = results.where("call_id is not null").join(first, ["conv_id", "call_id"]).where(
        F.col("at") > F.struct(F.col("first.turn").alias("turn"), F.col("first.place").alias("place"))
    )
    answers = behind.groupBy("conv_id", "call_id").agg(F.min(F.struct("at", "content")).alias("answer"))
    linked = calls.join(first, ["conv_id", "call_id"], "left").join(answers, ["conv_id", "call_id"], "left")
    own = F.col("first") == at
    status = (
        F.when(~F.col("sound"), "malformed").when(~own, "repeated").when(F.col("answer").isNull(), "no_result").otherwise("linked")
    )
    return linked.select(
        "conv_id", "turn", "place", "call_id", "name", "arguments", F.when(F.col("sound"), F.col("after")).alias("after"),
        F.when(own, F.col("answer.at.turn")).alias("result_turn"), F.when(own, F.col("answer.content")).alias("content"), status.alias("status"),
    )


# Calls and waits of a conversation that one task orders; larger ones are ordered by joins.
ONE_TASK = 50_000


def ordered_in_task(calls: list[tuple[str, int, list[str] | None]]) -> dict[str, tuple[int, int]]:
    """``step`` and ``depth`` by identifier, for calls as (identifier, own place, identifiers waited for)."""
    own = {c: at for c, at, _ in calls}
    needs = {c: {n for n in after or [] if n in own} for c, _, after in calls}
    waiting: dict[str, list[str]] = {}
    for c, found in needs.items():
        for n in found:
            waiting.setdefault(n, []).append(c)
    step: dict[str, int] = {}
    # From the last call backwards, all that wait for a call, over any number of others, get its place.
    for c in sorted(own, key=own.get, reverse=True):
        reached = [c] if c not in step else []
        while reached:
            x = reached.pop()
            if x not in step:
                step[x] = own[c]
                reached += [w for w in waiting.get(x, ()) if w not in step]
    within = {c: sum(step[n] == step[c] for n in needs[c]) for c in own}
    depth = {c: 0 for c, n in within.items() if not n}
    ready = deque(depth)
    while ready:
        c = ready.popleft()
        for w in waiting.get(c, ()):
            if step[w] == step[c]:
                within[w] -= 1
                if not within[w]:
                    # The last of its needs in order of depth frees it.
                    depth[w] = depth[c] + 1
                    ready.append(w)
    return {c: (step[c], depth.get(c, -1)) for c in own}


def _order_small(taking: DataFrame) -> DataFrame:
    """Steps and depths of conversations that fit one task."""
    grouped = taking.groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "own", "after")).alias("calls"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        convs, ids, steps, depths = [], [], [], []
        for conv, calls in zip(batch.column("conv_id").to_pylist(), batch.column("calls").to_pylist()):
            for call_id, (step, depth) in ordered_in_task([(c["call_id"], c["own"], c["after"]) for c in calls]).items():
                convs.append(conv)
                ids.append(call_id)
                steps.append(step)
                depths.append(depth)
        columns = [pa.array(convs, pa.int64()), pa.array(ids, pa.string()), pa.array(steps, pa.int64()), pa.array(depths, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "call_id", "step", "depth"])

    return map_arrow(grouped, run, "conv_id long, call_id string, step long, depth int")


def _order_large(taking: DataFrame) -> DataFrame:
    """Steps and depths by rounds of joins, until no call moves: as many rounds as the longest chain of waits has calls."""
    nodes = taking.select("conv_id", "call_id", "own")
    waits = taking.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("needs")).where("needs is not null")
    edges = waits.join(nodes.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"])
    steps = stage(nodes.withColumn("step", F.col("own")), "steps")
    edges = stage(edges.select("conv_id", "call_id", "needs"), "waits")
    while True:
        theirs = steps.select("conv_id", F.col("call_id").alias("needs"), F.col("step").alias("their_step"))
        raised = edges.join(theirs, ["conv_id", "needs"]).groupBy("conv_id", "call_id").agg(F.max("their_step").alias("raised"))
        moved = stage(raised.join(steps, ["conv_id", "call_id"]).where("raised > step").select("conv_id", "call_id", "raised"), "raised")
        if moved.isEmpty():
            break
        steps = stage(steps.join(moved, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "own", F.greatest("step", "raised").alias("step")), "steps")
    # Within a step: a call that waits for one of the same step comes behind it.
    theirs = steps.select("conv_id", F.col("call_id").alias("needs"), F.col("step").alias("their_step"))
    within = edges.join(theirs, ["conv_id", "needs"]).join(steps.select("conv_id", "call_id", "step"), ["conv_id", "call_id"]).where("step = their_step")
    within = stage(within.select("conv_id", "call_id", "needs"), "within")
    left = stage(within.select("conv_id", "call_id").distinct(), "left")
    done, depth = steps.join(left, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).alias("depth")), 0
    while True:
        depth += 1
        waiting = within.join(left, ["conv_id", "call_id"], "left_semi")
        blocked = waiting.join(left.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi").select("conv_id", "call_id").distinct()
        placed = stage(left.join(blocked, ["conv_id", "call_id"], "left_anti").withColumn("depth", F.lit(depth)), "depths")
        if placed.isEmpty():
            break
        done = stage(done.unionByName(placed), "done")
        left = stage(left.join(placed, ["conv_id", "call_id"], "left_anti"), "left")
    done = done.unionByName(left.withColumn("depth", F.lit(-1)))
    return steps.select("conv_id", "call_id", "step").join(done, ["conv_id", "call_id"])


def order_calls(linked: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``linked`` with ``step`` and ``depth``: (step, depth, turn, place) is a topological order of each conversation.

    Calls come in the order they were made unless one waits for a later one.
    ``step`` is the last turn and place among a call and all it waits for; calls
    that wait within a step follow by ``depth``. Conversations of up to ``one_task``
    calls and waits are ordered in one task each; larger ones by joins on
    identifiers, in rounds that run until nothing moves, so no conversation has to
    fit one task and no chain is too long. Calls in a cycle, or that wait for one within its
    step, have the depth -1. Identifiers that no call has are ignored.
    """
    linked = stage(linked, "linked-calls")
    taking = linked.where("status in ('linked', 'no_result')").withColumn("own", F.col("turn") * (1 << 20) + F.col("place"))
    sizes = taking.groupBy("conv_id").agg(F.sum(F.lit(1) + F.coalesce(F.size("after"), F.lit(0))).alias("n"))
    large = stage(sizes.where(F.col("n") > one_task).select("conv_id"), "large-conversations")
    asked = taking.select("conv_id", "call_id", "own", "after")
    if large.isEmpty():
        order = _order_small(asked)
    else:
        order = _order_small(asked.join(large, "conv_id", "left_anti")).unionByName(_order_large(stage(asked.join(large, "conv_id", "left_semi"), "large-calls")))
    taking = taking.drop("own").join(order, ["conv_id", "call_id"], "left")
    rest = linked.where("status not in ('linked', 'no_result')").withColumn("step", F.lit(None).cast("long")).withColumn("depth", F.lit(None).cast("int"))
    return taking.unionByName(rest)


def check_arguments(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``calls`` with ``canonical``, the arguments as canonical JSON, and ``faults`` against the schema of their tool.

    Arguments that are no JSON have a null canonical form and one fault; a tool without a schema is a fault.
    """
    names = [*calls.columns, "canonical", "faults"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, faults = [], []
        for name, arguments in zip(batch.column("name").to_pylist(), batch.column("arguments").to_pylist()):
            try:
                value = json.loads(arguments)
                texts.append(canonical(value))
            except (TypeError, ValueError, RecursionError):
                texts.append(None)
                faults.append(["/: not JSON"])
                continue
            faults.append(schema_faults(value, schemas[name]) if name in schemas else ["/: unknown tool"])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(faults, pa.list_(pa.string()))], names=names)

    schema = ", ".join(f"`{c}` {kind}" for c, kind in calls.dtypes)
    return map_arrow(calls, run, f"{schema}, canonical string, faults array<string>")


def tool_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls linked, ordered and validated, one row per call."""
    return check_arguments(order_calls(link_calls(messages)), schemas)
