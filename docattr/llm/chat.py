"""Chat formatting: linking tool calls with their results.

Messages (conv_id, turn, role, text) hold calls and results as JSON: an assistant's text is an object
with ``tool_calls`` (a list of id, name, arguments and, where a call waits for others, ``after``, their
id or a list of ids), a tool's text an object with ``tool_call_id`` and ``content``. Every call is joined with its
result by (conversation, identifier), ordered behind the calls it waits for, checked against its tool's
schema and written as one canonical JSON record; other messages are records of their own.

Calls that wait for one other form chains, and depth along them is found by pointer doubling: each round a call looks
at the pointer of its pointer, which takes logarithmically many rounds for a chain, and calls on a cycle are those that
never reach a root. Chains end at calls that wait for several; these take one more round for each such call on
the longest path, a call's level being one more than the highest it waits for. Records are ordered by (depth-respecting) ``level``, turn and place; no
conversation is ever gathered in one task, whatever its length.

Canonical JSON has sorted keys, no blanks, no escapes but the necessary ones, and no NaN.

Defined cases: a null or unreadable text is a plain message; a call without id or name is a plain
message, too; of several calls with one id in a conversation the first by (turn, place) stands and the
others are ``duplicate_call``, likewise results (``duplicate_result``); a result without call is an
``orphan_result``; a call without result is ``unanswered``; a result ahead of its call is linked and put behind it; a
call that waits for itself, a later cycle or an unknown id is ``cycle`` or ``missing_dependency`` (``cycle`` if
both), and what stands in ``after`` but is no string is an unknown id; null
conversations form one conversation; repeated rows are messages of their own, so all calls but one of equal rows
are ``duplicate_call``; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docattr.session import cut, discard

SCHEMAS = {
    "reply": {
        "type": "object", "required": ["question", "turn"], "additionalProperties": False,
        "properties": {"question": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    },
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """Canonical JSON; numbers that are whole are written without a fraction."""
    def plain(v):
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("JSON has no such number")
            return int(v) if v == int(v) and abs(v) < 2**53 else v
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or value == int(value))
    return isinstance(value, _TYPES[kind])


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON schema a value breaks: type, enum, required, properties, items, bounds and lengths."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {'|'.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                out += violations(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += violations(v, schema.get("items", {}), f"{at}[{i}]")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", math.inf):
            out.append(f"{at}: length")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            out.append(f"{at}: out of bounds")
    return out


_ITEMS = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int64()), ("kind", pa.string()), ("call_id", pa.string()),
    ("after", pa.list_(pa.string())), ("name", pa.string()), ("body", pa.string()), ("problems", pa.string())])
_ITEMS_SQL = ("conv_id long, turn long, place long, kind string, call_id string, after array<string>, name string, body string, "
              "problems string")


def _loaded(text: str | None):
    try:
        return json.loads(text) if text and text.lstrip()[:1] == "{" else None
    except (ValueError, RecursionError):
        return None


def items(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls, results and plain messages with canonical bodies and the violations of their arguments."""

    def parse(role: str | None, text: str | None) -> list[tuple]:
        value = _loaded(text)
        try:
            if role == "tool" and isinstance(value, dict) and isinstance(value.get("tool_call_id"), str):
                return [("result", value["tool_call_id"], None, None, canonical(value.get("content")), None)]
            calls = value.get("tool_calls") if role == "assistant" and isinstance(value, dict) else None
            if isinstance(calls, list) and calls and all(
                    isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("name"), str) for c in calls):
                rows = []
                for c in calls:
                    arguments, after = c.get("arguments", {}), c.get("after")
                    broken = violations(arguments, schemas[c["name"]]) if c["name"] in schemas else ["unknown tool"]
                    after = [] if after is None else after if isinstance(after, list) else [after]
                    after = sorted({x if isinstance(x, str) else f"\0{canonical(x)}" for x in after})
                    rows.append(("call", c["id"], after, c["name"], canonical(arguments), ";".join(broken)))
                return rows
        except (ValueError, RecursionError):
            pass
        return [("message", None, None, role, canonical({"content": text, "role": role}), None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(conv, turn, i, *row) for i, row in enumerate(parse(role, text))]
            columns = zip(*rows, strict=True) if rows else [[]] * len(_ITEMS)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ITEMS, strict=True)], schema=_ITEMS)

    typed = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return typed.mapInArrow(run, _ITEMS_SQL)


def _first(rows: DataFrame) -> DataFrame:
    """The first row of every (conv_id, call_id), reduced map-side; of equal rows the one with the smallest ``number``."""
    order = F.struct("turn", "place", "body", "after", "name", "problems", "number")
    return rows.groupBy("conv_id", "call_id").agg(F.min(order).alias("f")).select("conv_id", "call_id", "f.*")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, state): number of calls to wait for; state is ``ok``, ``missing_dependency`` or ``cycle``."""
    several = F.size("after") > 1
    step = cut(calls.select(
        "conv_id", "call_id", F.when(~several, F.get("after", F.lit(0))).alias("to"),
        F.when(F.size("after") == 1, 1).otherwise(0).cast("long").alias("level"), F.lit(False).alias("lost"),
        F.when(several, F.col("call_id")).alias("base")))
    rounds = max(1, math.ceil(math.log2(step.count() + 1)) + 1)
    for _ in range(rounds):
        if step.filter("to IS NOT NULL").isEmpty():
            break
        ahead = step.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), F.col("to").alias("_to"),
                            F.col("level").alias("_level"), F.col("lost").alias("_lost"), F.col("base").alias("_base"))
        waiting = step.filter("to IS NOT NULL").join(
            ahead, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("to") == F.col("_i")), "left")
        moved = waiting.select("conv_id", "call_id", F.col("_to").alias("to"), F.when(
            F.col("_i").isNull(), F.col("level") - 1).otherwise(F.col("level") + F.col("_level")).alias("level"),
            (F.col("_i").isNull() | F.coalesce("_lost", F.lit(False))).alias("lost"), F.col("_base").alias("base"))
        last, step = step, cut(step.filter("to IS NULL").unionByName(moved))
        discard(last)
    if not step.filter("base IS NOT NULL").isEmpty():
        solved = _joined_levels(calls.filter(several), step)
        same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("base") == F.col("_b"))
        step = step.join(solved, same, "left").select(
            "conv_id", "call_id", F.when(F.col("_b").isNull(), F.coalesce("to", "base")).alias("to"),
            (F.col("level") + F.coalesce("_high", F.lit(0))).alias("level"),
            (F.col("lost") | F.coalesce("_gone", F.lit(False))).alias("lost"))
    state = F.when(F.col("to").isNotNull(), "cycle").when(F.col("lost"), "missing_dependency").otherwise("ok")
    return step.select("conv_id", "call_id", F.when(F.col("to").isNull(), F.col("level")).alias("level"), state.alias("state"))


def _joined_levels(several: DataFrame, step: DataFrame) -> DataFrame:
    """(_c, _b, _high, _gone): level of every call that waits for several and reaches no cycle, and whether one it
    waits for is unknown; ``step`` has the ends of all chains."""
    ends = step.select(F.col("conv_id").alias("_ec"), F.col("call_id").alias("_e"), "to", "level", "lost", "base")
    waits = several.select("conv_id", "call_id", F.explode("after").alias("on")).join(
        ends, F.col("conv_id").eqNullSafe(F.col("_ec")) & (F.col("on") == F.col("_e")), "left")
    waits = cut(waits.select("conv_id", "call_id", F.col("_e").isNull().alias("unknown"), "to", "level", "lost", "base"))
    solved = cut(several.sparkSession.createDataFrame([], "_c long, _b string, _high long, _gone boolean"))
    count = 0
    while True:
        met = waits.join(solved, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("base") == F.col("_b")), "left")
        known = F.col("to").isNull() & (F.col("base").isNull() | F.col("_b").isNotNull())
        high = F.when(F.col("unknown"), F.lit(0)).otherwise(F.col("level") + F.coalesce("_high", F.lit(0)) + 1)
        gone = F.col("unknown") | F.coalesce("lost", F.lit(False)) | F.coalesce("_gone", F.lit(False))
        ready = met.groupBy("conv_id", "call_id").agg(
            F.bool_and(known).alias("ready"), F.max(high).alias("_high"), F.bool_or(gone).alias("_gone")).filter("ready")
        last, solved = solved, cut(ready.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_b"), "_high", "_gone"))
        discard(last)
        before, count = count, solved.count()
        if count == before:
            return solved


def linked(messages: DataFrame, schemas: dict[str, dict] = SCHEMAS) -> DataFrame:
    """One record per call, unlinked result and plain message.

    Columns: conv_id, level, turn, place, kind, call_id, status, problems, json. Sorted by (conv_id, level,
    turn, place) calls come behind what they wait for, each with its result in the record.
    """
    rows = cut(items(messages, schemas).withColumn("number", F.monotonically_increasing_id()))
    calls = _first(rows.filter("kind = 'call'"))
    results = _first(rows.filter("kind = 'result'"))
    answer = results.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), F.col("body").alias("result"))
    depth = levels(calls).withColumnsRenamed({"conv_id": "_dc", "call_id": "_di"})
    joined = calls.join(answer, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_i")), "left").join(
        depth, F.col("conv_id").eqNullSafe(F.col("_dc")) & (F.col("call_id") == F.col("_di")))

    def text(c: str):
        """A string as JSON: the only element of a list, without its brackets."""
        whole = F.to_json(F.array(F.col(c)))
        return F.substring(whole, F.lit(2), F.length(whole) - 2)

    status = F.when(F.col("state") != "ok", F.col("state")).when(F.col("problems") != "", "invalid").when(
        F.col("result").isNull(), "unanswered").otherwise("ok")
    record = F.concat(
        F.lit('{"arguments":'), F.col("body"), F.lit(',"id":'), text("call_id"), F.lit(',"name":'), text("name"),
        F.when(F.col("result").isNotNull(), F.concat(F.lit(',"result":'), F.col("result"))).otherwise(""), F.lit("}"))
    columns = ["conv_id", "level", "turn", "place", "kind", "call_id", "status", "problems", "json"]
    of_calls = joined.select("conv_id", "level", "turn", "place", F.lit("call").alias("kind"), "call_id", status.alias("status"),
                             "problems", record.alias("json"))
    zero = F.lit(0).cast("long")
    plain = rows.filter("kind = 'message'").select(
        "conv_id", zero.alias("level"), "turn", "place", "kind", "call_id", F.lit("ok").alias("status"), "problems",
        F.col("body").alias("json"))

    def others(kind: str, firsts: DataFrame) -> DataFrame:
        """Rows of a kind behind the first of their identifier."""
        f = firsts.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), F.col("number").alias("_n"))
        same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_i"))
        later = rows.filter(F.col("kind") == kind).join(f, same).filter(F.col("number") != F.col("_n"))
        return later.select("conv_id", zero.alias("level"), "turn", "place", "kind", "call_id",
                            F.lit(f"duplicate_{kind}").alias("status"), "problems", F.col("body").alias("json"))

    orphans = results.join(calls.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i")),
                           F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_i")), "left_anti")
    lone = orphans.select("conv_id", zero.alias("level"), "turn", "place", F.lit("result").alias("kind"), "call_id",
                          F.lit("orphan_result").alias("status"), "problems", F.col("body").alias("json"))
    out = of_calls
    for more in (plain, others("call", calls), others("result", results), lone):
        out = out.unionByName(more)
    return out.select(*columns)


def as_calls(conversations: DataFrame) -> DataFrame:
    """Plain conversations as calls: every user turn calls ``reply`` with its question, the assistant's next turn
    is the result, and a question waits for the one two turns ahead of it."""
    turn = F.col("turn").cast("string")
    call = F.struct(
        F.struct(F.col("text").alias("question"), F.col("turn").alias("turn")).alias("arguments"),
        F.when(F.col("turn") >= 2, (F.col("turn") - 2).cast("string")).alias("after"),
        turn.alias("id"), F.lit("reply").alias("name"))
    asked = F.to_json(F.struct(F.array(call).alias("tool_calls")))
    given = F.to_json(F.struct(F.col("text").alias("content"), (F.col("turn") - 1).cast("string").alias("tool_call_id")))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return conversations.select(
        "conv_id", "turn", F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role")).alias("role"),
        F.when(user, asked).when(assistant, given).otherwise(F.col("text")).alias("text"))
