"""Chat formatting: link tool calls with results, order them, validate, serialise canonically.

A turn's text may hold blocks ``<tool_call>{"id", "name", "arguments"}</tool_call>``
and ``<tool_result>{"id", "content"}</tool_result>``.  Arguments may point to another
call's result with ``{"$ref": "<id>"}``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, discard, materialize

_BLOCK = re.compile(r"<tool_(call|result)>(.*?)</tool_\1>", re.DOTALL)
_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}
#: Keywords of a schema that arguments are checked against, and those that say nothing about validity.
CHECKED = {"type", "enum", "required", "properties", "additionalProperties", "items"}
SILENT = {"title", "description", "default", "examples", "$comment"}
#: Levels of lists and objects that arguments and contents may have; deeper ones are malformed.
MAX_DEPTH = 64
ENTRY = "conv_id long, turn long, k int, role string, kind string, call_id string, name string, problem string, refs array<string>, json string"
_ORDER = ["conv_id", "w", "d", "turn", "k", "tie"]


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, no escapes beyond the needed ones; lone surrogates stay escaped."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _too_deep(value, left: int = MAX_DEPTH) -> bool:
    if not isinstance(value, (dict, list)):
        return False
    return left == 0 or any(_too_deep(v, left - 1) for v in (value.values() if isinstance(value, dict) else value))


def parsed(text: str):
    """The value of a JSON text, or None where it is malformed: NaN and infinities, which JSON does not have, numbers too large for it, and too deep ones included."""
    try:
        value = json.loads(text, parse_constant=_no_constant)
        json.dumps(value, allow_nan=False)
    except (ValueError, RecursionError):
        return None
    return None if _too_deep(value) else value


def check_schema(schema: dict, at: str = "arguments") -> None:
    """Raises ValueError for a keyword that ``invalid`` would not check."""
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema must be an object")
    unknown = sorted(set(schema) - CHECKED - SILENT)
    if unknown:
        raise ValueError(f"{at}: schema keywords that are not supported: {', '.join(unknown)}")
    kinds = schema.get("type", [])
    for kind in [kinds] if isinstance(kinds, str) else kinds:
        if kind not in {*_TYPES, "number", "integer"}:
            raise ValueError(f"{at}: unknown type {kind}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"{at}: additionalProperties must be true or false")
    for k, v in schema.get("properties", {}).items():
        check_schema(v, f"{at}.{k}")
    if "items" in schema:
        check_schema(schema["items"], f"{at}[]")


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES[kind])


def _equal(a, b) -> bool:
    """Equality of JSON values: numbers by value, truth values only with themselves."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return set(a) == set(b) and all(_equal(a[k], b[k]) for k in a)
    return a == b


def invalid(value, schema: dict, at: str = "arguments") -> str | None:
    """First breach of a schema (type, enum, required, properties, additionalProperties, items), or None."""
    if isinstance(value, dict) and set(value) == {"$ref"} and at != "arguments":
        return None  # known only once the other call has run
    kind = schema.get("type")
    if kind is not None and not any(_is(value, k) for k in ([kind] if isinstance(kind, str) else kind)):
        return f"{at}: not {kind if isinstance(kind, str) else ' or '.join(kind)}"
    if "enum" in schema and not any(_equal(value, v) for v in schema["enum"]):
        return f"{at}: not in enum"
    if isinstance(value, dict):
        missing = [k for k in schema.get("required", []) if k not in value]
        if missing:
            return f"{at}: {missing[0]} is missing"
        known = schema.get("properties", {})
        for k in sorted(value):
            if k in known:
                found = invalid(value[k], known[k], f"{at}.{k}")
                if found:
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{at}: {k} is not allowed"
    if isinstance(value, list) and "items" in schema:
        return next((p for i, v in enumerate(value) if (p := invalid(v, schema["items"], f"{at}[{i}]"))), None)
    return None


def _refs(value) -> list[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return [value["$ref"]]
        return [r for v in value.values() for r in _refs(v)]
    return [r for v in value for r in _refs(v)] if isinstance(value, list) else []


def _plain(text: str | None) -> str | None:
    """A string that can be a value of a column: lone surrogates become their escapes."""
    return None if text is None else re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def entries_of(conv, turn, role, text, schemas: dict) -> list[tuple]:
    """The message without its blocks, then its calls and results, as rows of ENTRY."""
    text = text or ""
    blocks = list(_BLOCK.finditer(text)) if "<tool_" in text else []
    plain = _BLOCK.sub("", text) if blocks else text
    out = []
    if plain.strip() or not blocks:
        out.append((conv, turn, 0, role, "message", None, None, None, [], canonical({"role": role, "content": plain})))
    for k, m in enumerate(blocks, 1):
        kind, body = m[1], parsed(m[2])
        if not isinstance(body, dict) or not isinstance(body.get("id"), str):
            out.append((conv, turn, k, role, kind, None, None, "malformed", [], canonical({"type": f"tool_{kind}", "raw": m[2]})))
        elif kind == "result":
            out.append((conv, turn, k, role, kind, _plain(body["id"]), None, None, [], canonical({"type": "tool_result", "id": body["id"], "content": body.get("content")})))
        else:
            name, args = body.get("name"), body.get("arguments", {})
            known = isinstance(name, str) and name in schemas
            problem = _plain(invalid(args, schemas[name])) if known else "unknown tool"
            line = canonical({"type": "tool_call", "id": body["id"], "name": name, "arguments": args})
            out.append((conv, turn, k, role, kind, _plain(body["id"]), _plain(name) if isinstance(name, str) else None, problem, sorted({_plain(r) for r in _refs(args)}), line))
    return out


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one task with their number within the task and conversation (-1 for none known yet)."""
    last, count = (), 0
    for b in batches:
        convs = b.column(0).to_pylist()
        out = np.empty(len(convs), np.int64)
        for i, c in enumerate(convs):
            if (c,) != last:
                last, count = (c,), 0
            count += 1
            out[i] = count
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "nth"])


def numbered(rows: DataFrame) -> DataFrame:
    """rows with pos, their number from 1 within their conversation in the order of _ORDER.

    A range sort deals rows out evenly, a conversation over as many tasks as it needs.
    Each task numbers its own rows; only the conversation that a task begins with may have
    begun before, so what is carried over is one number a task.
    """
    spread = rows.repartitionByRange(*[F.col(c) for c in _ORDER]).sortWithinPartitions(*_ORDER, "json")
    spread = spread.select("conv_id", *[c for c in rows.columns if c != "conv_id"], F.spark_partition_id().alias("part"))
    schema = ", ".join(f"`{n}` {t}" for n, t in spread.dtypes) + ", nth long"
    spread = materialize(spread.mapInArrow(_number, schema), "ranked")
    ends = spread.groupBy("part", "conv_id").agg(F.count("*").alias("n")).groupBy("part").agg(
        F.min(F.struct("conv_id")).alias("first"), F.max(F.struct("conv_id", "n")).alias("last")
    )
    carried, before, conv = [], 0, ()
    for r in ends.orderBy("part").collect():  # one row for each task
        first, last = (r["first"].conv_id,), (r["last"].conv_id,)
        if first == conv:
            carried.append((r.part, *first, before))
        before = r["last"].n + (before if first == last == conv else 0)
        conv = last
    # where a task goes on with a conversation, its rows of it come after those of the tasks before
    shift = F.broadcast(spread.sparkSession.createDataFrame(carried, "op int, oc long, more long"))
    met = spread.join(shift, (F.col("part") == F.col("op")) & F.col("conv_id").eqNullSafe(F.col("oc")), "left")
    return met.withColumn("pos", F.col("nth") + F.coalesce("more", F.lit(0)))


def format_chats(turns: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per message, call and result: conv_id, pos, turn, kind, role, call_id, status, json.

    Calls and results meet in a hash join on (conv_id, id).  The order is topological:
    a result comes after its call, a call after the results that it refers to, and
    otherwise turns keep their order; pos counts from 1 in each conversation.

    status of a call: ok, malformed, unknown tool, a schema breach, duplicate (a later
    call of the same id), unanswered, or cycle; of a result: ok, malformed, duplicate,
    or orphan (no such call); of a message: ok.

    Edge cases: null text is an empty message; a null role stays null; repeated turns
    stay, in a fixed order; an empty table gives an empty result; other columns are
    ignored.  Rows with a null conversation id form a conversation of their own.
    Blocks that are no JSON (NaN and nesting beyond MAX_DEPTH included), or lack a text as
    id, are malformed and keep their raw text; a name that is no text is an unknown tool;
    lone surrogates stay escaped.  A schema keyword that is not checked raises ValueError.
    A conversation is never gathered into one task: rows are dealt by range and numbered.
    Rounds of the order: one for each step of the longest chain of references.
    """
    given = dict(schemas)
    for name, schema in given.items():
        check_schema(schema, name)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ENTRY.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 5, pa.list_(pa.string()), pa.string()]
        for b in batches:
            for at in range(0, b.num_rows, 512):
                p = b.slice(at, 512)
                rows = [e for row in zip(*(c.to_pylist() for c in p.columns), strict=True) for e in entries_of(*row, given)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)

    src = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    entries = src.mapInArrow(parse, ENTRY).withColumns({"uid": F.monotonically_increasing_id(), "tie": F.xxhash64("json")})
    entries = materialize(entries, "chat")

    # of calls, and of results, of one id the first counts
    tools = entries.where("kind <> 'message'")
    first = F.struct("turn", "k", "tie", "uid")
    firsts = tools.where("call_id IS NOT NULL").groupBy("conv_id", "kind", "call_id").agg(F.min(first).alias("f"), F.min_by("refs", first).alias("refs"))
    firsts = materialize(firsts.select("conv_id", "kind", "call_id", "f.turn", "f.uid", "refs"), "firsts")
    calls = firsts.where("kind = 'call'").select("conv_id", "call_id", F.col("turn").alias("ct"), F.col("uid").alias("cu"), "refs")
    results = firsts.where("kind = 'result'").select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), F.col("turn").alias("rt"), F.col("uid").alias("ru"))
    pair = calls.join(results, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri")), "full")
    conv = F.when(F.col("call_id").isNull(), F.col("rc")).otherwise(F.col("conv_id"))
    linked = materialize(pair.select(conv.alias("conv_id"), F.coalesce("call_id", "ri").alias("call_id"), "ct", "cu", "rt", "ru", "refs"), "calls")
    placed = _placed(linked.where("cu IS NOT NULL").drop("cu", "ru")).select(F.col("conv_id").alias("pc"), F.col("call_id").alias("pi"), "at", "depth")
    info = linked.join(placed, F.col("conv_id").eqNullSafe(F.col("pc")) & (F.col("call_id") == F.col("pi")), "left")
    info = info.select(F.col("conv_id").alias("oc"), F.col("call_id").alias("oi"), "cu", "rt", "ru", "at", "depth")

    known = tools.join(info, F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("call_id") == F.col("oi")), "left")
    is_call = F.col("kind") == "call"
    status = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("uid") != F.when(is_call, F.col("cu")).otherwise(F.col("ru")), "duplicate")
        .when(~is_call & F.col("cu").isNull(), "orphan")
        .when(F.col("depth") == -1, "cycle")
        .when(is_call & F.col("rt").isNull(), "unanswered")
        .otherwise("ok")
    )
    where = F.when(is_call, F.coalesce("at", "turn")).otherwise(F.greatest("turn", "at"))
    cols = ["conv_id", "turn", "k", "kind", "role", "call_id", "json", "tie"]
    step = F.coalesce(F.greatest("depth", F.lit(0)), F.lit(0)) * 2 + F.when(is_call, 1).otherwise(2)
    ranked = known.select(*cols, status.alias("status"), where.alias("w"), step.cast("int").alias("d"))
    plain = entries.where("kind = 'message'").select(*cols, F.lit("ok").alias("status"), F.col("turn").alias("w"), F.lit(0).alias("d"))
    rows = materialize(plain.unionByName(ranked), "placed")
    discard(entries, firsts, linked)
    return numbered(rows).select("conv_id", F.col("pos").cast("long").alias("pos"), "turn", "kind", "role", "call_id", "status", "json")


def _placed(linked: DataFrame) -> DataFrame:
    """(conv_id, call_id, rt, at, depth): each call's turn and step in a topological order; depth -1 in or behind a cycle.

    Round by round, what was placed last is joined with the references that wait for it; a
    call is placed when none of its references waits.  A round touches only what still waits.
    """
    part = "conv_id long, call_id string, rt long, at long, depth int"
    known = linked.select(F.col("conv_id").alias("lc"), F.col("call_id").alias("li"))
    refs = linked.select("conv_id", "call_id", "ct", "rt", F.explode("refs").alias("ref"))
    # references to ids that are no call are not waited for
    refs = refs.join(known, F.col("conv_id").eqNullSafe(F.col("lc")) & (F.col("ref") == F.col("li")), "left_semi")
    waiting = materialize(refs.select("conv_id", "call_id", "ct", "rt", "ref", F.lit(None).cast("long").alias("free"), F.lit(None).cast("int").alias("pd")), "waiting")
    held = waiting.select(F.col("conv_id").alias("hc"), F.col("call_id").alias("hi")).distinct()
    at_once = linked.join(held, F.col("conv_id").eqNullSafe(F.col("hc")) & (F.col("call_id") == F.col("hi")), "left_anti")
    latest = materialize(at_once.select("conv_id", "call_id", "rt", F.col("ct").alias("at"), F.lit(0).alias("depth")), "order")
    parts = [latest]
    while not waiting.isEmpty():
        done = latest.select(F.col("conv_id").alias("pc"), F.col("call_id").alias("pi"), F.greatest("at", "rt").alias("pfree"), F.col("depth").alias("pdepth"))
        met = waiting.join(done, F.col("conv_id").eqNullSafe(F.col("pc")) & (F.col("ref") == F.col("pi")), "left")
        met = met.select("conv_id", "call_id", "ct", "rt", F.when(F.col("pi").isNull(), F.col("ref")).alias("ref"), F.greatest("free", "pfree").alias("free"), F.greatest("pd", "pdepth").alias("pd"))
        # one row for what a call has met so far, and one for each reference that it still waits for
        met = materialize(met.groupBy("conv_id", "call_id", "ct", "rt", "ref").agg(F.max("free").alias("free"), F.max("pd").alias("pd")), "met")
        still = met.where("ref IS NOT NULL").select(F.col("conv_id").alias("sc"), F.col("call_id").alias("si")).distinct()
        of_still = F.col("conv_id").eqNullSafe(F.col("sc")) & (F.col("call_id") == F.col("si"))
        ready = met.where("ref IS NULL").join(still, of_still, "left_anti")
        latest = materialize(ready.select("conv_id", "call_id", "rt", F.greatest("ct", "free").alias("at"), (F.col("pd") + 1).cast("int").alias("depth")), "order")
        waiting = materialize(met.join(still, of_still, "left_semi"), "waiting")
        if latest.isEmpty():  # only cycles are left, and what refers to them: they keep their own turn
            stuck = waiting.groupBy("conv_id", "call_id", "ct", "rt").agg(F.count("*")).select("conv_id", "call_id", "rt", F.col("ct").alias("at"), F.lit(-1).alias("depth"))
            parts.append(materialize(stuck, "order"))
            break
        parts.append(latest)
    return appended(parts, part)
