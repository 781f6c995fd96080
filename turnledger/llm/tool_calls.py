"""Tool-call linking: calls and results joined by identifier, ordered topologically, validated, as canonical JSON.

Messages carry JSON: an assistant message ``{"tool_calls": [{"id", "name",
"arguments", "after"}]}``, a tool message ``{"tool_call_id", "content"}``. A
repeated identifier of a conversation is one call (the first) with ``copies``.

Order: a call's key is its own time or, if later, the key of a call it comes
after plus one hop. Calls logged in order need no round; each round of joins
moves keys along one more link. A conversation in which a round changes nothing
is settled and has no cycle. The conversations that still change after ``ROUNDS``
rounds, because of a long chain or a cycle, are settled in a task each, in one
pass over their calls and links (no texts): calls without open dependencies are
peeled, and what never peels is in or behind a cycle. Positions are counted per stretch of time of a conversation, and the stretches'
counts are added up, so no conversation is sorted as a whole. One row per call
leaves the operator.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from math import isfinite

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.session import stored

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:string>"
#: Rounds of joins before what still changes is settled conversation by conversation; the result does not depend on it.
ROUNDS = 4
#: Turns in a stretch of a conversation.
STRETCH = 256

#: tool -> field -> (JSON types, required)
SCHEMAS = {
    "search": {"query": (("string",), True), "limit": (("integer",), False)},
    "read": {"path": (("string",), True), "lines": (("integer",), True)},
    "count": {"text": (("string",), True)},
    "note": {"text": (("string",), True)},
}

_LONE = re.compile("[\ud800-\udfff]")


class _OutOfRange(ValueError):
    pass


def calls_of(messages: DataFrame) -> DataFrame:
    """(conv_id, id, turn, place, name, arguments, after, copies) of the calls in assistant messages."""
    parsed = messages.where("role = 'assistant'").select("conv_id", "turn", F.from_json(F.col("text").cast("string"), CALLS).alias("m"))
    one = parsed.select("conv_id", "turn", F.posexplode("m.tool_calls").alias("place", "c")).where("c.id is not null and conv_id is not null")
    first = F.min(F.struct(F.coalesce("turn", F.lit(0)).alias("turn"), "place", "c.name", "c.arguments", F.coalesce("c.after", F.array().cast("array<string>")).alias("after")))
    return one.groupBy("conv_id", F.col("c.id").alias("id")).agg(first.alias("f"), F.count("*").alias("copies")).select("conv_id", "id", "f.*", "copies")


def results_of(messages: DataFrame) -> DataFrame:
    """(conv_id, id, content, answers) of the tool messages; of several for one id the first."""
    parsed = messages.where("role = 'tool'").select("conv_id", "turn", F.from_json(F.col("text").cast("string"), RESULT).alias("m")).where("m.tool_call_id is not null and conv_id is not null")
    first = F.min(F.struct(F.coalesce("turn", F.lit(0)).alias("turn"), F.col("m.content").alias("content")))
    return parsed.groupBy("conv_id", F.col("m.tool_call_id").alias("id")).agg(first.alias("f"), F.count("*").alias("answers")).select("conv_id", "id", "f.content", "answers")


def peeled(ids: list[str], own: list[tuple], after: list[list[str]]) -> list[tuple | None]:
    """The key (turn, hops, place) of each call of a conversation, None in or behind a cycle; ``own`` are their own keys."""
    number = {x: i for i, x in enumerate(ids)}
    waits = [{number[d] for d in deps if d in number and d != x} for x, deps in zip(ids, after)]
    open_, behind, most = [len(w) for w in waits], [[] for _ in ids], [None] * len(ids)
    for i, w in enumerate(waits):
        for d in w:
            behind[d].append(i)
    keys: list[tuple | None] = [None] * len(ids)
    ready = [i for i, n in enumerate(open_) if not n]
    while ready:
        i = ready.pop()
        wait = most[i]
        key = keys[i] = own[i] if wait is None or wait < own[i] else (wait[0], wait[1] + 1, wait[2])
        for j in behind[i]:
            most[j] = key if most[j] is None else max(most[j], key)
            open_[j] -= 1
            if not open_[j]:
                ready.append(j)
    return keys


def ordered(calls: DataFrame) -> DataFrame:
    """``calls`` with ``position`` (from 1 in each conversation) and ``ordered`` (false for calls in or behind a cycle)."""
    own = F.struct("turn", F.lit(0).alias("hops"), "place")
    keys = stored(calls.select("conv_id", "id", "turn", "place", own.alias("key"), F.lit(False).alias("moved"), "after"), "keys")
    links = stored(keys.select("conv_id", "id", F.explode("after").alias("dep")).where("dep <> id").distinct(), "links")
    settled, open_ = [], keys
    for _ in range(ROUNDS):
        waits = links.join(open_.select("conv_id", F.col("id").alias("dep"), "key"), ["conv_id", "dep"])
        most = waits.groupBy("conv_id", "id").agg(F.max("key").alias("wait"))
        # hops break ties inside the turn of the call that is waited for
        after = F.struct(F.col("wait.turn").alias("turn"), (F.col("wait.hops") + 1).alias("hops"), F.col("wait.place").alias("place"))
        key = F.when(F.col("wait") >= own, after).otherwise(own)
        step = open_.withColumnRenamed("key", "old").join(most, ["conv_id", "id"], "left").withColumn("key", key).withColumn("changed", F.col("key") != F.col("old"))
        step = stored(step.select(*keys.columns, "changed"), "keys")
        changing = stored(step.where("changed").select("conv_id").distinct(), "changing")
        step = step.drop("changed")
        settled.append(step.join(changing, "conv_id", "left_anti"))
        if not changing.take(1):
            open_ = None
            break
        open_ = stored(step.join(changing, "conv_id", "left_semi"), "open")
    if open_ is not None:

        def settle(part: pd.DataFrame) -> pd.DataFrame:
            mine = list(zip(part["turn"].tolist(), [0] * len(part), part["place"].tolist()))
            found = peeled(part["id"].tolist(), mine, [list(x) for x in part["after"]])
            kept = [k or m for k, m in zip(found, mine)]
            return part[["conv_id", "id", "turn", "place"]].assign(key_turn=[k[0] for k in kept], hops=[k[1] for k in kept], key_place=[k[2] for k in kept], moved=[k is None for k in found])

        kind = calls.schema["conv_id"].dataType.simpleString()
        rows = open_.select("conv_id", "id", "turn", "place", F.filter("after", lambda d: d.isNotNull()).alias("after"))
        rest = rows.groupBy("conv_id").applyInPandas(settle, f"conv_id {kind}, id string, turn bigint, place int, key_turn bigint, hops int, key_place int, moved boolean")
        key = F.struct(F.col("key_turn").alias("turn"), "hops", F.col("key_place").alias("place"))
        settled.append(rest.select("conv_id", "id", F.col("turn").cast(keys.schema["turn"].dataType).alias("turn"), "place", key.alias("key"), "moved"))
    columns = ["conv_id", "id", "turn", "place", "moved", F.col("key.turn").cast("bigint").alias("at"), F.col("key.hops").alias("hops"), F.col("key.place").alias("key_place")]
    keys = settled[0].select(*columns)
    for part in settled[1:]:
        keys = keys.unionByName(part.select(*columns))
    keys = stored(keys.withColumn("stretch", F.floor(F.col("at") / STRETCH)), "keys")
    group = ["conv_id", "moved", "stretch"]
    counts = keys.groupBy(*group).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("moved", "stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("start", before).drop("n")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("at", "hops", "key_place", "turn", "place", "id"))
    placed = keys.withColumn("rank", rank).join(starts, group).select("conv_id", "id", (F.col("start") + F.col("rank")).alias("position"), (~F.col("moved")).alias("ordered"))
    return calls.join(placed, ["conv_id", "id"])


def _kind(value) -> str:
    names = {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object", type(None): "null"}
    return names[type(value)]


def _refused(word: str):
    raise ValueError(word)  # NaN and Infinity are not JSON


def _finite(digits: str) -> float:
    value = float(digits)
    if not isfinite(value):
        raise _OutOfRange(digits)
    return value


def _escaped(text: str) -> str:
    """Half a surrogate pair is no character: it stays the escape that it was written as."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def problem(name: str | None, arguments: str | None, schemas: dict) -> tuple[str | None, object]:
    """(what is wrong with a call's arguments, or None; the parsed arguments, or their text where they can't be kept as JSON)."""
    try:
        value = None if arguments is None else json.loads(arguments, parse_constant=_refused, parse_float=_finite)
        canonical(value)
    except _OutOfRange:
        return "number out of range", arguments
    except RecursionError:
        return "nested too deeply", arguments
    except ValueError:
        return "not JSON", arguments
    if name not in schemas:
        return "unknown tool", value
    if not isinstance(value, dict):
        return "not an object", value
    fields = schemas[name]
    for field in sorted(fields):
        kinds, required = fields[field]
        if field not in value:
            if required:
                return f"missing {field}", value
        elif _kind(value[field]) not in kinds:
            return f"type of {field}", value
    extra = sorted(set(value) - set(fields))
    return (f"unexpected {extra[0]}" if extra else None), value


def canonical(value) -> str:
    """JSON with sorted keys, no blanks and no needless escapes."""
    return _escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def link(messages: DataFrame, schemas: dict | None = None) -> DataFrame:
    """One row per call and per result without a call: (conv_id, id, position, status, problem, copies, json).

    status is linked, unanswered or orphan (a result without a call: position and
    problem null), or unordered for a call in or behind a cycle. problem says what
    the schema objects to, null where the arguments are valid. Messages that are
    null, empty or no such JSON, and rows with a null conv_id, hold no calls. Of a
    repeated id the first call and the first result count. Arguments that are not
    JSON (NaN included), hold a number beyond doubles or are nested too deeply to
    parse keep their text and say so in problem; half a surrogate pair stays
    escaped. An empty table gives an empty one; other columns are not read.
    """
    schemas = SCHEMAS if schemas is None else schemas
    read = messages.select("conv_id", "turn", "role", "text")
    both = ordered(stored(calls_of(read), "calls")).join(results_of(read), ["conv_id", "id"], "full")
    status = (
        F.when(F.col("position").isNull(), "orphan").when(~F.col("ordered"), "unordered").when(F.col("answers").isNull(), "unanswered").otherwise("linked")
    )
    rows = both.select("conv_id", "id", "position", status.alias("status"), F.coalesce("copies", "answers").alias("copies"), "name", "arguments", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrong, text = [], []
            for id_, status_, name, arguments, content in zip(*(batch.column(c).to_pylist() for c in ("id", "status", "name", "arguments", "content"))):
                if status_ == "orphan":
                    wrong.append(None)
                    text.append(canonical({"id": id_, "result": content}))
                    continue
                bad, value = problem(name, arguments, schemas)
                wrong.append(bad and _escaped(bad))
                text.append(canonical({"arguments": value, "id": id_, "name": name, "result": content, "valid": bad is None}))
            columns = [batch.column(c) for c in ("conv_id", "id", "position", "status")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(wrong, pa.string()), batch.column("copies"), pa.array(text, pa.string())],
                names=["conv_id", "id", "position", "status", "problem", "copies", "json"],
            )

    kind = messages.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, id string, position bigint, status string, problem string, copies bigint, json string")
