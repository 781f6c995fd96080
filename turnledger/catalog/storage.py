"""Log files, history and streams: written from the benchmark tables by Spark, read back, compared."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from turnledger.catalog import shapes, sql
from turnledger.catalog.base import query, rounded
from turnledger.catalog.costs import SPLIT
from turnledger.catalog.shapes import AS_OF, ORACLE_TURNS
from turnledger.functions.money import usd_sum
from turnledger.operators import dedup, series, topk
from turnledger.plans import turns as turn_plan
from turnledger.session import checkpoint_dir, stored
from turnledger.sources import history, logs
from turnledger.streaming import aggregates, ingest, projection, tallies


def _folder(t, name: str) -> str:
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _json_lines(t):
    """Logged responses as JSON text, with a tool call and an error result in the content."""
    rows = t.raw
    call = F.struct(
        F.lit("tool_use").alias("type"), F.concat(F.lit("t"), F.col("line")).alias("id"), F.map_keys("tool_names")[0].alias("name"),
        F.struct(F.map_keys("skill_names")[0].alias("skill")).alias("input"),
    )
    failed = F.struct(F.lit("tool_result").alias("type"), F.lit("x").alias("tool_use_id"), F.lit(True).alias("is_error"))
    content = F.array_compact(
        F.array(
            F.when(F.col("tool_names").isNotNull(), F.to_json(call)),
            F.when(F.col("tool_error_count") > 0, F.to_json(failed)),
        )
    )
    usage = F.struct(
        "input_tokens", "output_tokens", F.col("cache_read_tokens").alias("cache_read_input_tokens"),
        F.col("cache_creation_tokens").alias("cache_creation_input_tokens"),
        F.struct(F.col("cache_creation_1h_tokens").alias("ephemeral_1h_input_tokens")).alias("cache_creation"),
    )
    key = F.split("dedup_key", ":")
    event = F.struct(
        F.lit("assistant").alias("type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.col("session_id").alias("sessionId"), key[1].alias("requestId"), F.col("line").cast("string").alias("uuid"),
        F.col("is_sidechain").alias("isSidechain"), "cwd", "model", F.col("attribution_skill").alias("attributionSkill"),
        F.struct(
            key[0].alias("id"), "stop_reason", F.when(~F.col("is_interrupted"), usage).alias("usage"), F.lit("<content>").alias("content")
        ).alias("message"),
    )
    text = F.replace(F.to_json(event), F.lit('"<content>"'), F.concat(F.lit("["), F.array_join(content, ","), F.lit("]")))
    return rows.select("file", "line", "ts", text.alias("value"))


def _log_folder(t) -> str:
    """A log folder with JSONL files, a blank and a broken line for every day's first event."""
    folder = _folder(t, "logs")
    lines = _json_lines(t)
    days = lines.groupBy(F.to_date("ts").alias("day")).agg(F.min("line").alias("line"))
    noise = days.select(F.explode(F.array(F.lit(""), F.lit('{"type": '), F.lit("[1]"))).alias("value"))
    lines.select("value").unionByName(noise).write.text(f"{folder}/projects/demo")
    # Spark names its part files itself; the reader takes any file below the folder here.
    return folder


def _read(t):
    folder = _log_folder(t)
    files = t.spark.read.format("text").option("recursiveFileLookup", True).load(f"{folder}/projects")
    return logs.located(files)


@query("parsed_responses", """
select cast(line as varchar) as uuid, cast(ts as varchar) as ts, dedup_key, session_id, cwd, model, case when is_interrupted then null else input_tokens end as input_tokens,
  case when is_interrupted then null else output_tokens end as output_tokens, case when is_interrupted then null else cache_read_tokens end as cache_read_tokens,
  case when is_interrupted then null else cache_creation_tokens end as cache_creation_tokens, case when is_interrupted then null else cache_creation_1h_tokens end as cache_creation_1h_tokens, is_interrupted, is_sidechain,
  (tool_name is not null)::bigint as tool_use_count, tool_error_count, attribution_skill, triggered_skill as skill, tool_name as tool, stop_reason from raw""")
def parsed_responses(t):
    rows = logs.responses(logs.events(_read(t)))
    return rows.select(
        "uuid", "ts", "dedup_key", "session_id", "cwd", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens",
        "cache_creation_1h_tokens", "is_interrupted", "is_sidechain", "tool_use_count", "tool_error_count", "attribution_skill",
        F.map_keys("skill_names")[0].alias("skill"), F.map_keys("tool_names")[0].alias("tool"), "stop_reason",
    )


@query("rejected_lines", """
select count(*) + 3 * count(distinct ts::date) as lines, count(distinct ts::date) as blank_lines, 2 * count(distinct ts::date) as bad_lines from raw""")
def rejected_lines(t):
    return logs.rejected(_read(t)).agg(*[F.sum(c).alias(c) for c in ("lines", "blank_lines", "bad_lines")])


@query("line_numbers", "select (count(*) + 3 * count(distinct ts::date))::bigint as lines, 0::bigint as repeated, 0::bigint as gaps from raw")
def line_numbers(t):
    lines = _read(t)
    numbered = logs.with_line_numbers(lines, lines)
    per_file = numbered.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("line").alias("k"), F.max("line").alias("last"), F.min("line").alias("first")
    )
    return per_file.agg(
        F.sum("n").alias("lines"), F.sum(F.col("n") - F.col("k")).alias("repeated"), F.sum(F.col("last") - F.col("first") + 1 - F.col("n")).alias("gaps")
    )


_FRONT = "case conv_id % 4 when 1 then '{' when 2 then '\"' when 3 then chr(9) else '' end"


@query("block_sizes", f"""
select cast(conv_id as varchar) as file, turn as line, 'text' as kind, strlen('{{"type":"text","text":' || to_json({_FRONT} || text) || '}}')::bigint as nbytes
from conversations""", prelude="")
def block_sizes(t):
    """Bytes of the real texts: users' as plain strings, some beginning with a brace, quote or tab, the others' as lists with stray elements."""
    rows = t.table("conversations").withColumn("body", F.expr(f"{_FRONT} || text"))
    body = F.to_json(F.struct(F.lit("text").alias("type"), F.col("body").alias("text")))
    plain = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.col("body").alias("content")).alias("message")))
    listed = F.concat(F.lit('{"type":"assistant","message":{"content":["{not a block", 5, null, '), body, F.lit("]}}"))
    value = F.when(F.col("role") == "user", plain).otherwise(listed)
    events = logs.events(rows.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("line"), value.alias("value")))
    return logs.content_blocks(events).select("file", "line", "kind", "nbytes")


@query("malformed_lines", """
select conv_id, turn, conv_id % 10 not in (1, 2, 3, 4) as read,
  case when conv_id % 10 in (1, 2, 3, 4) then null when conv_id % 10 = 5 then 7 when conv_id % 10 = 6 then 0 when conv_id % 10 = 7 then null else turn end as input_tokens,
  case when conv_id % 10 in (1, 2, 3, 4) then null else conv_id % 10 = 7 end as is_interrupted
from conversations""", prelude="")
def malformed_lines(t):
    """Torn, single-quoted, bare and indented lines with the real texts: which of them are read, and with what counters."""
    kind, text = F.pmod("conv_id", F.lit(10)), F.to_json(F.struct(F.col("text").alias("content")))
    usage = (
        F.when(kind == 5, '{"input_tokens": 7.0}').when(kind == 6, '{"input_tokens": null}').when(kind == 7, '{"output_tokens": 3}')
        .otherwise(F.concat(F.lit('{"input_tokens": '), F.col("turn").cast("string"), F.lit("}")))
    )
    event = F.concat(F.lit('{"type": "assistant", "message": {"usage": '), usage, F.lit(', "content": ['), text, F.lit("]}}"))
    value = (
        F.when(kind == 1, F.concat(event, F.lit(" "), event)).when(kind == 2, F.concat(event, F.lit(" trailing"))).when(kind == 3, "{'type': 'assistant'}")
        .when(kind == 4, F.concat(F.lit("["), event, F.lit("]"))).when(kind == 8, F.concat(F.lit("\t "), event, F.lit("\u00a0\r"))).otherwise(event)
    )
    rows = t.table("conversations").select("conv_id", "turn", F.lit("f").alias("file"), value.alias("value"))
    read = F.col("type").isNotNull()
    return logs.parse(rows).select("conv_id", "turn", read.alias("read"), "input_tokens", F.when(read, F.col("is_interrupted")).alias("is_interrupted"))


def _write_jsonl(lines, folder: str) -> None:
    """Lines into files named *.jsonl (the text writer gives no such names)."""
    plain = {"extension": "jsonl", "sep": "\u0001", "quote": "\u0000", "escape": "\u0000", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines.select("value").write.mode("append").options(**plain).csv(folder)


def _roots(t) -> list[str]:
    """Two roots with log files below them, and a text file that is none."""
    folder = _folder(t, "roots")
    lines = _json_lines(t)
    user = F.regexp_extract("file", r"u(\d+)", 1).cast("int")
    for n in range(2):
        _write_jsonl(lines.filter(F.pmod(user, F.lit(2)) == n), f"{folder}/root{n}/projects/demo")
        lines.limit(5).select("value").write.text(f"{folder}/root{n}/projects/notes")
    return logs.split_roots(f"{folder}/root0,{folder}/root1")


_LOGGED = "select cast(line as varchar) as uuid, 'root' || cast(cast(regexp_extract(file, 'u(\\d+)', 1) as bigint) % 2 as varchar) as root, session_id, cast(ts as varchar) as ts from raw"


@query("log_roots", _LOGGED)
def log_roots(t):
    """Every log line below two roots, found by name at any depth."""
    events, _turns, _sessions = logs.load(t.spark, _roots(t))
    return events.select("uuid", F.regexp_extract("file", r"/(root\d)/", 1).alias("root"), "session_id", "ts")


@query("log_turns", """
select t.line, t.session_id, t.cost_units, s.is_sidechain, s.cwd from turns t join sessions s using (session_id) where t.dedup_key is null
union all select t.line, t.session_id, t.cost_units, s.is_sidechain, s.cwd from turns t join sessions s using (session_id) where t.dedup_key is not null
  and not exists (select 1 from raw r where r.dedup_key = t.dedup_key and r.line <> t.line)""")
def log_turns(t):
    """Turns and sessions of real log files; keys with copies in several files are left to the queries that know the files' names."""
    _events, turns, sessions = logs.load(t.spark, _roots(t))
    copied = t.raw.filter("dedup_key is not null").groupBy("dedup_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("dedup_key")
    alone = turns.join(copied, "dedup_key", "left_anti")
    return alone.join(sessions.select("session_id", F.col("is_sidechain").alias("side"), F.col("cwd").alias("place")), "session_id").select(
        F.col("uuid").cast("bigint").alias("line"), "session_id", "cost_units", F.col("side").alias("is_sidechain"), F.col("place").alias("cwd")
    )


@query("changed_files", _LOGGED + " where line % 5 = 3")
def changed_files(t):
    """The lines that a second scan reads: those of the files that came after the first listing, one of them named with brackets."""
    folder = f"{_folder(t, 'listing')}/root"
    lines = _json_lines(t).withColumn("n", F.pmod("line", F.lit(5)))
    user = F.regexp_extract("file", r"u(\d+)", 1).cast("int")
    for n in range(2):
        _write_jsonl(lines.filter((F.col("n") != 3) & (F.pmod(user, F.lit(2)) == n)), f"{folder}{n}/projects/demo")
    folders = logs.log_folders([f"{folder}0", f"{folder}1"])
    marks = stored(logs.listing(t.spark, folders), "marks")
    for n in range(2):
        _write_jsonl(lines.filter((F.col("n") == 3) & (F.pmod(user, F.lit(2)) == n)), f"{folder}{n}/projects/more [1]")
    events = logs.events(logs.read_changed(t.spark, folders, marks, group=1))
    return events.select("uuid", F.regexp_extract("file", r"/(root\d)/", 1).alias("root"), "session_id", "ts")


@query("fingerprint", "select k as scan, 2 * (k + 1)::bigint as roots, k > 0 as changed, true as stable from range(0, 2) r(k)", prelude="")
def fingerprint(t):
    """Two scans with a new file between them: each is the same when it is repeated, the second differs from the first."""
    roots, rows, before = _roots(t), None, None
    for scan in range(2):
        folders = logs.log_folders(roots)
        one, again = (logs.fingerprint(logs.listing(t.spark, folders)).first() for _ in range(2))
        changed = before is not None and (one.mixed, one.summed) != before
        before = (one.mixed, one.summed)
        row = t.table("events").limit(1).select(F.lit(scan).cast("bigint").alias("scan"), F.lit(2 * (scan + 1)).cast("bigint").alias("roots"), F.lit(changed).alias("changed"), F.lit(one == again).alias("stable"))
        rows = row if rows is None else rows.unionByName(row)
        _write_jsonl(_json_lines(t).limit(3), f"{roots[0]}/projects/later")
    return rows


@query("log_versions", "select '1.' || cast(line % 4 as varchar) as version, count(*) as events from raw where line % 5 > 0 group by 1")
def log_versions(t):
    """Versions stand in system lines; those of other lines do not count."""
    version = F.concat(F.lit('{"version":"1.'), F.pmod("line", F.lit(4)).cast("string"), F.lit('",'), F.expr("substring(value, 2)"))
    system = F.replace(version, F.lit('"type":"assistant"'), F.lit('"type":"system"'))
    return logs.log_versions(logs.events(_json_lines(t).withColumn("value", F.when(F.pmod("line", F.lit(5)) > 0, system).otherwise(version))))


@query("synthetic_dropped", "select line, session_id, cost_units from turns")
def synthetic_dropped(t):
    """Synthetic markers beside the responses, with keys of their own and of others: none becomes a turn."""
    marks = t.raw.filter(F.pmod("line", F.lit(3)) == 0).withColumns({"model": F.lit("<synthetic>"), "line": F.col("line") + 1_000_000_000})
    return turn_plan.build_turns(t.raw.unionByName(marks)).select("line", "session_id", "cost_units")


@query("strict_turns", "select line, session_id, cost_units from turns where dedup_key is not null and not is_interrupted and price_tag is null")
def strict_turns(t):
    """The strict form passes where no turn carries an assumption."""
    clean = t.turns.filter(F.size("tags") == 0)
    return turn_plan.assert_no_assumptions(clean).select("line", "session_id", "cost_units")


@query("hot_warm_sessions", f"select session_id, turns, last_ts >= timestamp '{AS_OF}' - interval 7 day as hot from sessions")
def hot_warm_sessions(t):
    """Sessions of the last week first, then those that only history knows."""
    store = _history(t)
    _turns, hot = store.hot(7, AS_OF)
    merged = history.merge_tiers(hot.withColumn("hot", F.lit(True)), store.sessions().withColumn("hot", F.lit(False)), key="session_id")
    return merged.select("session_id", "turns", "hot")


# -- history -------------------------------------------------------------------


def _history(t, overlapping: bool = False) -> history.History:
    """The turns in a new history; on request as two overlapping flushes, the second one twice."""
    store = history.History(t.spark, _folder(t, "history"))
    if overlapping:
        first = t.turns.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp"))
        store.append(first, dedup.session_dimension(t.raw, first), flush=0)
        store.append(t.turns, t.sessions, flush=1)
    store.append(t.turns, t.sessions, flush=1)
    return store


@query("history_append", f"select cast(ts::date as varchar) as date, count(*) as turns, {sql.usd()} as cost_usd from turns group by 1")
def history_append(t):
    return _history(t, overlapping=True).turns().groupBy("date").agg(F.count(F.lit(1)).alias("turns"), usd_sum(F.col("cost_units")).alias("cost_usd"))


@query("history_sessions", "select session_id, source_file, cwd, is_sidechain, cast(first_ts as varchar) as first_ts, cast(last_ts as varchar) as last_ts, turns from sessions")
def history_sessions(t):
    return _history(t, overlapping=True).sessions()


@query("history_query", """
select line, session_id from turns join sessions using (session_id) where ts::date between date '2024-01-05' and date '2024-01-20' and model = 'claude-opus-4-7' and sessions.cwd = '/home/u/p1'""")
def history_query(t):
    return _history(t).query_turns("2024-01-05", "2024-01-20", "/home/u/p1", "claude-opus-4-7").select("line", "session_id")


@query("history_hot", f"""
with_sessions as (select session_id, count(*) as session_turns from turns group by 1)
select line, session_id, session_turns from turns join with_sessions using (session_id) where ts >= timestamp '{AS_OF}' - interval 7 day""".replace("\nwith_sessions", ", with_sessions", 1))
def history_hot(t):
    """Every turn of the last week with the turns its session has in all."""
    turns, sessions = _history(t).hot(7, AS_OF)
    return turns.select("line", "session_id").join(sessions.select("session_id", F.col("turns").alias("session_turns")), "session_id")


@query("history_high_water", "select session_id, cast(max(ts) as varchar) as last_ts from turns group by 1")
def history_high_water(t):
    return _history(t).high_water()


@query("history_session", "select line, row_number() over (order by ts, file, line) as n from turns where session_id = (select min(session_id) from turns)")
def history_session(t):
    store = _history(t)
    wanted = store.turns().agg(F.min("session_id")).first()[0]
    return store.session(wanted).select("line", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "file", "line")).alias("n")).select("line", "n")


_DROP = {
    "sessions": ("session_id in (select min(session_id) from turns)", None),
    "project": ("session_id in (select session_id from sessions where cwd = '/home/u/p1')", {"cwd": "/home/u/p1"}),
    "age": ("ts < timestamp '2024-01-10 12:00:00'", {"older_than": "2024-01-10 12:00:00"}),
    "everything": ("true", {"everything": True}),
}


def _forget(name: str, where: str, how: dict | None):
    @query(f"history_forget_{name}", f"""
select line, session_id, (select count(*) from turns where {where}) as dropped_turns, (select count(distinct session_id) from turns) - (select count(distinct session_id) from turns where not ({where})) as dropped_sessions
from turns where not ({where})""")
    def forget(t):
        """The turns that are left, and how much went."""
        store = _history(t)
        criterion = how or {"session_ids": [store.turns().agg(F.min("session_id")).first()[0]]}
        sessions, turns = store.forget(**criterion)
        if name == "age":
            store.compact()
        return store.turns().select("line", "session_id", F.lit(turns).cast("bigint").alias("dropped_turns"), F.lit(sessions).cast("bigint").alias("dropped_sessions"))

    return forget


for _name, (_where, _how) in _DROP.items():
    _forget(_name, _where, _how)


@query("hot_warm_merge", "select line, dedup_key from turns")
def hot_warm_merge(t):
    store = _history(t)
    hot, _sessions = store.hot(7, AS_OF)
    merged = history.merge_tiers(hot, store.turns())
    return merged.select("line", F.when(F.contains("turn_key", F.lit(":r")), F.col("turn_key")).alias("dedup_key"))


@query("changed_rows", f"select cast(ts::date as varchar) as date, count(*) as turns, {sql.usd()} as cost_usd from turns where ts::date = date '2024-01-15' group by 1")
def changed_rows(t):
    before = series.daily(t.turns.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp")))
    after = series.daily(t.turns.filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp")))
    columns = ["date", "turns", "cost_usd"]
    return history.changed_rows(after.select(*columns), before.select(*columns))


@query("schema_evolution", "select line, session_id, cost_units, 0::bigint as one_hour, null::varchar as skill from turns")
def schema_evolution(t):
    """Files written before three columns existed read back with their defaults."""
    store = history.History(t.spark, _folder(t, "history"))
    store.append(t.turns)
    old = history.History(t.spark, _folder(t, "old-history"))
    store.turns().drop(*history.LATER_COLUMNS).write.partitionBy("date").parquet(old.turns_path)
    return old.turns().select("line", "session_id", "cost_units", F.col("cache_creation_1h_tokens").alias("one_hour"), F.col("attribution_skill").alias("skill"))


# -- streams -------------------------------------------------------------------


#: Which of three batches brings an event; some keys recur inside a batch, some in a later one.
_BATCH = "(case when event_id % 40 = 39 then event_id // 40 + 1 else event_id // 40 end) % 3"
_LIVE = f""", live as (select * from (select lines.*, {_BATCH.replace('event_id', 'line')} as batch from lines)
  qualify dedup_key is null or row_number() over (partition by dedup_key order by batch, file desc, line desc) = 1)
"""


def _streamed(t, each=None, batch: str = _BATCH, after=None) -> str:
    """Logged responses landed in three batches; a folder with the turns, the late rows and what ``each`` keeps of a batch."""
    landing, path = _folder(t, "landing"), _folder(t, "streamed")
    events = t.table("events").withColumn("_batch", F.expr(batch.replace("//", "div")))
    each = None if each is None else each(path)
    for n in range(3):
        events.filter(F.col("_batch") == n).drop("_batch").write.mode("append").parquet(landing)
        live = shapes.Tables(t.spark, t.sf_dir)
        live.table = lambda _name: t.spark.readStream.schema(t.table("events").schema).parquet(landing)
        ingest.run_available(turn_plan.price_turns(turn_plan.responses(live.raw)), f"{path}/checkpoint", aggregates.once(path, each))
        if after is not None:
            after(path)
    return path


def _parts(t, group, merge):
    """The merged parts of a rollup over the three batches."""
    path = _streamed(t, lambda path: aggregates.keep(f"{path}/parts", group, merge))
    return aggregates.parts_of(t.spark, f"{path}/parts", merge)


@query("stream_hourly", _LIVE + f"select cast(date_trunc('hour', ts) as varchar) as hour, {sql.MEASURES} from live group by 1")
def stream_hourly(t):
    return aggregates.hours(_parts(t, aggregates.hour_parts, aggregates.by_hour))


@query("stream_sliding", _LIVE + f"""
select cast(s as varchar) as window_start, coalesce(cwd, '(unknown)') as project, count(*) as turns, sum(output_tokens)::bigint as output_tokens, {sql.usd()} as cost_usd
from live, range(0, 4) r(k), lateral (select time_bucket(interval 15 minute, ts) - k * interval 15 minute as s) group by all""")
def stream_sliding(t):
    return aggregates.sliding_hours(_parts(t, lambda turns: aggregates.sliding_parts(turns, slide="15 minutes"), aggregates.by_window))


@query("stream_sessions", _LIVE + f"select session_id, cast(min(ts) as varchar) as first_ts, cast(max(ts) as varchar) as last_ts, count(*) as turns, {sql.usd()} as cost_usd from live group by 1")
def stream_sessions(t):
    return aggregates.sessions(_parts(t, aggregates.session_parts, aggregates.by_session))


@query("stream_unique_turns", _LIVE + "select file, line, dedup_key, cast(ts as varchar) as ts, input_tokens, cost_units from live")
def stream_unique_turns(t):
    return aggregates.turns_of(t.spark, _streamed(t)).select("file", "line", "dedup_key", "ts", "input_tokens", "cost_units")


@query("stream_late", _LIVE + """
select l.batch::bigint as batch, l.file, l.line from live l
where l.ts < (select max(e.ts) - interval 1 day from live e where e.batch < l.batch)""")
def stream_late(t):
    """Rows more than a day behind the batches before theirs; they count in their own hours all the same."""
    return aggregates.late_rows(t.spark, _streamed(t)).select(F.col("batch").cast("bigint").alias("batch"), "file", "line")


_WINDOWS = sql.windows("session_id").replace("from turns where", "from user_turns where").replace(", hours as (", """, user_turns as (
  select * replace (regexp_extract(file, 'u(\\d+)\\.jsonl$', 1) as session_id), input_tokens + cache_read_tokens + cache_creation_tokens as ctx from live), hours as (""", 1)


@query("stream_windows", _LIVE + _WINDOWS + """, placed as (
  select w.session_id, w.start, w.units, w.tokens, (select min((ts, file, line)) from user_turns t where not is_interrupted and t.session_id = w.session_id and t.ts >= w.start) as first from wins w)
select p.session_id, cast(start as varchar) as window_start, units::double / 1e10 as cost_usd, tokens as total_tokens,
  (select count(*) from user_turns t where t.session_id = p.session_id and t.ts >= p.start and t.ts < p.start + interval 5 hour and (not is_interrupted or (ts, file, line) > p.first)) as turns
from placed p""", prelude=sql.recursive(ORACLE_TURNS))
def stream_windows(t):
    """Each batch adds hourly parts; windows follow from the parts of all batches."""
    def parts(turns):
        return aggregates.window_parts(turns.withColumn("session_id", F.regexp_extract("file", r"u(\d+)\.jsonl$", 1)), ["session_id"])

    windows = aggregates.open_windows(_parts(t, parts, aggregates.by_key_and_hour("session_id")), ["session_id"])
    return windows.select("session_id", "window_start", "cost_usd", "total_tokens", "turns")


#: Batches in the order of time; a quarter of the last three hours before a cut comes with the next one.
_CUTS = "(case when ts < timestamp '2024-01-11' - interval {late} hour then 0 when ts < timestamp '2024-01-21' - interval {late} hour then 1 else 2 end)"
_IN_TIME = f"case when event_id % 4 = 1 then {_CUTS.format(late=3)} else {_CUTS.format(late=0)} end"
_PROJECTED = f"""with_batch as (select event_id, {_IN_TIME} as batch from events
), live as (select * from (select lines.*, b.batch from lines join with_batch b on b.event_id = lines.line)
  qualify dedup_key is null or row_number() over (partition by dedup_key order by batch, file desc, line desc) = 1
), live_turns as (select *, coalesce(cwd, '(unknown)') as key from live
), moments as (select a.key, a.batch, (select date_trunc('minute', max(ts)) + interval 1 minute from live_turns t where t.key = a.key and t.batch <= a.batch) as as_of
  from (select distinct key, batch from live_turns) a
), recent as (
  select t.* exclude (batch, key), m.as_of, m.key, m.batch, m.key || '|' || m.batch as scope, t.input_tokens + t.cache_read_tokens + t.cache_creation_tokens as ctx
  from live_turns t join moments m on m.key = t.key and t.batch <= m.batch and t.ts >= m.as_of - interval 10 hour)"""


@query("stream_projection", ", " + _PROJECTED + sql.windows("scope").replace("from turns where", "from recent where") + """, active as (
  select scope, max(start) as start, arg_max(units, start)::double / 1e10 as cost_usd from wins group by scope
), opened_at as (select r.scope, min((ts, file, line)) as f from recent r join active a on a.scope = r.scope and not is_interrupted and ts >= start group by r.scope
), burnt as (
  select r.scope, count(*) as recent_turns, sum(cost_units)::double / 1e10 as recent_cost from recent r join active a using (scope) join opened_at o on o.scope = r.scope
  where ts >= as_of - interval 120 minute and ts >= start and ts < start + interval 5 hour and (not is_interrupted or (ts, file, line) > f) group by r.scope
), told as (select m.key, m.batch, m.as_of, a.*, coalesce(recent_turns, 0) as recent_turns, coalesce(recent_cost, 0) as recent_cost,
    (epoch_us(start + interval 5 hour) - epoch_us(as_of)) / 3.6e9::double as remaining_hours
  from moments m join active a on a.scope = m.key || '|' || m.batch left join burnt b on b.scope = a.scope where start + interval 5 hour >= as_of)
select key, batch::bigint as batch, cast(as_of as varchar) as as_of, cast(start as varchar) as window_start, cast(start + interval 5 hour as varchar) as window_end, cost_usd, recent_turns, recent_cost,
  recent_cost / 2.0::double as burn_rate_usd_per_hour, (epoch_us(as_of) - epoch_us(start)) / 3.6e9::double as elapsed_hours, remaining_hours,
  cost_usd + recent_cost / 2.0::double * remaining_hours as projected_cost, cost_usd + recent_cost / 2.0::double * remaining_hours > 50 as over_reference
from told""", prelude=sql.recursive(ORACLE_TURNS))
def stream_projection(t):
    """Three batches in the order of time, the stream stopped and started again between them: the window open in each project after each batch."""
    path = _folder(t, "projected")
    def minutes(streamed):
        return lambda turns, n: ingest.append_updates(f"{streamed}/minutes")(projection.minute_parts(turns, "cwd"), n)

    _streamed(t, minutes, _IN_TIME, lambda streamed: projection.run(t.spark, f"{streamed}/minutes", path, 120))
    return projection.projections(t.spark, path)


@query("stream_tool_costs", "select file, line, tool, round(in_tok, 4) as tool_input_tokens, round(out_tok, 4) as tool_output_tokens, round(usd, 9) as tool_usd, round(usd_x, 9) as tool_usd_uncached from tt", prelude=SPLIT)
def stream_tool_costs(t):
    """Four batches of log lines, each split from its own lines and the saved state of its files; the turns go to a history with their slices."""
    store = history.History(t.spark, _folder(t, "history"))
    states = tallies.states(t.spark, f"{store.root}/tallies")
    cuts = [r.line for r in t.table("events").select(F.col("event_id").alias("line")).agg(F.percentile_approx("line", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("at")).select(F.explode("at").alias("line")).collect()]
    for n, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        new = (F.lit(True) if low is None else F.col("line") > low) & (F.lit(True) if high is None else F.col("line") <= high)
        per_tool, rest = tallies.split_batch(states, t.lines.filter(new), t.event_blocks.filter(new), n)
        store.append(history.with_slices(t.turns.filter(new), per_tool, rest), flush=n)
    rows = store.split()[0]
    return rounded(rounded(rows, 9, "tool_usd", "tool_usd_uncached"), 4, "tool_input_tokens", "tool_output_tokens")


@query("stream_forget", """
select line, session_id from turns where (ts >= timestamp '2024-01-05 00:00:00' and session_id not in (select session_id from sessions where cwd = '/home/u/p1') and session_id <> (select min(session_id) from turns))
  or line = (select max(line) from turns where session_id = (select min(session_id) from turns))""")
def stream_forget(t):
    """Requests for a session, a directory and an age run once; a turn of the deleted session that comes back afterwards stays."""
    store, requests = history.History(t.spark, _folder(t, "history")), _folder(t, "requests")
    store.append(t.turns, t.sessions)
    one = t.turns.agg(F.min("session_id").alias("session_id"))
    asked = one.selectExpr("session_id", "cast(null as string) as cwd", "cast(null as timestamp) as older_than")
    rest = t.spark.sql("select cast(null as string) as session_id, cwd, cast(older_than as timestamp) as older_than from values ('/home/u/p1', null), (null, '2024-01-05') as v(cwd, older_than)")
    asked.unionByName(rest).write.json(requests)
    ingest.apply_requests(store, requests)
    again = t.turns.join(one, "session_id", "left_semi")
    last = again.groupBy("session_id").agg(F.max("line").alias("line"))
    store.append(again.join(last, ["session_id", "line"], "left_semi").select(*t.turns.columns), flush=1)
    ingest.apply_requests(store, requests)
    return store.turns().select("line", "session_id")


@query("stream_history", """
select cast(ts::date as varchar) as date, count(*) as turns from (
  select * from raw qualify dedup_key is null or row_number() over (partition by dedup_key order by line desc) = 1) group by 1""")
def stream_history(t):
    """Landed log files into the history through a stream, then a deletion request that matches nothing."""
    folder, root = _folder(t, "landing"), _folder(t, "streamed")
    _json_lines(t).select("value").write.text(folder)
    store = history.History(t.spark, root)
    lines = logs.located(t.spark.readStream.format("text").load(folder), placed=False)
    ingest.run_available(lines, f"{root}/checkpoint", ingest.into_history(store, f"{root}/requests"))
    return store.turns().groupBy("date").agg(F.count(F.lit(1)).alias("turns"))

