"""Sessions, five-hour windows, projects and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnledger.catalog import sql
from turnledger.catalog.base import query, rounded
from turnledger.catalog.shapes import AS_OF, AS_OF_DAY, ORACLE_TURNS
from turnledger.functions import paths, pricing
from turnledger.operators import entity, patterns, series, windows5h
from turnledger.plans import panels, rollups

RECURSIVE = sql.recursive(ORACLE_TURNS)
LIMITS = {"window_usd": 0.15, "creep_input": 90_000, "creep_slope": 2000.0, "storm_uses": 4, "storm_rate": 0.3, "sidechain_usd": 0.05}
VERDICT = sql.verdict(0.15, 90_000, 2000, 4, 0.3, 0.05)
SESSION_SQL = sql.windows("session_id") + sql.ROLLUPS


def session_rows(t):
    """Rollups with verdict limits low enough to matter on these tables."""
    return rollups.session_rollups(t.turns, t.sessions, LIMITS)


@query("session_dimension", """
select session_id, source_file, cwd, is_sidechain, cast(first_ts as varchar) as first_ts, cast(last_ts as varchar) as last_ts, turns from sessions""")
def session_dimension(t):
    return t.sessions


@query("turn_index", "select line, session_id, row_number() over (partition by session_id order by ts, file, line) - 1 as turn_idx from turns")
def turn_index(t):
    return patterns.numbered(t.lazy_turns).select("line", "session_id", "turn_idx")


@query("session_rollup", SESSION_SQL + f"""
select session_id, source_file, cwd, is_sidechain, cast(first_ts as varchar) as first_ts, cast(last_ts as varchar) as last_ts, turns,
  input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, cost_usd, max_turn_input, context_growth,
  tool_use_count, tool_error_count, latest_ctx, model, peak_window_cost, ctx_used,
  {sql.over("cache_read_tokens", "(cache_read_tokens + cache_creation_tokens)")} as cache_reuse_ratio, {sql.hit_rate()} as cache_hit_rate,
  {sql.over("cache_read_tokens", "output_tokens")} as ctx_ratio, {sql.over("cache_read_tokens", "cache_creation_tokens")} as cache_reuse,
  {sql.cost_per_kw()} as cost_per_kw, coalesce({sql.over("tool_error_count", "tool_use_count")}, 0) as tool_error_rate, {VERDICT} as verdict
from rollups""", prelude=RECURSIVE)
def session_rollup(t):
    return session_rows(t)


@query("session_totals", f"select session_id, {sql.SUMS}, {sql.usd()} as cost_usd from turns group by 1")
def session_totals(t):
    return rollups.session_totals(t.lazy_turns)


@query("session_tool_mix", "select session_id, tool_name as tool, sum(tool_use_count)::bigint as calls from turns where tool_name is not null group by all")
def session_tool_mix(t):
    return rollups.tool_calls(t.lazy_turns, ["session_id"])


@query("tool_mix", """, c as (select tool_name as tool, sum(tool_use_count)::bigint as n from turns where tool_name is not null group by 1
), r as (select *, row_number() over (order by n desc, tool) as rn from c)
select case when rn <= 2 then tool else 'others' end as tool, sum(n)::bigint as count from r group by 1""")
def tool_mix(t):
    return rollups.tool_mix(t.turns, top=2)


@query("dominant_model", """
select session_id, arg_min(model, (-n, seen)) as model from (
  select session_id, model, count(*) as n, min((ts, file, line)) as seen from turns where model is not null group by all) group by 1""")
def dominant_model(t):
    return rollups.dominant_model(t.lazy_turns, ["session_id"])




@query("anchored_windows", sql.windows("session_id").replace("from turns where", "from user_sessions where").replace(
    ", hours as (", ", user_sessions as (select * replace (regexp_extract(file, 'u(\\d+)\\.jsonl$', 1) as session_id) from turns), hours as (", 1) + """
, firsts as (select w.session_id, w.start, min((t.ts, t.file, t.line)) as first from wins w join user_sessions t
    on t.session_id = w.session_id and not t.is_interrupted and t.ts >= w.start and t.ts < w.start + interval 5 hour group by all)
select w.session_id, cast(w.start as varchar) as window_start, cast(w.start + interval 5 hour as varchar) as window_end,
  w.billed + (select count(*) from user_sessions t where t.session_id = w.session_id and t.is_interrupted
     and t.ts < w.start + interval 5 hour and (t.ts, t.file, t.line) > f.first) as turns,
  w.tokens as total_tokens, w.units::double / 1e10 as cost_usd
from wins w join firsts f using (session_id, start)""", prelude=RECURSIVE)
def anchored_windows(t):
    return windows5h.anchored_windows(t.user_turns, ["session_id"]).drop("first_billed")


@query("peak_window_cost", sql.windows("session_id") + "select session_id, max(units)::double / 1e10 as peak_window_cost from wins group by 1", prelude=RECURSIVE)
def peak_window_cost(t):
    return windows5h.peak_window_cost(t.lazy_turns, ["session_id"])


_NOW = f"timestamp '{AS_OF}'"


@query("burn_projection", f""", recent as (select *, 'all' as scope from turns where ts >= {_NOW} - interval 10 hour and ts <= {_NOW}
)""" + sql.windows("scope").replace("from turns where", "from recent where") + f""", active as (
  select start, start + interval 5 hour as fin, units::double / 1e10 as cost_usd from wins order by start desc limit 1
), first_turn as (select min((ts, file, line)) as f from recent, active where not is_interrupted and ts >= start and ts < fin
), burnt as (select count(*) as recent_turns, coalesce(sum(cost_units), 0)::double / 1e10 as recent_cost from recent, active, first_turn
  where ts >= {_NOW} - interval 120 minute and ts >= start and ts < fin and (not is_interrupted or (ts, file, line) > f))
select cast(start as varchar) as window_start, cast(fin as varchar) as window_end, cost_usd, recent_turns, recent_cost, recent_cost / 2.0::double as burn_rate_usd_per_hour,
  (epoch_us({_NOW}) - epoch_us(start)) / 3.6e9::double as elapsed_hours, greatest(epoch_us(fin) - epoch_us({_NOW}), 0) / 3.6e9::double as remaining_hours,
  cost_usd + recent_cost / 2.0::double * (greatest(epoch_us(fin) - epoch_us({_NOW}), 0) / 3.6e9::double) as projected_cost,
  cost_usd + recent_cost / 2.0::double * (greatest(epoch_us(fin) - epoch_us({_NOW}), 0) / 3.6e9::double) > 50 as over_reference
from active, burnt where fin >= {_NOW}""", prelude=RECURSIVE)
def burn_projection(t):
    return windows5h.burn_projection(t.turns, AS_OF, 120)


_VERDICTS = "(values ('RUNAWAY_WINDOW'), ('CONTEXT_CREEP'), ('TOOL_ERROR_STORM'), ('SIDECHAIN_HEAVY'), ('OK'))"


@query("verdict_distribution", SESSION_SQL + f"""
select verdict, coalesce(n, 0) as sessions from {_VERDICTS} v(verdict) left join (select {VERDICT} as verdict, count(*) as n from rollups group by 1) using (verdict)""", prelude=RECURSIVE)
def verdict_distribution(t):
    return rollups.verdict_counts(session_rows(t))


@query("growth_histogram", SESSION_SQL + """
select bucket, label, coalesce(n, 0) as sessions from (values (0, '<500'), (1, '500-1k'), (2, '1k-2k'), (3, '2k-5k'), (4, '5k-10k'), (5, '10k+')) b(bucket_, label)
cross join lateral (select bucket_::bigint as bucket) left join (
  select (context_growth >= 500)::bigint + (context_growth >= 1000)::bigint + (context_growth >= 2000)::bigint + (context_growth >= 5000)::bigint + (context_growth >= 10000)::bigint as bucket,
    count(*) as n from rollups group by 1) using (bucket)""", prelude=RECURSIVE)
def growth_histogram(t):
    return rollups.growth_histogram(session_rows(t))


def _top(sort: str, column: str):
    expr = "(epoch_us(last_ts) - epoch_us(first_ts)) / 1e6::double" if sort == "duration" else column

    @query(f"top_sessions_{sort}", SESSION_SQL + f"select session_id, {expr} as {column} from rollups order by 2 desc, 1 limit 10", prelude=RECURSIVE)
    def top(t):
        return rollups.top_sessions(session_rows(t), sort, 10).select("session_id", column)

    return top


for _sort, _column in rollups.SORT_KEYS.items():
    _top(_sort, _column)


def project_sql(key: str, source: str = "rollups", final: str = "select * from flags") -> str:
    counts = ", ".join(f"count(*) filter (verdict = '{v}') as n_{v.lower()}" for v in ("RUNAWAY_WINDOW", "CONTEXT_CREEP", "TOOL_ERROR_STORM", "SIDECHAIN_HEAVY", "OK"))
    return f""", judged as (select r.*, {VERDICT} as verdict from {source} r), proj as (
  select {key} as cwd, count(*) as sessions, sum(turns)::bigint as turns, {sql.SUMS}, sum(round(cost_usd * 1e10)::bigint)::double / 1e10 as cost_usd,
    coalesce(avg(context_growth) filter (context_growth <> 0), 0) as avg_context_growth, sum(tool_use_count)::bigint as tool_use_count,
    sum(tool_error_count)::bigint as tool_error_count, max(peak_window_cost) as peak_window_cost, arg_max({{'v': ctx_used}}, (last_ts, session_id)).v as ctx_used, {counts}
  from judged group by 1
), rated as (select *, {sql.over("cache_read_tokens", "(cache_read_tokens + cache_creation_tokens)")} as cache_reuse_ratio, {sql.hit_rate()} as cache_hit_rate,
    cache_creation_tokens / greatest(cache_read_tokens, 1) as cache_creation_dominance, coalesce({sql.over("tool_error_count", "tool_use_count")}, 0) as tool_error_rate,
    {sql.over("cache_read_tokens", "output_tokens")} as ctx_ratio, {sql.over("cache_read_tokens", "cache_creation_tokens")} as cache_reuse, {sql.cost_per_kw()} as cost_per_kw
  from proj
), flags as (select * replace (round(avg_context_growth, 4) as avg_context_growth), coalesce(cache_hit_rate < 0.25::double, false) or cache_creation_dominance > 1 or avg_context_growth > 2000
  or tool_error_rate > 0.1::double or n_ok < sessions as flagged from rated)
{final}
"""


@query("project_rollup", SESSION_SQL + project_sql("coalesce(cwd, '(unknown)')"), prelude=RECURSIVE)
def project_rollup(t):
    return rounded(rollups.project_rollups(session_rows(t)), 4, "avg_context_growth")


@query("project_model_mix", SESSION_SQL + """
select cwd, model, round(case when sum(u) over (partition by cwd) > 0 then u / sum(u) over (partition by cwd) else u::double end, 10) as share from (
  select coalesce(cwd, '(unknown)') as cwd, model, sum(cost_usd) as u from rollups where model is not null group by all)""", prelude=RECURSIVE)
def project_model_mix(t):
    return rounded(rollups.project_model_mix(session_rows(t)), 10, "share")


_COMPONENTS = ", ".join(f"{sql.usd(c + '_units')} as {c}_usd" for c in rollups.COMPONENTS)
_MODELS = f""", models as (
  select coalesce(model, '(unknown)') as model, count(*) as turns, {sql.SUMS}, {sql.usd()} as cost_usd, sum(tool_use_count)::bigint as tool_use_count,
    sum(tool_error_count)::bigint as tool_error_count, {_COMPONENTS}, count(*) filter (is_sidechain) as sidechain_turns, count(*) filter (is_interrupted) as interrupted_turns
  from turns group by 1
), rated as (select *, {sql.hit_pct()} as hit_pct, {sql.over("cache_read_tokens", "output_tokens")} as ctx_ratio, {sql.over("cache_read_tokens", "cache_creation_tokens")} as cache_reuse,
    {sql.cost_per_kw()} as cost_per_kw, {sql.over("tool_error_count", "tool_use_count")} as tool_error_rate, round(cost_usd / sum(cost_usd) over (), 10) as cost_share from models)
"""


@query("model_rollup", _MODELS + "select * from rated")
def model_rollup(t):
    return rounded(rollups.model_rollups(t.lazy_turns), 10, "cost_share")


@query("models_panel", _MODELS + f"""
select model, {sql.SHORT_MODEL.replace("model is null", "model = '(unknown)'")} as short_name, (select context_window // 1000 from price where price_key = model) as context_window_k, cost_share from rated""")
def models_panel(t):
    return rounded(panels.models_panel(t.lazy_turns), 10, "cost_share").select("model", "short_name", "context_window_k", "cost_share")


@query("models_aggregate", _MODELS + f"""
select count(*) as active_count, arg_max({sql.SHORT_MODEL}, (cost_usd, model)) as dominant, arg_max(cost_share, (cost_usd, model)) as dominant_share from rated""")
def models_aggregate(t):
    return rounded(panels.models_aggregate(panels.models_panel(t.lazy_turns)), 10, "dominant_share")


@query("models_in_window", _MODELS.replace("from turns group by 1", f"from turns where ts::date >= date '{AS_OF_DAY}' - 6 group by 1") + """
select model, turns, cost_usd, case when turns > 0 then sidechain_turns / turns else 0 end as sidechain_ratio, case when turns > 0 then interrupted_turns / turns else 0 end as interrupted_rate from rated""")
def models_in_window(t):
    scoped = series.in_days(t.lazy_turns, series.range_start("7d", AS_OF_DAY), None)
    return rollups.model_rollups(scoped).select(
        "model", "turns", "cost_usd", (F.col("sidechain_turns") / F.col("turns")).alias("sidechain_ratio"),
        (F.col("interrupted_turns") / F.col("turns")).alias("interrupted_rate"),
    )


@query("sessions_in_window", SESSION_SQL + f"""
select session_id, cost_usd, turns from rollups where last_ts::date >= date '{AS_OF_DAY}' - 6 order by cost_usd desc, session_id limit 20""", prelude=RECURSIVE)
def sessions_in_window(t):
    rows = session_rows(t).filter(F.to_date("last_ts") >= F.lit(series.range_start("7d", AS_OF_DAY)).cast("date"))
    return rollups.top_sessions(rows, "cost", 20).select("session_id", "cost_usd", "turns")


@query("cwd_ancestor", sql.PROJECTS + "select * from projects")
def cwd_ancestor(t):
    return entity.canonical_cwd(t.sessions)


_DIRS = """, dirs as (select distinct d from (select cwd as d from raw where cwd is not null
  union all select '/home/u/p' || cast(user_id % 3 as varchar) || '/src/app' from events union all select '/home/v/q' || cast(user_id % 2 as varchar) || '/src/app/' from events
  union all select '/srv/' || cast(user_id % 4 as varchar) || '/lib/mod0' from events))
"""


@query("cwd_labels", _DIRS + """, based as (select d as cwd, list_last(string_split(d, '/')) as base from dirs
), sized as (select *, count(*) over (partition by base) as members from based
), tried as (select cwd, base, members, s, array_to_string(list_slice(string_split(trim(cwd, '/'), '/'), -s, -1), '/') as label from sized, range(2, 21) r(s) where members > 1
), solved as (select base, min(s) as s from (select base, s, members, count(distinct label) as k from tried group by all) where k = members group by 1
)
select z.cwd, case when z.members = 1 then z.base when v.s is null then z.cwd else t.label end as label
from sized z left join solved v using (base) left join tried t on t.cwd = z.cwd and t.s = v.s""")
def cwd_labels(t):
    users = t.table("events").select("user_id")
    made = users.select(
        F.explode(F.array(
            F.format_string("/home/u/p%d/src/app", F.col("user_id") % 3),
            F.format_string("/home/v/q%d/src/app/", F.col("user_id") % 2),
            F.format_string("/srv/%d/lib/mod0", F.col("user_id") % 4),
        )).alias("cwd")
    )
    dirs = t.raw.filter("cwd is not null").select("cwd").unionByName(made)
    return entity.labels(dirs)


@query("active_entities", sql.PROJECTS + f"""
select 'project' as kind, list_last(string_split(project, '/')) as label, project as value from (select distinct project from projects where project <> '(unknown)')
union all
select 'model', label, arg_min(model, seen) from (select {sql.SHORT_MODEL} as label, model, min((ts, file, line)) as seen from turns where model is not null group by all) group by label""")
def active_entities(t):
    return entity.active_entities(t.turns, entity.canonical_cwd(t.sessions))


_RECENT = f""", recent as (select t.*, p.project from turns t join projects p using (session_id) where ts >= {_NOW} - interval 240 minute
), last_turn as (select project, arg_max({{'ts': ts, 'sid': session_id, 'model': model, 'ctx': ctx}}, (ts, file, line)) as l from recent group by 1
), primary_model as (select project, arg_min(model, (-n, seen)) as m from (select project, model, count(*) as n, min((ts, file, line)) as seen from recent where model is not null group by all) group by 1
), rolled as (select project, count(distinct project) as projects, count(*) as turns, {sql.SUMS}, {sql.usd()} as cost_usd from recent group by project
  union all select null, count(distinct project), count(*), {sql.SUMS}, {sql.usd()} from recent)
"""


@query("recent_activity", sql.PROJECTS + _RECENT + f"""
select r.project, case when r.project is not null then coalesce({sql.SHORT_MODEL.replace("model", "m.m")}, '(unknown)') end as model_primary, cast(l.l.ts as varchar) as last_turn_at, l.l.sid as latest_session_id,
  projects, turns, output_tokens, cost_usd, l.l.ctx / (select context_window from price where price_key = l.l.model) as ctx_used, {sql.efficiency("r.")},
  case when r.project is null then (select string_agg(model || '=' || printf('%.6f', units / whole + 1e-9::double), ',' order by units desc, model) from (
    select {sql.SHORT_MODEL} as model, sum(cost_units)::double as units, sum(sum(cost_units)) over ()::double as whole from recent where model is not null group by 1)) end as model_mix
from rolled r left join last_turn l on l.project = r.project left join primary_model m on m.project = r.project""")
def recent_activity(t):
    rows = panels.recent_activity(t.turns, entity.canonical_cwd(t.sessions), AS_OF, 240)
    share = F.array_join(F.transform("model_mix", lambda m: F.concat(m["model"], F.lit("="), F.format_string("%.6f", m["share"] + 1e-9))), ",")
    return rows.withColumn("model_mix", share)


def _timeline(name, metric_sql, metric, bucket, since, until, project="all", model="all", top=None):
    unit = "ts::date" if bucket == "day" else "date_trunc('hour', ts)"
    label = "project" if project != "all" else "model" if model != "all" else "'all'"
    keep = "true"
    if project not in ("all", "compare"):
        keep = "project in (" + ",".join(f"'{p}'" for p in project.split(",")) + ")"
    if model not in ("all", "compare"):
        keep = "model in (" + ",".join(f"'{m}'" for m in model.split(",")) + ")"
    if project == "compare":
        keep = "project <> '(unknown)'"
    if model == "compare":
        keep = "model is not null"
    step = "day" if bucket == "day" else "hour"
    stop = f"timestamp '{until} 00:00:00'" if bucket == "day" else f"timestamp '{until} 23:00:00'"
    text = sql.PROJECTS + f""", rows as (select {label} as label, {unit} as bucket, t.* from turns t join projects p using (session_id)
  where ts::date between date '{since}' and date '{until}' and {keep}
), names as (select label, sum(cost_units) as c from rows group by 1 order by c desc, label limit 8
), cells as (select n.label, b from names n, generate_series(timestamp '{since} 00:00:00', {stop}, interval 1 {step}) g(b)
), sums as (select label, bucket, count(*) as turns, {sql.SUMS}, {sql.usd()} as cost_usd from rows group by all
), full_rows as (select c.label, c.b, coalesce(turns, 0) as turns, coalesce(input_tokens, 0) as input_tokens, coalesce(output_tokens, 0) as output_tokens, coalesce(cache_read_tokens, 0) as cache_read_tokens,
    coalesce(cache_creation_tokens, 0) as cache_creation_tokens, coalesce(cost_usd, 0) as cost_usd from cells c left join sums s on s.label = c.label and s.bucket = c.b)
select label, {"cast(b::date as varchar)" if bucket == "day" else "cast(b as varchar)"} as bucket, {metric_sql} as value, turns from full_rows"""

    @query(name, text)
    def timeline(t):
        return panels.timeline(t.turns, entity.canonical_cwd(t.sessions), metric, bucket, since, until, project, model)

    return timeline


_timeline("timeline_daily_hit", sql.hit_pct(), "hit_pct", "day", "2024-01-01", AS_OF_DAY)
_timeline("timeline_daily_projects", sql.cost_per_kw(), "cost_per_kw", "day", "2024-01-01", AS_OF_DAY, project="compare")
_timeline("timeline_daily_models", sql.over("cache_read_tokens", "output_tokens"), "ctx_ratio", "day", "2024-01-01", AS_OF_DAY, model="compare")
_timeline("timeline_hourly_models", "cost_usd", "cost", "hour", "2024-01-10", "2024-01-10", model="claude-opus-4-7,claude-sonnet-9")
_timeline("timeline_hourly_project", "output_tokens::double", "output", "hour", "2024-01-10", "2024-01-11", project="/home/u/p1")


@query("timeline_all", f""", sums as (select ts::date as b, count(*) as turns, {sql.SUMS}, {sql.usd()} as cost_usd from turns where ts >= timestamp '2024-01-09 00:00:00' group by 1)
select 'all' as label, cast(d::date as varchar) as bucket, coalesce(cost_usd, 0) as value, coalesce(turns, 0) as turns
from generate_series((select min(b) from sums)::timestamp, timestamp '{AS_OF_DAY} 00:00:00', interval 1 day) g(d) left join sums on b = d::date""")
def timeline_all(t):
    """Turns begin on the ninth; the range without a start does too."""
    later = t.turns.filter(F.col("ts") >= F.lit("2024-01-09").cast("timestamp"))
    return panels.timeline(later, entity.canonical_cwd(t.sessions), "cost", "day", None, AS_OF_DAY)


@query("timeline_overlay", f""", sums as (select ts::date as b, count(*) as turns, {sql.SUMS}, {sql.usd()} as cost_usd from turns group by 1)
select 'all' as label, cast(b as varchar) as bucket, {sql.hit_pct()} as value, turns, case when b >= date '2024-01-15' then cost_usd end as secondary from sums""")
def timeline_overlay(t):
    projects = entity.canonical_cwd(t.sessions)
    first = panels.timeline(t.turns, projects, "hit_pct", "day", "2024-01-01", AS_OF_DAY)
    return panels.overlay(first, panels.timeline(t.turns, projects, "cost", "day", "2024-01-15", AS_OF_DAY))


def _b64(x: str) -> str:
    return f"replace(replace(rtrim(to_base64(encode({x})), '='), '+', '-'), '/', '_')"


_LEAF = "list_last(string_split(coalesce(cwd, '(unknown)'), '/'))"
_LABEL = f"{_LEAF} || ' — ' || left(session_id, 8)"


def _score(target: str, wanted: str) -> str:
    return f"case when starts_with({target}, '{wanted}') then 1.0::double when contains({target}, '{wanted}') then 0.7::double else 0.0::double end"


def _search(name: str, text: str, body: str, needs_rollups: bool = False):
    top = "select * from hits where score > 0 order by score desc, kind, href limit 20"
    prefix = SESSION_SQL if needs_rollups else sql.PROJECTS

    @query(name, prefix + f", hits as ({body}) {top}", prelude=RECURSIVE if needs_rollups else ORACLE_TURNS)
    def run(t):
        rows = session_rows(t) if needs_rollups else None
        return panels.search(text, t.turns, t.sessions, rows)

    return run


_search("search_session", "session:s1", f"select 'session' as kind, {_LABEL} as label, '/session/' || session_id as href, {_score('session_id', 's1')} as score from sessions")
_search("search_cwd", "cwd: /home/u/P", f"select 'project' as kind, list_last(string_split(project, '/')) as label, '/project/' || {_b64('project')} as href, {_score('lower(project)', '/home/u/p')} as score from (select distinct project from projects)")
_search("search_model", "model:sonnet", f"select 'model' as kind, {sql.SHORT_MODEL} as label, '/model/' || {sql.SHORT_MODEL} as href, case when contains(model, 'sonnet') and not starts_with(model, 'sonnet') then 0.7::double when starts_with(model, 'sonnet') then 1.0::double else 0.0::double end as score from (select distinct model from turns where model is not null)")
_search("search_date", "date:2024-01-1", f"select 'day' as kind, d as label, '/day/' || d as href, {_score('d', '2024-01-1')} as score from (select distinct cast(ts::date as varchar) as d from turns)")
_search("search_verdict", "verdict:runaway", f"select 'session' as kind, {_LEAF} || ' — RUNAWAY_WINDOW' as label, '/session/' || session_id as href, 1.0::double as score from (select *, {VERDICT} as v from rollups) where v = 'RUNAWAY_WINDOW'", True)
_search("search_text", "p1", f"""select 'session' as kind, {_LABEL} as label, '/session/' || session_id as href, greatest({_score("lower(coalesce(cwd, '(unknown)'))", 'p1')}, {_score('session_id', 'p1')}) as score from sessions
  union all select 'project', list_last(string_split(c, '/')), '/project/' || {_b64('c')}, {_score('lower(c)', 'p1')} from (select distinct coalesce(cwd, '(unknown)') as c from sessions)""")


@query("path_scalars", f"""
select cwd, {_b64('cwd')} as cwd_b64, cwd as decoded, list_last(string_split(cwd, '/')) as base, '//host' || replace(cwd, 'home', 'share') as unc, 'C:' || cwd as drive,
  cwd || '\\x' as posix from (select distinct cwd from raw where cwd is not null)""")
def path_scalars(t):
    cwd = F.col("cwd")
    code = paths.encode_cwd(cwd)
    windows = F.translate(cwd, "/", "\\")
    unc = F.concat(F.lit("\\\\host"), F.replace(windows, F.lit("home"), F.lit("share")))
    return t.raw.filter("cwd is not null").select("cwd").distinct().select(
        "cwd", code.alias("cwd_b64"), paths.decode_cwd(code).alias("decoded"), paths.basename(cwd).alias("base"),
        paths.normalise_cwd(unc).alias("unc"), paths.normalise_cwd(F.concat(F.lit("C:"), windows)).alias("drive"),
        paths.normalise_cwd(F.concat(cwd, F.lit("\\x"))).alias("posix"),
    )


@query("display_models", f"""
select distinct model, case when model is null then '—' else regexp_replace(regexp_replace(regexp_replace(model, '^claude-', ''), '-[0-9]{{8}}$', ''), '^(.+)-([0-9]+)-([0-9]+)$', '\\1-\\2.\\3') end as display from turns""")
def display_models(t):
    return t.lazy_turns.select("model").distinct().select("model", pricing.display_model(F.col("model")).alias("display"))


@query("archived_sessions", "select s.session_id, s.session_id not in (select distinct session_id from raw where ts >= timestamp '2024-01-20 00:00:00') as archived from sessions s")
def archived_sessions(t):
    """The later sessions' files are still there, in a folder per user; only their names are looked at."""
    live = t.raw.filter(F.col("ts") >= F.lit("2024-01-20").cast("timestamp")).select("session_id", F.concat(F.lit("/logs/projects/u/"), "session_id", F.lit(".jsonl")).alias("file"))
    return entity.archived(t.sessions, live.select("file").distinct()).select("session_id", "archived")
