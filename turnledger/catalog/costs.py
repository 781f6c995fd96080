"""Cost by tool and skill, attribution, and the drill-downs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnledger.catalog import sql
from turnledger.catalog.base import query, rounded
from turnledger.catalog.entities import LIMITS, RECURSIVE, SESSION_SQL, VERDICT, project_sql
from turnledger.catalog.shapes import AS_OF_DAY, ORACLE_EVENT_BLOCKS, oracle_split
from turnledger.operators import attribution, entity, series, topk
from turnledger.plans import breakdown, detail, rollups
from turnledger.session import checkpoint_dir, stored
from turnledger.sources import history

SPLIT = (
    RECURSIVE
    + ORACLE_EVENT_BLOCKS
    + oracle_split("case when not is_interrupted then input_tokens + cache_read_tokens + cache_creation_tokens end", "event_blocks")
    + """, tt as (
  select t.*, s.tool, s.in_share * t.ctx as in_tok, s.out_share * t.output_tokens as out_tok,
    s.out_share * (output_units::double / 1e10) + s.in_share * ((input_units + cache_read_units + cache_creation_units)::double / 1e10) as usd,
    s.in_share * ((input_units + cache_creation_units)::double / 1e10) + s.out_share * (output_units::double / 1e10) as usd_x
  from shares s join turns t using (file, line) where s.tool <> '' and not t.is_interrupted
), rr as (
  select t.*, coalesce(s.in_share, case when exists (select 1 from in_share i where i.file = t.file and i.line = t.line) then 0 else 1 end) as in_rest0, coalesce(s.out_share, 0) as out_rest
  from turns t left join shares s on s.file = t.file and s.line = t.line and s.tool = '' where not is_interrupted
), rr1 as (select rr.* exclude (in_rest0), case when exists (select 1 from in_share i where i.file = rr.file and i.line = rr.line) then in_rest0 else 1 end as in_rest from rr
), rest as (
  select *, in_rest * ctx as rest_in, out_rest * output_tokens as rest_out,
    out_rest * (output_units::double / 1e10) + in_rest * ((input_units + cache_read_units + cache_creation_units)::double / 1e10) as usd from rr1
)
"""
)


@query("compaction_epochs", "select file, line, epoch::bigint as epoch from walk", prelude=SPLIT)
def compaction_epochs(t):
    lines = attribution.usage(t.lines).select("file", "line", "pool")
    epochs = attribution.compaction_epochs(lines)
    return attribution.with_epoch(lines, epochs).select("file", "line", "epoch")


@query("tool_result_match", "select file, line, owner, nbytes from owned", prelude=SPLIT)
def tool_result_match(t):
    owned = attribution.owned_content(attribution.usage(t.lines), t.event_blocks)
    return owned.filter("kind <> 'turn'").select("file", "line", "owner", "nbytes")


@query("context_tally", "select file, line, tool, sum(nbytes)::bigint as tool_nbytes from held where tool is not null group by all", prelude=SPLIT)
def context_tally(t):
    owned = attribution.owned_content(attribution.usage(t.lines), t.event_blocks)
    return attribution.tool_bytes(owned)


@query("turn_tools", """
select file, line, tool, round(in_tok, 4) as tool_input_tokens, round(out_tok, 4) as tool_output_tokens, round(usd, 9) as tool_usd, round(usd_x, 9) as tool_usd_uncached from tt""", prelude=SPLIT)
def turn_tools(t):
    rows = t.split[0].join(t.lazy_turns.select("file", "line"), ["file", "line"], "left_semi")
    return rounded(rounded(rows, 9, "tool_usd", "tool_usd_uncached"), 4, "tool_input_tokens", "tool_output_tokens")


@query("turn_rest", "select file, line, round(rest_in, 4) as rest_input_tokens, round(rest_out, 4) as rest_output_tokens, round(usd, 9) as rest_usd from rest", prelude=SPLIT)
def turn_rest(t):
    rows = t.split[1].join(t.lazy_turns.select("file", "line"), ["file", "line"], "left_semi")
    return rounded(rounded(rows, 9, "rest_usd"), 4, "rest_input_tokens", "rest_output_tokens")


@query("split_keeps_total", f"select {sql.usd()} as turn_cost, round((select sum(usd) from tt) + (select sum(usd) from rest), 6) as split_cost from turns", prelude=SPLIT)
def split_keeps_total(t):
    per_tool, rest = t.split
    parts = per_tool.select("file", "line", F.col("tool_usd").alias("usd")).unionByName(rest.select("file", "line", F.col("rest_usd").alias("usd")))
    kept = parts.join(t.turns.select("file", "line"), ["file", "line"], "left_semi").agg(F.sum("usd").alias("split_cost"))
    total = series.daily(t.turns).agg(F.sum(F.round(F.col("cost_usd") * 1e10).cast("bigint")).alias("u")).select((F.col("u") / 1e10).alias("turn_cost"))
    return rounded(topk.beside(total, kept), 6, "split_cost")


def _breakdown_sql(usd: str, residual: str) -> str:
    return f""", costs as (
  select tool, sum({usd}) as cost, max(ts) filter (tool = tool_name) as last_active from tt where tool not in ('__unknown__', 'Skill') group by 1
), calls as (select tool_name as tool, sum(tool_use_count)::bigint as n from turns where tool_name is not null and tool_name <> 'Skill' and not is_interrupted group by 1
), ranked as (select costs.*, coalesce(n, 0) as n, row_number() over (order by cost desc, tool) as rn from costs left join calls using (tool))
select case when rn <= 2 then tool else 'other' end as name, round(sum(cost), 8) as cost_usd, sum(n)::bigint as count,
  case when min(rn) > 2 then count(*) end as tool_count, cast(case when min(rn) <= 2 then max(last_active) end as varchar) as last_active from ranked group by 1
union all select '__unattributed__', round({residual}, 8), null, null, null
"""


@query("tool_breakdown_prorata", _breakdown_sql("usd", "(select sum(usd) from rest) + (select coalesce(sum(usd), 0) from tt where tool = '__unknown__')"), prelude=SPLIT)
def tool_breakdown_prorata(t):
    return rounded(breakdown.tool_breakdown(t.turns, *t.split, top=2), 8, "cost_usd")


def _stored_split(t):
    """The turns with their slices in a history, appended twice."""
    store = history.History(t.spark, f"{checkpoint_dir(t.spark)}/history-{uuid.uuid4().hex}")
    rows = stored(history.with_slices(t.turns, *t.split), "sliced")
    store.append(rows)
    store.append(rows, flush=1)
    return store


@query("history_tool_costs", """
select file, line, tool, round(in_tok, 4) as tool_input_tokens, round(out_tok, 4) as tool_output_tokens, round(usd, 9) as tool_usd, round(usd_x, 9) as tool_usd_uncached from tt""", prelude=SPLIT)
def history_tool_costs(t):
    return rounded(rounded(_stored_split(t).split()[0], 9, "tool_usd", "tool_usd_uncached"), 4, "tool_input_tokens", "tool_output_tokens")


@query("history_tool_breakdown", _breakdown_sql("usd", "(select sum(usd) from rest) + (select coalesce(sum(usd), 0) from tt where tool = '__unknown__')"), prelude=SPLIT)
def history_tool_breakdown(t):
    """The tool report from the history alone."""
    store = _stored_split(t)
    return rounded(breakdown.tool_breakdown(store.turns(), *store.split(), top=2), 8, "cost_usd")


@query("tool_breakdown_excl_cache_read", _breakdown_sql("usd_x", """(select sum(greatest(total - coalesce(spent, 0), 0)) from (
  select cost_units::double / 1e10 as total, s.spent from turns t left join (select file, line, sum(usd_x) as spent from tt where tool <> '__unknown__' group by all) s using (file, line) where not is_interrupted))"""), prelude=SPLIT)
def tool_breakdown_excl(t):
    return rounded(breakdown.tool_breakdown(t.turns, *t.split, mode="excl_cache_read", top=2), 8, "cost_usd")


_BILLABLE = "(select sum(input_tokens + output_tokens)::bigint from turns where not is_interrupted)"
_NONTOOL = "(select sum(case when ctx > 0 then rest_in / ctx else 0 end * input_tokens + rest_out) from rest)"


@query("billable_tokens", f"select {_BILLABLE} as total_billable_tokens, round({_NONTOOL}, 3) as nontool_billable_tokens", prelude=SPLIT)
def billable_tokens(t):
    return rounded(breakdown.billable_tokens(t.turns, t.split[1]), 3, "nontool_billable_tokens")


@query("tool_shares", f""", c as (select coalesce(sum(usd) filter (tool not in ('__unknown__', 'Skill')), 0) as tool_cost, sum(usd) filter (tool = '__unknown__') as unknown_cost from tt)
select round(tool_cost, 8) as tool_cost, round(tool_cost / (tool_cost + unknown_cost + (select sum(usd) from rest)), 9) as spend_share, round(({_BILLABLE} - {_NONTOOL}) / {_BILLABLE}, 9) as token_share from c""", prelude=SPLIT)
def tool_shares(t):
    rows = breakdown.tool_breakdown(t.turns, *t.split)
    shares = breakdown.tool_shares(rows, breakdown.billable_tokens(t.turns, t.split[1]))
    return rounded(rounded(shares, 8, "tool_cost"), 9, "spend_share", "token_share")


def _tool_costs_sql(scope: str = "true") -> str:
    return f""", cost as (select case when tool = '__unknown__' then '__unattributed__' else tool end as name, sum(usd) as c, max(case when tool <> '__unknown__' then ts end) as l from tt where tool <> 'Skill' and {scope} group by 1
), calls as (select tool_name as name, sum(tool_use_count)::bigint as n, max(ts) as l from turns where tool_name is not null and tool_name <> 'Skill' and {scope} group by 1)
select coalesce(cost.name, calls.name) as name, round(coalesce(c, 0), 8) as cost_usd, coalesce(n, 0) as invocations, cast(greatest(cost.l, calls.l) as varchar) as last_active
from cost full join calls on cost.name = calls.name"""


_TOOLS_ONLY = " where coalesce(cost.name, calls.name) <> '__unattributed__'"


@query("tool_costs", _tool_costs_sql(), prelude=SPLIT)
def tool_costs(t):
    return rounded(breakdown.tool_costs(t.turns, t.split[0]), 8, "cost_usd")


@query("tool_daily", f"""
select cast(d::date as varchar) as date, round(coalesce(c, 0), 8) as cost_usd from generate_series(date '{AS_OF_DAY}' - 29, date '{AS_OF_DAY}', interval 1 day) g(d)
left join (select ts::date as day, sum(usd) as c from tt where tool = 'Read' group by 1) on day = d::date""", prelude=SPLIT)
def tool_daily(t):
    return rounded(breakdown.tool_daily(t.turns, t.split[0], "Read", AS_OF_DAY), 8, "cost_usd")


@query("skill_daily", f"""
select cast(d::date as varchar) as date, coalesce(c, 0) as cost_usd from generate_series(date '{AS_OF_DAY}' - 29, date '{AS_OF_DAY}', interval 1 day) g(d)
left join (select ts::date as day, {sql.usd()} as c from turns where attribution_skill = 'skill3' and not is_interrupted group by 1) on day = d::date""")
def skill_daily(t):
    return breakdown.skill_daily(t.lazy_turns, "skill3", AS_OF_DAY)


_SKILLS = f""", costs as (select attribution_skill as skill, {sql.usd()} as cost, max(ts) as last_active from turns where attribution_skill is not null and not is_interrupted group by 1
), calls as (select triggered_skill as skill, count(*) as n from turns where triggered_skill is not null and not is_interrupted group by 1)
"""


@query("skill_breakdown", _SKILLS + """, ranked as (select costs.*, coalesce(n, 0) as n, row_number() over (order by cost desc, skill) as rn from costs left join calls using (skill))
select case when rn <= 10 then skill else 'other' end as name, round(sum(cost), 9) as cost_usd, sum(n)::bigint as invocations, case when min(rn) > 10 then count(*) end as tool_count,
  cast(case when min(rn) <= 10 then max(last_active) end as varchar) as last_active from ranked group by 1""")
def skill_breakdown(t):
    return rounded(breakdown.skill_breakdown(t.turns), 9, "cost_usd")


@query("skill_totals", _SKILLS + f""", s as (select {sql.usd()} as total_cost, {sql.usd(where="attribution_skill is not null")} as skill_cost, sum(input_tokens + output_tokens)::bigint as total_billable_tokens,
  coalesce(sum(input_tokens + output_tokens) filter (attribution_skill is not null), 0)::bigint as skill_billable_tokens from turns where not is_interrupted),
idle as (select count(*) as uncharged_skills, coalesce(sum(n), 0)::bigint as uncharged_uses from calls where skill not in (select skill from costs))
select *, skill_cost / total_cost as spend_share, skill_billable_tokens / total_billable_tokens as token_share from s, idle""")
def skill_totals(t):
    return breakdown.skill_totals(t.turns)


@query("by_project", sql.PROJECTS + f""", b as (select project as cwd, {sql.SUMS}, {", ".join(f"{sql.usd(c + '_units')} as {c}_cost" for c in rollups.COMPONENTS)}
  from turns join projects using (session_id) where not is_interrupted and ts::date >= date '{AS_OF_DAY}' - 6 group by 1)
select case when cwd = '(unknown)' then cwd else list_last(string_split(cwd, '/')) end as name, cwd,
  case when cwd <> '(unknown)' then replace(replace(rtrim(to_base64(encode(cwd)), '='), '+', '-'), '/', '_') end as cwd_b64, * exclude (cwd), {sql.hit_rate()} as cache_hit_rate from b""")
def by_project(t):
    return breakdown.by_project(t.turns, entity.canonical_cwd(t.sessions), series.range_start("7d", AS_OF_DAY))


_BY_MODEL = f""", m as (select coalesce(model, '(unknown)') as model, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, sum(input_tokens + output_tokens)::bigint as billable, {sql.usd()} as cost_usd
  from turns where not is_interrupted group by 1)
"""


@query("by_model", _BY_MODEL + """
select *, billable / sum(billable) over () as share, round(cost_usd / sum(cost_usd) over (), 10) as cost_share,
  case model when '(unknown)' then 'unpriced' when 'gemini-3-flash' then 'unpriced' when 'claude-sonnet-9' then 'estimated' else 'known' end as price_status from m""")
def by_model(t):
    return rounded(breakdown.by_model(t.lazy_turns), 10, "cost_share")


@query("collapse_models", _BY_MODEL + """, r as (select *, row_number() over (order by billable desc, model) as rn, count(*) over () as k from m)
select case when k <= 6 or rn <= 5 then model else 'others' end as model, round(sum(cost_usd), 9) as cost_usd from r group by 1""")
def collapse_models(t):
    return rounded(topk.keep_if_few(breakdown.by_model(t.lazy_turns), "model", "cost_usd", "billable"), 9, "cost_usd")


# -- drill-downs ---------------------------------------------------------------

_TOOL_TURNS = """, mine as (select t.*, coalesce(c.usd, 0) as usd, coalesce(c.out_tok, 0) as out_tok, case when tool_name = 'Bash' then tool_use_count else 0 end as calls
  from turns t left join (select file, line, usd, out_tok from tt where tool = 'Bash') c using (file, line) where not is_interrupted and (c.usd is not null or tool_name = 'Bash'))
"""
_WITH_PROJECTS = SPLIT + sql.PROJECTS


def _bash(t):
    return detail.tool_turns(t.turns, t.split[0], "Bash")


@query("tool_scorecard", _TOOL_TURNS + f""", p as (select project, sum(usd) as c from mine join projects using (session_id) group by 1 order by c desc, project limit 1)
select round(sum(usd), 8) as cost_usd, round(sum(out_tok), 3) as output_tokens, sum(calls)::bigint as invocations, coalesce(sum(calls) filter (ts::date >= date '{AS_OF_DAY}' - 6), 0)::bigint as invocations_7d,
  round(sum(usd) / (select {sql.usd()} from turns where not is_interrupted), 9) as share_of_total,
  (select case when project = '(unknown)' then '—' else list_last(string_split(project, '/')) end from p) as top_project, round((select c from p) / sum(usd), 9) as top_share from mine""", prelude=_WITH_PROJECTS)
def tool_scorecard(t):
    card = detail.tool_scorecard(t.turns, _bash(t), entity.canonical_cwd(t.sessions), AS_OF_DAY)
    return rounded(rounded(rounded(card, 8, "cost_usd"), 3, "output_tokens"), 9, "share_of_total", "top_share")


@query("tool_by_project", _TOOL_TURNS + """
select project as cwd, round(sum(usd), 8) as cost_usd, sum(calls)::bigint as invocations, cast(max(ts) as varchar) as last_active from mine join projects using (session_id) group by 1 order by 2 desc limit 50""", prelude=_WITH_PROJECTS)
def tool_by_project(t):
    rows = detail.tool_projects(_bash(t), entity.canonical_cwd(t.sessions))
    return rounded(detail.capped(rows, "cwd"), 8, "cost_usd").select("cwd", "cost_usd", "invocations", "last_active")


@query("tool_by_model", _TOOL_TURNS + "select coalesce(model, '(unknown)') as name, round(sum(usd), 8) as cost_usd, sum(calls)::bigint as invocations from mine group by 1", prelude=_WITH_PROJECTS)
def tool_by_model(t):
    return rounded(detail.capped(detail.tool_models(_bash(t)), "name"), 8, "cost_usd")


@query("skill_scorecard", sql.PROJECTS + f""", own as (select * from turns where attribution_skill = 'skill3' and not is_interrupted), uses as (select * from turns where triggered_skill = 'skill3' and not is_interrupted)
select {sql.usd()} as cost_usd, sum(output_tokens)::bigint as output_tokens, (select count(*) from uses) as invocations, (select count(*) from uses where ts::date >= date '{AS_OF_DAY}' - 6) as invocations_7d,
  {sql.usd(where="not is_sidechain")} as inline_usd, {sql.usd(where="is_sidechain")} as subagent_usd, {sql.usd()} / (select {sql.usd()} from turns where not is_interrupted) as share_of_total,
  (select case when project = '(unknown)' then '—' else list_last(string_split(project, '/')) end from (select project, {sql.usd()} as c from own join projects using (session_id) group by 1 order by c desc, project limit 1)) as top_project from own""")
def skill_scorecard(t):
    return detail.skill_scorecard(t.turns, "skill3", entity.canonical_cwd(t.sessions), AS_OF_DAY)


@query("skill_by_model", f"select coalesce(model, '(unknown)') as name, {sql.usd()} as cost_usd from turns where attribution_skill = 'skill3' and not is_interrupted group by 1")
def skill_by_model(t):
    return detail.capped(detail.skill_models(t.lazy_turns, "skill3"), "name")


@query("skill_by_project", sql.PROJECTS + f"select project as cwd, {sql.usd()} as cost_usd, count(*) as turns, cast(max(ts) as varchar) as last_active from turns join projects using (session_id) where attribution_skill = 'skill3' and not is_interrupted group by 1")
def skill_by_project(t):
    return detail.projects_of(detail.skill_turns(t.turns, "skill3"), entity.canonical_cwd(t.sessions))


_ONE_MODEL = "model = 'claude-opus-4-7'"
_PARTS = ", ".join(f"{sql.usd(c + '_units')} as {c}_usd" for c in rollups.COMPONENTS)


@query("model_by_project", sql.PROJECTS + f"select project as cwd, {sql.usd()} as cost_usd, count(*) as turns, cast(max(ts) as varchar) as last_active from turns join projects using (session_id) where {_ONE_MODEL} group by 1")
def model_by_project(t):
    return detail.projects_of(detail.model_turns(t.turns, "opus-4-7"), entity.canonical_cwd(t.sessions))


@query("model_scorecard", f"select {sql.usd()} as cost_usd, count(*) as turns, {_PARTS} from turns where {_ONE_MODEL}")
def model_scorecard(t):
    return detail.model_scorecard(detail.model_turns(t.lazy_turns, "opus-4-7"))


@query("model_by_tool", _tool_costs_sql(_ONE_MODEL) + _TOOLS_ONLY, prelude=SPLIT)
def model_by_tool(t):
    return rounded(detail.costed_tools(detail.model_turns(t.turns, "opus-4-7"), t.split[0]), 8, "cost_usd")


@query("model_by_skill", f"""
select skill, cost_usd, coalesce(n, 0) as invocations, cast(last_active as varchar) as last_active from (select attribution_skill as skill, {sql.usd()} as cost_usd, max(ts) as last_active from turns where attribution_skill is not null and not is_interrupted and {_ONE_MODEL} group by 1)
left join (select triggered_skill as skill, count(*) as n from turns where triggered_skill is not null and not is_interrupted and {_ONE_MODEL} group by 1) using (skill)""")
def model_by_skill(t):
    return detail.costed_skills(detail.model_turns(t.turns, "opus-4-7"))


_PROJECT = "/home/u/p1"
_PROJECT_TURNS = f", own as (select t.* from turns t join projects p using (session_id) where project = '{_PROJECT}' and ts::date >= date '{AS_OF_DAY}' - 13)\n"


def _own(t):
    return detail.project_turns(t.turns, entity.canonical_cwd(t.sessions), _PROJECT, series.range_start("14d", AS_OF_DAY))


@query("project_cache_trend", sql.PROJECTS + _PROJECT_TURNS + f"""
select cast(d::date as varchar) as bucket, coalesce({sql.hit_rate()}, 0) as hit_rate, coalesce(cost_usd, 0) as cost_usd from generate_series(date '{AS_OF_DAY}' - 13, date '{AS_OF_DAY}', interval 1 day) g(d)
left join (select ts::date as day, {sql.SUMS}, {sql.usd()} as cost_usd from own group by 1) on day = d::date""")
def project_cache_trend(t):
    return detail.cache_trend(_own(t), "14d", AS_OF_DAY)


@query("project_cache_trend_hourly", sql.PROJECTS + _PROJECT_TURNS + f"""
select cast(date_trunc('hour', ts) as varchar) as bucket, coalesce({sql.hit_rate()}, 0) as hit_rate, cost_usd from (
  select date_trunc('hour', ts) as ts, {sql.SUMS}, {sql.usd()} as cost_usd from own where ts::date = date '{AS_OF_DAY}' group by 1)""")
def project_cache_trend_hourly(t):
    return detail.cache_trend(_own(t), "1d", AS_OF_DAY)


@query("project_top_turns", sql.PROJECTS + _PROJECT_TURNS + f"""
select cast(ts as varchar) as ts, session_id, model, cost_units::double / 1e10 as cost_usd, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, {sql.hit_rate()} as hit_rate,
  {sql.cost_per_kw("(cost_units::double / 1e10)")} as cost_per_kw, {sql.over("cache_read_tokens", "output_tokens")} as ctx_ratio
from own where not is_interrupted order by cost_units desc, own.ts, file, line limit 20""")
def project_top_turns(t):
    return detail.top_turns(_own(t))


@query("project_sessions", SESSION_SQL + sql.PROJECTS + f"""
select session_id, turns, cost_usd, {VERDICT} as verdict from rollups join projects using (session_id) where project = '{_PROJECT}' and last_ts::date >= date '{AS_OF_DAY}' - 13""", prelude=RECURSIVE)
def project_sessions(t):
    rows = rollups.session_rollups(t.turns, t.sessions, LIMITS)
    since = series.range_start("14d", AS_OF_DAY)
    return detail.project_sessions(rows, entity.canonical_cwd(t.sessions), _PROJECT, since).select("session_id", "turns", "cost_usd", "verdict")


@query("project_by_tool", sql.PROJECTS + _tool_costs_sql(f"ts::date >= date '{AS_OF_DAY}' - 13 and session_id in (select session_id from projects where project = '{_PROJECT}')") + _TOOLS_ONLY, prelude=SPLIT)
def project_by_tool(t):
    return rounded(detail.costed_tools(_own(t), t.split[0]), 8, "cost_usd")


@query("project_by_skill", sql.PROJECTS + _PROJECT_TURNS + f"""
select skill, cost_usd, coalesce(n, 0) as invocations, cast(last_active as varchar) as last_active
from (select attribution_skill as skill, {sql.usd()} as cost_usd, max(ts) as last_active from own where attribution_skill is not null and not is_interrupted group by 1)
left join (select triggered_skill as skill, count(*) as n from own where triggered_skill is not null and not is_interrupted group by 1) using (skill)""")
def project_by_skill(t):
    return detail.costed_skills(_own(t))


_SCOPED = SESSION_SQL + sql.PROJECTS + f", scoped as (select r.* from rollups r join projects p using (session_id) where project = '{_PROJECT}' and last_ts::date >= date '{AS_OF_DAY}' - 13)"


def _scoped(t):
    rows = rollups.session_rollups(t.turns, t.sessions, LIMITS)
    return detail.project_sessions(rows, entity.canonical_cwd(t.sessions), _PROJECT, series.range_start("14d", AS_OF_DAY))


@query("project_scorecard", _SCOPED + project_sql("'all'", "scoped", f"""
select '{_PROJECT}' as cwd, coalesce(max(cost_usd), 0) as cost_usd, coalesce(max(sessions), 0) as sessions, coalesce(bool_or(flagged), false) as flagged from flags"""), prelude=RECURSIVE)
def project_scorecard(t):
    return detail.project_scorecard(_scoped(t), _PROJECT)


@query("project_histogram", _SCOPED + """
select b as bucket, label, count(bucket) as sessions from (select unnest(range(0, 6)) as b, unnest(['<500', '500-1k', '1k-2k', '2k-5k', '5k-10k', '10k+']) as label) left join (
  select (context_growth >= 500)::bigint + (context_growth >= 1000)::bigint + (context_growth >= 2000)::bigint + (context_growth >= 5000)::bigint + (context_growth >= 10000)::bigint as bucket from scoped) on b = bucket group by all""", prelude=RECURSIVE)
def project_histogram(t):
    return rollups.growth_histogram(_scoped(t)).select(F.col("bucket").cast("bigint").alias("bucket"), "label", "sessions")


_NAMES = "(select unnest(['RUNAWAY_WINDOW', 'CONTEXT_CREEP', 'TOOL_ERROR_STORM', 'SIDECHAIN_HEAVY', 'OK']) as verdict)"


@query("project_verdicts", _SCOPED + f"select n.verdict, count(v.verdict) as sessions from {_NAMES} n left join (select {VERDICT} as verdict from scoped) v using (verdict) group by 1", prelude=RECURSIVE)
def project_verdicts(t):
    return rollups.verdict_counts(_scoped(t))


_DAY = "2024-01-17"


@query("day_summary", f""", days as (select ts::date as date, {sql.usd()} as cost from turns where ts::date between date '{_DAY}' - 5 and date '{_DAY}' group by 1
), base as (select case when count(*) filter (cost > 0) >= 3 then median(cost) filter (cost > 0) end as median from days)
select (select count(*) from turns where ts::date = date '{_DAY}') as turns, cost as total_cost, case when median > 0 then cost / median end as delta_vs_7d_median, case when cost / median >= 2 then 'cost_2sigma' end as anomaly_flag
from days, base where date = date '{_DAY}'""")
def day_summary(t):
    return detail.day_summary(t.turns, _DAY)


@query("day_hours", f"""
select h as hour, coalesce(cost_usd, 0) as cost_usd, coalesce(turns, 0) as turns from range(0, 24) g(h) left join (select extract(hour from ts)::bigint as hour, {sql.usd()} as cost_usd, count(*) as turns from turns where ts::date = date '{_DAY}' group by 1) on hour = h""")
def day_hours(t):
    return detail.day_hours(t.lazy_turns, _DAY)


@query("day_hour_models", f"select extract(hour from ts)::bigint as hour, model, count(*) as turns from turns where ts::date = date '{_DAY}' and model is not null group by all")
def day_hour_models(t):
    return detail.day_hour_models(t.lazy_turns, _DAY)


@query("day_top_sessions", SESSION_SQL + f"""
select session_id, cost_usd, {VERDICT} as verdict from rollups where session_id in (select session_id from turns where ts::date = date '{_DAY}') order by cost_usd desc, session_id limit 20""", prelude=RECURSIVE)
def day_top_sessions(t):
    rows = detail.day_sessions(rollups.session_rollups(t.turns, t.sessions, LIMITS), t.turns, _DAY)
    return rollups.top_sessions(rows, "cost", 20).select("session_id", "cost_usd", "verdict")


_ON_DAY = SESSION_SQL + f", active as (select * from rollups where session_id in (select session_id from turns where ts::date = date '{_DAY}'))"


@query("day_verdicts", _ON_DAY + f"select n.verdict, count(v.verdict) as sessions from {_NAMES} n left join (select {VERDICT} as verdict from active) v using (verdict) group by 1", prelude=RECURSIVE)
def day_verdicts(t):
    return detail.day_verdicts(rollups.session_rollups(t.turns, t.sessions, LIMITS), t.turns, _DAY)


@query("day_top_projects", _ON_DAY + project_sql("coalesce(cwd, '(unknown)')", "active", "select * from flags order by cost_usd desc, cwd limit 10"), prelude=RECURSIVE)
def day_top_projects(t):
    rows = rollups.session_rollups(t.turns, t.sessions, LIMITS)
    return rounded(detail.day_projects(rows, t.turns, _DAY), 4, "avg_context_growth")


@query("projects_in_window", SESSION_SQL + f", recent as (select * from rollups where last_ts::date >= date '{AS_OF_DAY}' - 6)" + project_sql("coalesce(cwd, '(unknown)')", "recent"), prelude=RECURSIVE)
def projects_in_window(t):
    rows = rollups.session_rollups(t.turns, t.sessions, LIMITS)
    return rounded(detail.projects_since(rows, series.range_start("7d", AS_OF_DAY)), 4, "avg_context_growth")


@query("stop_reasons", "select session_id, coalesce(stop_reason, 'unknown') as stop_reason, count(*) as turns from turns group by all")
def stop_reasons(t):
    return detail.stop_reasons(t.lazy_turns, ["session_id"])


