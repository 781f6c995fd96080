"""Small SQL pieces shared by the oracle queries."""

from __future__ import annotations


def usd(column: str = "cost_units", where: str = "") -> str:
    cond = f" filter ({where})" if where else ""
    return f"(coalesce(sum({column}){cond}, 0)::double / 1e10)"


SUMS = ", ".join(f"sum({c})::bigint as {c}" for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"))
MEASURES = f"count(*) as turns, count(*) filter (is_interrupted) as interrupted_turns, {SUMS}, {usd()} as cost_usd"
ZERO = ", ".join(
    f"coalesce(r.{c}, 0) as {c}"
    for c in ("turns", "interrupted_turns", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cost_usd")
)


def hit_rate(p: str = "") -> str:
    den = f"({p}cache_read_tokens + {p}cache_creation_tokens + {p}input_tokens)"
    return f"case when {den} > 0 then {p}cache_read_tokens / {den} end"


def hit_pct(p: str = "") -> str:
    return f"({hit_rate(p)}) * 100"


def cost_per_kw(cost: str = "cost_usd", out: str = "output_tokens") -> str:
    return f"case when {out} > 0 then {cost} * 1000.0::double / {out} end"


def over(num: str, den: str) -> str:
    return f"case when {den} > 0 then {num} / {den} end"


def efficiency(p: str = "") -> str:
    return (
        f"{hit_pct(p)} as hit_pct, {cost_per_kw(p + 'cost_usd', p + 'output_tokens')} as cost_per_kw, "
        f"{over(p + 'cache_read_tokens', p + 'output_tokens')} as ctx_ratio, "
        f"{over(p + 'cache_read_tokens', p + 'cache_creation_tokens')} as cache_reuse"
    )


SHORT_MODEL = (
    "case when model is null then '(unknown)' else regexp_replace(regexp_replace(model, '^claude(-|$)', ''), '(^|-)[0-9]{8,}$', '') end"
)
CONTEXT = "(select context_window from price where price_key = {model})"
DAY = "ts::date"

# The project of each session: shortest directory in use that is a path prefix of its own.
PROJECTS = """, used as (select distinct cwd from sessions where cwd is not null
), projects as (
  select s.session_id, coalesce((select arg_min(u.cwd, length(u.cwd)) from used u where s.cwd = u.cwd or starts_with(s.cwd, u.cwd || '/')), '(unknown)') as project
  from sessions s
)
"""

_HOURLY = """, hours as (
  select {keys}, date_trunc('hour', ts) as hour, count(*) as billed, sum(cost_units) as units, sum(ctx) as tokens
  from turns where not is_interrupted group by all
), ordered_hours as (select *, row_number() over (partition by {keys} order by hour) as n from hours
), opened as (
  select {keys}, n, hour, hour as start from ordered_hours where n = 1
  union all
  select h.{keys}, h.n, h.hour, case when h.hour >= o.start + interval 5 hour then h.hour else o.start end
  from opened o join ordered_hours h on h.{keys} = o.{keys} and h.n = o.n + 1
), wins as (
  select o.{keys}, o.start, sum(h.units) as units, sum(h.tokens)::bigint as tokens, sum(h.billed)::bigint as billed
  from opened o join hours h on h.{keys} = o.{keys} and h.hour = o.hour group by all
)
"""


def windows(key: str) -> str:
    """Anchored windows per key as a recursive walk over its hours (CTE ``wins``)."""
    return _HOURLY.replace("{keys}", key)


# Session rollups with the verdict inputs (CTE ``rollups``); needs windows("session_id").
ROLLUPS = f""", billed as (
  select *, row_number() over (partition by session_id order by ts, file, line) - 1 as step from turns where not is_interrupted
), shape as (
  select session_id, max(ctx) as max_turn_input, 
    coalesce(case when count(*) * sum(step * step) - sum(step) * sum(step) > 0 then (count(*) * sum(step * ctx) - sum(step) * sum(ctx))::double / (count(*) * sum(step * step) - sum(step) * sum(step))::double end, 0) as slope, arg_max(ctx, (ts, file, line)) as latest_ctx
  from billed group by session_id
), dominant as (
  select session_id, arg_min(model, (-n, seen)) as model from (
    select session_id, model, count(*) as n, min((ts, file, line)) as seen from turns where model is not null group by all) group by session_id
), peaks as (select session_id, max(units)::double / 1e10 as peak from wins group by session_id
), rollups as (
  select t.*, s.source_file, s.cwd, s.is_sidechain, coalesce(h.max_turn_input, 0) as max_turn_input,
    coalesce(h.slope, 0) as context_growth, h.latest_ctx, d.model, coalesce(p.peak, 0) as peak_window_cost,
    h.latest_ctx / (select context_window from price where price_key = d.model) as ctx_used
  from (select session_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as turns, {SUMS}, {usd()} as cost_usd,
          sum(tool_use_count)::bigint as tool_use_count, sum(tool_error_count)::bigint as tool_error_count from turns group by session_id) t
  join sessions s using (session_id) left join shape h using (session_id) left join dominant d using (session_id) left join peaks p using (session_id)
)
"""


def verdict(window: float = 50, creep: int = 500000, slope: float = 2000, uses: int = 10, rate: float = 0.3, side: float = 5) -> str:
    return (
        f"case when peak_window_cost > {window}::double then 'RUNAWAY_WINDOW' "
        f"when max_turn_input > {creep} and context_growth > {slope}::double then 'CONTEXT_CREEP' "
        f"when tool_use_count >= {uses} and tool_error_count / tool_use_count > {rate}::double then 'TOOL_ERROR_STORM' "
        f"when is_sidechain and cost_usd > {side}::double then 'SIDECHAIN_HEAVY' else 'OK' end"
    )


def recursive(sql: str) -> str:
    return sql.replace("with raw as", "with recursive raw as", 1).replace("with log as", "with recursive log as", 1)
