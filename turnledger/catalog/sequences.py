"""Detectors and other operators over the ordered turns of long sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnledger.catalog import sql
from turnledger.catalog.base import query, rounded
from turnledger.catalog.shapes import ORACLE_LOG, ORACLE_TURNS
from turnledger.functions import text
from turnledger.functions.money import usd
from turnledger.operators import patterns
from turnledger.plans import detail
from turnledger.sources import logs

# One session per user; thresholds low enough to find something on these tables.
LOW = {
    "idle_expiry_creation_ratio": 0.3,
    "compaction_drop_ratio": 0.5,
    "compaction_reinflate_ratio": 0.8,
    "context_plateau_fraction": 0.05,
    "context_plateau_min_turns": 4,
    "sidechain_explosion_cost_share": 0.05,
    "tool_error_storm_rate": 0.1,
}
SEQ = sql.recursive(ORACLE_TURNS) + """, seq as (
  select * replace (regexp_extract(file, 'u(\\d+)\\.jsonl$', 1) as session_id), regexp_extract(file, 'u(\\d+)\\.jsonl$', 1) as sid from turns
), num as (select *, row_number() over (partition by session_id order by ts, file, line) - 1 as i from seq)
"""


def _numbered(t):
    return patterns.numbered(t.user_turns)


_COLS = ["session_id", "severity", "first_turn", "last_turn", "n_turns", "headline", "reason"]

_IDLE = """, gaps as (
  select session_id, i, (epoch_us(ts) - epoch_us(lag(ts) over (partition by session_id order by i))) / 1e6::double as gap, case when ctx > 0 then cache_creation_tokens / ctx end as r from num
), idle as (select *, count(*) over (partition by session_id) as hits from gaps where gap >= 3600 and r > 0.3::double)
"""


@query("idle_expiry", _IDLE + """
select session_id, case when hits >= 3 then 'red' else 'amber' end as severity, i as first_turn, i as last_turn, 1::bigint as n_turns,
  'Prompt cache expired during a ' || cast(round_even(gap / 3600, 1) as varchar) || 'h idle gap before turn ' || i || '.' as headline,
  'Next turn was ' || cast(round_even(r * 100, 0)::bigint as varchar) || '% cache_creation.' as reason from idle""", prelude=SEQ)
def idle_expiry(t):
    return patterns.idle_expiry(_numbered(t), LOW).select(*_COLS)


_CYCLES = """, drops as (
  select a.session_id, a.i, a.ctx, min(b.i) as j from num a join num b on b.session_id = a.session_id and b.i between a.i + 1 and a.i + 5 and b.ctx <= (1 - 0.5::double) * a.ctx
  where a.ctx > 0 group by all
), cands as (
  select d.session_id, d.i, d.j, min(c.i) as k from drops d join num c on c.session_id = d.session_id and c.i between d.j + 1 and d.j + 5 and c.ctx >= 0.8::double * d.ctx group by all
), pick as (
  select session_id, i, j, k from cands qualify row_number() over (partition by session_id order by i) = 1
  union all
  select n.session_id, n.i, n.j, n.k from (select c.*, row_number() over (partition by c.session_id order by c.i) as rn from pick p join cands c on c.session_id = p.session_id and c.i > p.k) n where rn = 1
)
"""


@query("reinflation_cycles", _CYCLES + 'select session_id, i as first, j as low, k as last from pick', prelude=SEQ)
def reinflation_cycles(t):
    return patterns.reinflation_cycles(_numbered(t), LOW).select("session_id", "first", "low", "last")


@query("compaction_reinflation", _CYCLES + """
select session_id, case when count(*) >= 3 then 'red' else 'amber' end as severity, min(i) as first_turn, max(k) as last_turn, count(*) * 3 as n_turns,
  'Context was compacted ' || count(*) || ' time(s) and re-inflated to the ceiling.' as headline,
  'Each compaction was followed by tokens climbing back to ≥80% of the previous peak.' as reason from pick group by 1""", prelude=SEQ)
def compaction_reinflation(t):
    return patterns.compaction_reinflation(_numbered(t), LOW).select(*_COLS)


_PLATEAU = """, high as (
  select session_id, i, i - row_number() over (partition by session_id order by i) as run from num n
  where ctx >= 0.05::double * coalesce((select context_window from price where price_key = n.model), 200000)
), runs as (select session_id, run, count(*) as n, min(i) as first from high group by all
), best as (select session_id, arg_max({'n': n, 'first': first}, (n, -first)) as b from runs group by 1)
"""


@query("ceiling_plateau", _PLATEAU + """
select session_id, case when b.n >= 8 then 'red' else 'amber' end as severity, b.first as first_turn, b.first + b.n - 1 as last_turn, b.n as n_turns,
  'Session ran at ≥5% of the model''s context window for ' || b.n || ' turns.' as headline, 'Each of those turns paid near-full-context input rates.' as reason
from best where b.n >= 4""", prelude=SEQ)
def ceiling_plateau(t):
    return patterns.ceiling_plateau(_numbered(t), LOW).select(*_COLS)


_SIDE = """, side as (
  select session_id, sum(cost_units) as total, coalesce(sum(cost_units) filter (is_sidechain), 0) as part, count(*) filter (is_sidechain) as n,
    min(i) filter (is_sidechain) as first, max(i) filter (is_sidechain) as last from num group by 1
), heavy as (select *, part / total as share from side where total > 0 and part / total > 0.05::double)
"""


@query("sidechain_share", _SIDE + """
select session_id, case when share >= 0.6::double then 'red' else 'amber' end as severity, first as first_turn, last as last_turn, n as n_turns,
  'Sidechain/task-agent work accounted for ' || cast(round_even(share * 100, 0)::bigint as varchar) || '% of this session''s cost.' as headline,
  printf('$%.2f of $%.2f billed was sidechain.', part::double / 1e10, total::double / 1e10) as reason from heavy""", prelude=SEQ)
def sidechain_share(t):
    return patterns.sidechain_explosion(_numbered(t), LOW).select(*_COLS)


_STORM = """, frames as (
  select session_id, i, sum(tool_use_count) over w as u, sum(tool_error_count) over w as e, count(*) over w as n from num
  window w as (partition by session_id order by i rows between current row and 9 following)
), bad as (select session_id, i, u::bigint as u, e::bigint as e, e / u as rate from frames where n = 10 and u > 0 and e / u > 0.1::double
), storm as (
  select session_id, i, u, e, rate from bad qualify row_number() over (partition by session_id order by i) = 1
  union all
  select n.session_id, n.i, n.u, n.e, n.rate from (select b.*, row_number() over (partition by b.session_id order by b.i) as rn from storm s join bad b on b.session_id = s.session_id and b.i >= s.i + 10) n where rn = 1
)
"""


@query("tool_error_storm", _STORM + """
select session_id, case when rate > 0.5::double then 'red' else 'amber' end as severity, i as first_turn, i + 9 as last_turn, 10::bigint as n_turns,
  'Tool errors spiked in turns ' || i || '–' || (i + 9) || ' (' || cast(round_even(rate * 100, 0)::bigint as varchar) || '% error rate).' as headline,
  e || ' errors across ' || u || ' tool uses.' as reason from storm""", prelude=SEQ)
def tool_error_storm(t):
    return patterns.tool_error_storm(_numbered(t), LOW).select(*_COLS)


@query("detect_patterns", _IDLE + _CYCLES + _PLATEAU + _SIDE + _STORM + """
select session_id, 'idle_expiry' as kind, i as first_turn from idle union all select session_id, 'compaction_reinflation', min(i) from pick group by 1
union all select session_id, 'context_ceiling_plateau', b.first from best where b.n >= 4 union all select session_id, 'sidechain_explosion', first from heavy
union all select session_id, 'tool_error_storm', i from storm""", prelude=SEQ)
def detect_patterns(t):
    return patterns.detect_patterns(_numbered(t), LOW).select("session_id", "kind", "first_turn")


@query("pattern_turns", _IDLE + _CYCLES + _PLATEAU + _SIDE + _STORM + """
select session_id, 'idle_expiry' as kind, i as turn_idx from idle union select session_id, 'compaction_reinflation', unnest([i, j, k]) from pick
union select n.session_id, 'context_ceiling_plateau', n.i from num n join best on best.session_id = n.session_id and b.n >= 4 and n.i between b.first and b.first + b.n - 1
union select n.session_id, 'sidechain_explosion', n.i from num n join heavy using (session_id) where is_sidechain
union select session_id, 'tool_error_storm', unnest(range(i, i + 10)) from storm""", prelude=SEQ)
def pattern_turns(t):
    return patterns.pattern_turns(_numbered(t), LOW)


@query("smoothed_hit_rate", """, r as (select session_id, i, case when ctx > 0 then cache_read_tokens / ctx else 0.0::double end as rate from num)
select session_id, i as turn_idx, rate, round(case i when 0 then avg(rate) over (w rows between current row and 4 following)
  when 1 then avg(rate) over (w rows between 1 preceding and 3 following) else avg(rate) over (w rows between 2 preceding and 2 following) end, 10) as smoothed
from r window w as (partition by session_id order by i)""", prelude=SEQ)
def smoothed_hit_rate(t):
    return rounded(detail.smoothed_hit_rate(_numbered(t)), 10, "smoothed")


@query("growth_line", """, f as (select session_id, arg_min(ctx, i) as c0, coalesce(case when count(*) > 1 then (count(*) * sum(i * ctx) - sum(i) * sum(ctx))::double / (count(*) * sum(i * i) - sum(i) * sum(i))::double end, 0) as slope from num group by 1)
select session_id, i as turn_idx, ctx, round(c0 + slope * i, 3) as fitted, case when slope > 5000 then 'alarm' when slope > 2000 then 'amber' else 'mute' end as badge from num join f using (session_id)""", prelude=SEQ)
def growth_line(t):
    return rounded(detail.growth_line(_numbered(t)), 3, "fitted")


@query("session_top_turns", "select * from (select i as turn_idx, cost_units::double / 1e10 as cost_usd from num where session_id = '8' order by cost_units desc, i limit 30) order by 1", prelude=SEQ)
def session_top_turns(t):
    return detail.top_in_time_order(_numbered(t), "8").select("turn_idx", usd(F.col("cost_units")).alias("cost_usd"))


@query("session_turn_rows", """
select session_id, i as turn_idx, cast(ts as varchar) as ts, model, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, cost_units::double / 1e10 as cost_usd, is_sidechain, tool_use_count, tool_error_count, stop_reason,
  input_units::double / 1e10 as input_usd, output_units::double / 1e10 as output_usd, cache_read_units::double / 1e10 as cache_read_usd, cache_creation_units::double / 1e10 as cache_creation_usd from num""", prelude=SEQ)
def session_turn_rows(t):
    return detail.session_turn_rows(_numbered(t))


@query("turn_detail", """
select session_id, i as turn_idx, cast(ts as varchar) as ts, model, stop_reason, is_sidechain, input_units::double / 1e10 as input_usd, output_units::double / 1e10 as output_usd, cache_read_units::double / 1e10 as cache_read_usd,
  cache_creation_units::double / 1e10 as cache_creation_usd, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, ctx as total_visible from num where session_id = '8' and i = 3""", prelude=SEQ)
def turn_detail(t):
    return detail.turn_detail(_numbered(t), "8", 3)


@query("prior_user_prompt", """
select a.file, 's' as session_id, a.line, coalesce((select case when length(p) > 500 then left(p, 500) || '…' else p end from (select arg_max(b.text, b.line) as p from log b where b.file = a.file and b.role = 'user' and b.line < a.line)), '') as user_prompt,
  case when length(a.text) > 500 then left(a.text, 500) || '…' else a.text end as assistant_preview
from log a where a.role = 'assistant'""", prelude=ORACLE_LOG)
def prior_user_prompt(t):
    return detail.prior_prompts(t.log.withColumn("session_id", F.lit("s")))


@query("turn_snippets", """
select cast(a.conv_id as varchar) || '-' || a.turn as turn_key, a.turn + 1 as source_line,
  coalesce((select case when length(p) > 500 then left(p, 500) || '…' else p end from (select arg_max(b.text, b.turn) as p from conversations b where b.conv_id = a.conv_id and b.role = 'user' and b.turn < a.turn)), '') as user_prompt,
  case when length(a.text) > 500 then left(a.text, 500) || '…' else a.text end as assistant_preview,
  case when (a.conv_id + a.turn) % 4 < 3 then 'Read' end as call,
  case when (a.conv_id + a.turn) % 4 < 3 then not exists (select 1 from conversations b where b.conv_id = a.conv_id and b.role = 'user' and b.turn = a.turn + 1 and b.conv_id % 3 = 0) end as ok
from conversations a where a.role = 'assistant'""", prelude="")
def turn_snippets(t):
    """The conversations as log lines with calls and results; every assistant turn with its prompt, preview, call and line."""
    rows = t.table("conversations")
    kind, name = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)), lambda n: F.concat(F.lit("t"), n.cast("string"))
    text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    call = F.struct(F.lit("tool_use").alias("type"), name(F.col("turn")).alias("id"), F.lit("Read").alias("name"))
    result = F.struct(F.lit("tool_result").alias("type"), name(F.col("turn") - 1).alias("tool_use_id"), (F.pmod("conv_id", F.lit(3)) == 0).alias("is_error"))
    more = F.when((F.col("role") == "assistant") & (kind < 3), F.to_json(call)).when((F.col("role") == "user") & (F.col("turn") > 0), F.to_json(result))
    content = F.concat(F.lit("["), F.concat_ws(",", F.to_json(text), more), F.lit("]"))
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    event = F.struct(F.col("role").alias("type"), F.lit("s").alias("sessionId"), F.struct(key.alias("id"), F.lit("<content>").alias("content")).alias("message"))
    value = F.replace(F.to_json(event), F.lit('"<content>"'), content)
    lines = rows.select(F.concat(F.lit("/logs/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file"), (F.col("turn") + 1).alias("line"), value.alias("value"))
    events = logs.events(lines)
    turns = events.filter("type = 'assistant'").select("session_id", F.col("file").alias("source_file"), F.col("message_id").alias("turn_key"), "message_id", F.lit(None).cast("timestamp").alias("ts"))
    found = detail.turn_context(events, turns)
    return found.select("turn_key", "source_line", "user_prompt", "assistant_preview", F.get("calls", 0)["name"].alias("call"), F.get("calls", 0)["ok"].alias("ok"))


@query("call_outcomes", """
select a.file, 's' as session_id, a.line, 0::bigint as pos, a.name, not exists (select 1 from log b where b.file = a.file and b.kind = 'tool_result' and b.is_error and b.tool_use_id = a.block_id) as ok
from log a where a.kind = 'tool_use'""", prelude=ORACLE_LOG)
def call_outcomes(t):
    rows = t.log.withColumns({"session_id": F.lit("s"), "pos": F.lit(0).cast("bigint")})
    return detail.call_outcomes(rows.filter("kind = 'tool_use'"), rows.filter("kind = 'tool_result'"))


@query("source_lines", """
select cast(t.line as varchar) as turn_key, t.session_id, (select min(r.line) from raw r where r.file = s.source_file and r.session_id = t.session_id
  and (string_split(r.dedup_key, ':')[1] = string_split(t.dedup_key, ':')[1] or r.ts = t.ts)) as source_line
from turns t join sessions s using (session_id)""")
def source_lines(t):
    first = F.split("dedup_key", ":")[0]
    turns = t.turns.select(F.col("line").cast("string").alias("turn_key"), "session_id", "ts", first.alias("message_id"))
    with_file = turns.join(t.sessions.select("session_id", "source_file"), "session_id")
    return detail.source_lines(with_file, t.raw.select("file", "session_id", "line", "ts", first.alias("message_id")))


@query("snippets", """
select conv_id, turn, case when length(text) > 40 then left(text, 40) || '…' else text end as snippet,
  case when starts_with(lower(text), 'e') then 1.0::double when contains(lower(text), 'e') then 0.7::double else 0.0::double end as score from conversations""", prelude="")
def snippets(t):
    rows = t.table("conversations")
    return rows.select("conv_id", "turn", text.snippet(F.col("text"), 40).alias("snippet"), text.match_score(F.lower("text"), "e").alias("score"))
