"""Where the money went: by tool, skill, project, model and day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from turnledger import constants as K
from turnledger.functions import paths, pricing, ratios
from turnledger.functions.money import usd, usd_sum
from turnledger.operators import entity, series, topk
from turnledger.operators.series import SUMS
from turnledger.plans import rollups
from turnledger.session import stored

PLACE = ["file", "line"]
PRORATA, EXCLUDE_READS = "prorata", "excl_cache_read"


def billed(turns: DataFrame) -> DataFrame:
    return turns.filter(~F.col("is_interrupted"))


def tool_rows(turns: DataFrame, per_tool: DataFrame, columns: list[str]) -> DataFrame:
    """Tool slices of the kept turns; (file, line) is unique on the turn side, so the join cannot skew."""
    return per_tool.join(turns.select(*PLACE, *columns), PLACE)


def tool_breakdown(
    turns: DataFrame, per_tool: DataFrame, rest: DataFrame, mode: str = PRORATA, top: int = 10
) -> DataFrame:
    """Cost per tool, the tail collapsed, and what no tool caused.

    ``prorata`` splits the whole input side; ``excl_cache_read`` leaves cache
    reads out of the split, their cost goes to the remainder. An unknown mode
    means prorata. The Skill tool has its own breakdown and is left out.
    """
    reads_out = mode == EXCLUDE_READS
    kept = billed(turns)
    slices = per_tool.select(
        *PLACE, "tool", F.col("tool_usd_uncached" if reads_out else "tool_usd").alias("usd")
    ).unionByName(rest.select(*PLACE, F.lit(K.UNATTRIBUTED_TOOL).alias("tool"), F.col("rest_usd").alias("usd")))
    rows = tool_rows(kept, slices, ["ts", "tool_names", "cost_units"])
    called = F.map_contains_key(F.coalesce("tool_names", F.create_map().cast("map<string,bigint>")), F.col("tool"))
    sums = rows.groupBy("tool").agg(
        F.sum("usd").alias("cost_usd"), F.max(F.when(called, F.col("ts"))).alias("last_active")
    )
    calls = rollups.tool_calls(kept, [])
    # One small row per tool, read three times below.
    named = stored(sums.join(calls, "tool", "full").filter(F.col("tool") != K.SKILL_TOOL), "tools")
    reserved = F.col("tool").isin(K.UNKNOWN_TOOL, K.UNATTRIBUTED_TOOL)
    real = named.filter(~reserved & F.col("cost_usd").isNotNull()).withColumn("calls", F.coalesce("calls", F.lit(0)))
    ranked = topk.head_and_other(real, "tool", "cost_usd", top, K.OTHER, extra=("calls",), keep=("last_active",))
    # Calls of tools that never cost anything belong to the tail when there is one.
    uncosted = named.filter("cost_usd is null").agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls")).select(
        F.lit(K.OTHER).alias("tool"), "calls"
    )
    shown = (
        ranked.withColumn("ranked", F.lit(1))
        .unionByName(uncosted, allowMissingColumns=True)
        .groupBy(F.col("tool").alias("name"))
        .agg(
            F.max("cost_usd").alias("cost_usd"), F.sum("calls").alias("count"), F.max("members").alias("tool_count"),
            F.max("last_active").alias("last_active"), F.count("ranked").alias("ranked"),
        )
        .filter("ranked > 0")
        .drop("ranked")
    )
    if reads_out:
        # Every billed turn has a remainder row, so every turn is in this grouping.
        tool_usd = F.coalesce(F.sum(F.when(~reserved, F.col("usd"))), F.lit(0.0))
        per_turn = rows.groupBy(*PLACE).agg(usd(F.max("cost_units")).alias("total"), tool_usd.alias("spent"))
        remainder = per_turn.agg(F.sum(F.greatest(F.col("total") - F.col("spent"), F.lit(0.0))).alias("cost_usd"))
    else:
        remainder = named.filter(reserved).agg(F.sum("cost_usd").alias("cost_usd"))
    none = F.lit(None).cast("bigint")
    return shown.unionByName(
        remainder.select(
            F.lit(K.UNATTRIBUTED_TOOL).alias("name"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
            none.alias("count"), none.alias("tool_count"), F.lit(None).cast("timestamp").alias("last_active"),
        )
    )


def billable_tokens(turns: DataFrame, rest: DataFrame) -> DataFrame:
    """Input plus output tokens, and the part of them that no tool caused.

    The remainder's input is a share of the whole input pool; that share is
    applied to plain input tokens only.
    """
    rows = billed(turns).join(rest, PLACE, "left")
    pool = ratios.context_tokens()
    inp, out = F.col("input_tokens"), F.col("output_tokens")
    share = F.when(pool > 0, F.coalesce("rest_input_tokens", F.lit(0.0)) / pool).otherwise(0.0)
    return rows.agg(
        F.coalesce(F.sum(inp + out), F.lit(0)).alias("total_billable_tokens"),
        F.coalesce(F.sum(share * inp + F.coalesce("rest_output_tokens", F.lit(0.0))), F.lit(0.0)).alias("nontool_billable_tokens"),
    )


def tool_costs(turns: DataFrame, per_tool: DataFrame, rest_name: str = K.UNATTRIBUTED_TOOL) -> DataFrame:
    """Cost, calls and last activity per tool over all turns; unknown results count as unattributed."""
    rows = tool_rows(turns, per_tool, ["ts"]).filter(F.col("tool") != K.SKILL_TOOL)
    known = F.col("tool") != K.UNKNOWN_TOOL
    costs = rows.groupBy(F.when(known, F.col("tool")).otherwise(rest_name).alias("tool")).agg(
        F.sum("tool_usd").alias("cost_usd"), F.max(F.when(known, F.col("ts"))).alias("cost_ts")
    )
    calls = (
        turns.select("ts", F.explode("tool_names").alias("tool", "calls"))
        .filter(F.col("tool") != K.SKILL_TOOL)
        .groupBy("tool")
        .agg(F.sum("calls").alias("calls"), F.max("ts").alias("call_ts"))
    )
    return costs.join(calls, "tool", "full").select(
        F.col("tool").alias("name"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        F.coalesce("calls", F.lit(0)).alias("invocations"),
        F.greatest("cost_ts", "call_ts").alias("last_active"),
    )


def skill_costs(turns: DataFrame) -> DataFrame:
    """Cost, invocations and last activity per skill; NULL cost where it was only invoked."""
    kept = billed(turns)
    costs = (
        kept.filter(F.coalesce("attribution_skill", F.lit("")) != "")
        .groupBy(F.col("attribution_skill").alias("skill"))
        .agg(usd_sum(F.col("cost_units")).alias("cost_usd"), F.max("ts").alias("last_active"))
    )
    calls = kept.select(F.explode("skill_names").alias("skill", "n")).groupBy("skill").agg(F.sum("n").alias("invocations"))
    return costs.join(calls, "skill", "full").select(
        "skill", "cost_usd", F.coalesce("invocations", F.lit(0)).alias("invocations"), "last_active"
    )


def skill_breakdown(turns: DataFrame, top: int = 10) -> DataFrame:
    """Skills ranked by the full cost of the turns they own, the tail in one row."""
    costs = skill_costs(turns).filter("cost_usd is not null")
    ranked = topk.head_and_other(
        costs, "skill", "cost_usd", top, K.OTHER, extra=("invocations",), keep=("last_active",)
    )
    return ranked.select(
        F.col("skill").alias("name"), "cost_usd", "invocations", F.col("members").alias("tool_count"), "last_active"
    )


def skill_totals(turns: DataFrame) -> DataFrame:
    """Spend and billable tokens in all and under a skill, and skills invoked without a cost of their own."""
    inp_out = F.col("input_tokens") + F.col("output_tokens")
    owned = F.coalesce("attribution_skill", F.lit("")) != ""
    totals = billed(turns).agg(
        usd_sum(F.col("cost_units")).alias("total_cost"),
        usd_sum(F.when(owned, F.col("cost_units"))).alias("skill_cost"),
        F.coalesce(F.sum(inp_out), F.lit(0)).alias("total_billable_tokens"),
        F.coalesce(F.sum(F.when(owned, inp_out)), F.lit(0)).alias("skill_billable_tokens"),
    )
    idle = skill_costs(turns).filter("cost_usd is null and invocations > 0").agg(
        F.count(F.lit(1)).alias("uncharged_skills"), F.coalesce(F.sum("invocations"), F.lit(0)).alias("uncharged_uses")
    )
    return (
        topk.beside(totals, idle)
        .withColumn("spend_share", ratios.ratio(F.col("skill_cost"), F.col("total_cost")))
        .withColumn("token_share", ratios.ratio(F.col("skill_billable_tokens"), F.col("total_billable_tokens")))
    )


def tool_shares(breakdown: DataFrame, tokens: DataFrame) -> DataFrame:
    """Share of spend and of billable tokens that went through tool calls."""
    rest = F.col("name") == K.UNATTRIBUTED_TOOL
    spend = breakdown.agg(
        F.coalesce(F.sum(F.when(~rest, F.col("cost_usd"))), F.lit(0.0)).alias("tool_cost"), F.sum("cost_usd").alias("all_cost")
    )
    tool_tokens = F.greatest(F.col("total_billable_tokens") - F.col("nontool_billable_tokens"), F.lit(0.0))
    return topk.beside(spend, tokens).select(
        "tool_cost",
        ratios.ratio(F.col("tool_cost"), F.col("all_cost")).alias("spend_share"),
        ratios.ratio(tool_tokens, F.col("total_billable_tokens")).alias("token_share"),
    )


def summary(turns: DataFrame, since: str | None = None) -> DataFrame:
    return series.in_days(turns, since, None).agg(
        F.countDistinct("session_id").alias("sessions"),
        *series.measures(),
        usd_sum(F.col("cache_saved_units")).alias("cache_saved_usd"),
    )


def daily_tokens(turns: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Tokens and cost components per day in one aggregation, zero-filled when both bounds are given."""
    rollup = series.in_days(turns, since, until).groupBy(series.day().alias("date")).agg(
        *[F.sum(c).alias(c) for c in SUMS],
        usd_sum(F.col("cost_units")).alias("cost_usd"),
        *rollups.component_sums("_cost"),
    )
    if since is None or until is None:
        return rollup
    return series.filled(series.days_between(turns.sparkSession, since, until), rollup, ["date"])


def by_project(turns: DataFrame, projects: DataFrame, since: str | None = None) -> DataFrame:
    """Tokens and cost components per project; reduced per session before the project is joined."""
    units = [f"{c}_units" for c in rollups.COMPONENTS]
    per_session = (
        billed(series.in_days(turns, since, None))
        .groupBy("session_id")
        .agg(*[F.sum(c).alias(c) for c in (*SUMS, *units)])
    )
    read, creation, inp = F.col("cache_read_tokens"), F.col("cache_creation_tokens"), F.col("input_tokens")
    sums = entity.with_project(per_session, projects).groupBy("project").agg(
        *[F.sum(c).alias(c) for c in SUMS], *rollups.component_sums("_cost")
    )
    known = F.col("project") != K.UNKNOWN
    return sums.select(
        F.when(known, paths.basename(F.col("project"))).otherwise(K.UNKNOWN).alias("name"),
        F.col("project").alias("cwd"),
        F.when(known, paths.encode_cwd(F.col("project"))).alias("cwd_b64"),
        *[c for c in SUMS], *[f"{c}_cost" for c in rollups.COMPONENTS],
        ratios.hit_rate(read, creation, inp).alias("cache_hit_rate"),
    )


def by_model(turns: DataFrame, since: str | None = None) -> DataFrame:
    """Billable tokens, cost, shares and price status per model."""
    sums = (
        billed(series.in_days(turns, since, None))
        .groupBy(F.coalesce(F.nullif("model", F.lit("")), F.lit(K.UNKNOWN)).alias("model"))
        .agg(
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            usd_sum(F.col("cost_units")).alias("cost_usd"),
        )
        .withColumn("billable", F.col("input_tokens") + F.col("output_tokens"))
    )
    shared = rollups.with_model_share(rollups.with_model_share(sums, "billable", "share"), "cost_usd", "cost_share")
    return shared.withColumn("price_status", pricing.price_status(F.col("model")))


def tool_daily(turns: DataFrame, per_tool: DataFrame, tool: str, today: str, days: int = 30) -> DataFrame:
    """Cost of one tool per day over the last days, zero-filled."""
    since = _days_back(today, days - 1)
    kept = billed(series.in_days(turns, since, today))
    rows = tool_rows(kept, per_tool.filter(F.col("tool") == tool), ["ts"])
    rollup = rows.groupBy(series.day().alias("date")).agg(F.sum("tool_usd").alias("cost_usd"))
    return series.filled(series.days_between(turns.sparkSession, since, today), rollup, ["date"])


def skill_daily(turns: DataFrame, skill: str, today: str, days: int = 30) -> DataFrame:
    since = _days_back(today, days - 1)
    rollup = (
        billed(series.in_days(turns, since, today))
        .filter(F.col("attribution_skill") == skill)
        .groupBy(series.day().alias("date"))
        .agg(usd_sum(F.col("cost_units")).alias("cost_usd"))
    )
    return series.filled(series.days_between(turns.sparkSession, since, today), rollup, ["date"])


def _days_back(today: str, days: int) -> str:
    return str(dt.date.fromisoformat(today) - dt.timedelta(days=days))
