"""Drill-downs for one project, day, model, tool, skill, session or turn.

Each part of a drill-down is its own DataFrame; ``stored`` or ``persist`` the
filtered turns when several parts are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnledger import constants as K
from turnledger.functions import paths, pricing, ratios, text
from turnledger.functions.money import usd, usd_sum
from turnledger.operators import entity, ordered, series, topk
from turnledger.plans import breakdown, rollups
from turnledger.plans.breakdown import billed
from turnledger.sources import logs

ROW_CAP = 50


def _model() -> Column:
    return F.coalesce(F.nullif("model", F.lit("")), F.lit(K.UNKNOWN))


# -- project ---------------------------------------------------------------


def project_turns(turns: DataFrame, projects: DataFrame, project: str, since: str | None = None) -> DataFrame:
    """Turns of one project. Which sessions belong to it is a semi join on session ids."""
    members = projects.filter(F.col("project") == project).select("session_id")
    return series.in_days(turns, since, None).join(members, "session_id", "left_semi")


def project_sessions(session_rows: DataFrame, projects: DataFrame, project: str, since: str | None = None) -> DataFrame:
    members = projects.filter(F.col("project") == project).select("session_id")
    rows = session_rows.join(members, "session_id", "left_semi")
    return rows if since is None else rows.filter(F.to_date("last_ts") >= F.lit(since).cast("date"))


def project_scorecard(session_rows: DataFrame, project: str) -> DataFrame:
    """Cost, sessions and the flag of one project from the rollups of its sessions in range."""
    one = rollups.project_rollups(session_rows.withColumn("scope", F.lit(project)), "scope")
    found = one.agg(F.coalesce(F.max("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.coalesce(F.max("sessions"), F.lit(0)).alias("sessions"),
                    F.coalesce(F.bool_or("flagged"), F.lit(False)).alias("flagged"))
    return found.select(F.lit(project).alias("cwd"), "cost_usd", "sessions", "flagged")


def cache_trend(turns: DataFrame, range_name: str, today: str) -> DataFrame:
    """Hit rate and cost per day, or per hour of today when the range is one day."""
    if range_name == "1d":
        rollup = series.hourly(turns, today).withColumnRenamed("hour", "bucket")
    else:
        since = series.range_start(range_name, today)
        rollup = series.daily(turns, since, today if since else None).withColumnRenamed("date", "bucket")
    rate = ratios.hit_rate(F.col("cache_read_tokens"), F.col("cache_creation_tokens"), F.col("input_tokens"))
    return rollup.select("bucket", F.coalesce(rate, F.lit(0.0)).alias("hit_rate"), "cost_usd")


def top_turns(turns: DataFrame, top: int = 20) -> DataFrame:
    cost = usd(F.col("cost_units"))
    read, creation = F.col("cache_read_tokens"), F.col("cache_creation_tokens")
    rows = topk.top_rows(billed(turns), "cost_units", top, ["ts", "file", "line"])
    return rows.select(
        "ts", "session_id", "model", cost.alias("cost_usd"), *series.SUMS,
        ratios.hit_rate(read, creation, F.col("input_tokens")).alias("hit_rate"),
        ratios.cost_per_kw(cost, F.col("output_tokens")).alias("cost_per_kw"),
        ratios.ratio(read, F.col("output_tokens")).alias("ctx_ratio"),
    )


# -- day -------------------------------------------------------------------


def day_summary(turns: DataFrame, date: str, days: int = 7) -> DataFrame:
    """Cost of the day against the median of the week that ends with it."""
    after = breakdown._days_back(date, -1)
    since = breakdown._days_back(date, days)
    week = series.daily(turns, since, date)
    median = series.trailing(week, "cost_usd", after, days).select("median")
    total = series.in_days(turns, date, date).agg(usd_sum(F.col("cost_units")).alias("total_cost"), F.count(F.lit(1)).alias("turns"))
    joined = topk.beside(total, median)
    against = ratios.ratio(F.col("total_cost"), F.col("median"))
    return joined.select(
        "turns", "total_cost", against.alias("delta_vs_7d_median"),
        F.when(against >= 2.0, "cost_2sigma").alias("anomaly_flag"),
    )


def day_hours(turns: DataFrame, date: str) -> DataFrame:
    rollup = (
        series.in_days(turns, date, date)
        .groupBy(F.hour("ts").alias("hour"))
        .agg(usd_sum(F.col("cost_units")).alias("cost_usd"), F.count(F.lit(1)).alias("turns"))
    )
    hours = turns.sparkSession.sql("select explode(sequence(0, 23)) as hour")
    return series.filled(hours, rollup, ["hour"])


def day_hour_models(turns: DataFrame, date: str) -> DataFrame:
    """Turns per hour and model."""
    return (
        series.in_days(turns, date, date)
        .filter(F.coalesce("model", F.lit("")) != "")
        .groupBy(F.hour("ts").alias("hour"), "model")
        .agg(F.count(F.lit(1)).alias("turns"))
    )


def day_sessions(session_rows: DataFrame, turns: DataFrame, date: str) -> DataFrame:
    """Rollups of the sessions with a turn on the day."""
    active = series.in_days(turns, date, date).select("session_id").distinct()
    return session_rows.join(active, "session_id", "left_semi")


def day_verdicts(session_rows: DataFrame, turns: DataFrame, date: str) -> DataFrame:
    return rollups.verdict_counts(day_sessions(session_rows, turns, date))


def day_projects(session_rows: DataFrame, turns: DataFrame, date: str, top: int = 10) -> DataFrame:
    """The costliest projects among the sessions with a turn on the day."""
    return topk.top_rows(projects_since(day_sessions(session_rows, turns, date), date), "cost_usd", top, ["cwd"])


def projects_since(session_rows: DataFrame, since: str) -> DataFrame:
    """Projects of the sessions that were active on the day or later."""
    return rollups.project_rollups(session_rows.filter(F.to_date("last_ts") >= F.lit(since).cast("date")))


# -- model, tool, skill ------------------------------------------------------


def model_turns(turns: DataFrame, name: str) -> DataFrame:
    return turns.filter((F.col("model") == name) | (pricing.short_model(F.col("model")) == name))


def model_scorecard(rows: DataFrame) -> DataFrame:
    """Cost, turns and the four cost components of the turns of one model; no row without turns."""
    sums = rows.agg(usd_sum(F.col("cost_units")).alias("cost_usd"), F.count(F.lit(1)).alias("turns"), *rollups.component_sums())
    return sums.filter("turns > 0")


def costed_tools(turns: DataFrame, per_tool: DataFrame) -> DataFrame:
    """Tools of a drill-down by cost, calls and last activity; the unattributed rest is not a tool."""
    return breakdown.tool_costs(turns, per_tool).filter(F.col("name") != K.UNATTRIBUTED_TOOL)


def costed_skills(turns: DataFrame) -> DataFrame:
    """Skills with a cost of their own; a skill that was only called is not listed."""
    return breakdown.skill_costs(turns).filter(F.col("cost_usd").isNotNull())


def projects_of(turns: DataFrame, projects: DataFrame) -> DataFrame:
    """Cost, turns and last activity per project."""
    per_session = turns.groupBy("session_id").agg(
        F.sum("cost_units").alias("cost_units"), F.count(F.lit(1)).alias("turns"), F.max("ts").alias("last_active")
    )
    return entity.with_project(per_session, projects).groupBy(F.col("project").alias("cwd")).agg(
        usd_sum(F.col("cost_units")).alias("cost_usd"), F.sum("turns").alias("turns"), F.max("last_active").alias("last_active")
    )


def tool_turns(turns: DataFrame, per_tool: DataFrame, tool: str) -> DataFrame:
    """Billed turns that hold a slice of the tool or called it, with that slice and the number of calls.

    The names kept for skills, unknown results and the rest are not tools: no row.
    """
    if tool in (K.SKILL_TOOL, K.UNKNOWN_TOOL, K.UNATTRIBUTED_TOOL):
        turns = turns.limit(0)
    own = per_tool.filter(F.col("tool") == tool).select(*breakdown.PLACE, "tool_usd", "tool_output_tokens")
    calls = F.coalesce(F.element_at("tool_names", F.lit(tool)), F.lit(0))
    return (
        billed(turns)
        .join(own, breakdown.PLACE, "left")
        .withColumn("calls", calls)
        .filter("tool_usd is not null or calls > 0")
        .withColumn("tool_usd", F.coalesce("tool_usd", F.lit(0.0)))
    )


def tool_scorecard(turns: DataFrame, rows: DataFrame, projects: DataFrame, today: str) -> DataFrame:
    """Totals of one tool: cost, share of all spend, calls, calls of the last week, top project."""
    week = F.lit(breakdown._days_back(today, 6)).cast("timestamp")
    sums = rows.agg(
        F.sum("tool_usd").alias("cost_usd"),
        F.coalesce(F.sum("tool_output_tokens"), F.lit(0.0)).alias("output_tokens"),
        F.sum("calls").alias("invocations"),
        F.coalesce(F.sum(F.when(F.col("ts") >= week, F.col("calls"))), F.lit(0)).alias("invocations_7d"),
    )
    grand = billed(turns).agg(usd_sum(F.col("cost_units")).alias("grand_total"))
    lead = tool_projects(rows, projects).orderBy(F.desc("cost_usd"), "cwd").limit(1).select(
        F.col("label").alias("top_project"), F.col("cost_usd").alias("top_cost")
    )
    return topk.beside(sums, grand, lead).select(
        "cost_usd", "output_tokens", "invocations", "invocations_7d",
        F.coalesce(ratios.ratio(F.col("cost_usd"), F.col("grand_total")), F.lit(0.0)).alias("share_of_total"),
        "top_project", F.coalesce(ratios.ratio(F.col("top_cost"), F.col("cost_usd")), F.lit(0.0)).alias("top_share"),
    )


def tool_projects(rows: DataFrame, projects: DataFrame) -> DataFrame:
    per_session = rows.groupBy("session_id").agg(
        F.sum("tool_usd").alias("usd"), F.sum("calls").alias("calls"), F.max("ts").alias("last_active")
    )
    known = F.col("cwd") != K.UNKNOWN
    return (
        entity.with_project(per_session, projects)
        .groupBy(F.col("project").alias("cwd"))
        .agg(F.sum("usd").alias("cost_usd"), F.sum("calls").alias("invocations"), F.max("last_active").alias("last_active"))
        .withColumn("label", F.when(known, paths.basename(F.col("cwd"))).otherwise(K.NO_PROJECT))
        .withColumn("cwd_b64", F.when(known, paths.encode_cwd(F.col("cwd"))))
    )


def tool_models(rows: DataFrame) -> DataFrame:
    return rows.groupBy(_model().alias("name")).agg(F.sum("tool_usd").alias("cost_usd"), F.sum("calls").alias("invocations"))


def capped(rows: DataFrame, name: str, cap: int = ROW_CAP) -> DataFrame:
    """The report's own limit on long lists."""
    return topk.top_rows(rows, "cost_usd", cap, [name])


def skill_turns(turns: DataFrame, skill: str) -> DataFrame:
    return billed(turns).filter(F.col("attribution_skill") == skill)


def skill_scorecard(turns: DataFrame, skill: str, projects: DataFrame, today: str) -> DataFrame:
    """Totals of one skill, split into inline and sub-agent work, from one pass over the turns."""
    own = F.col("attribution_skill") == skill
    uses = F.coalesce(F.element_at("skill_names", F.lit(skill)), F.lit(0))
    week = F.lit(breakdown._days_back(today, 6)).cast("timestamp")
    sums = billed(turns).agg(
        usd_sum(F.when(own, F.col("cost_units"))).alias("cost_usd"),
        F.coalesce(F.sum(F.when(own, F.col("output_tokens"))), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum(uses), F.lit(0)).alias("invocations"),
        F.coalesce(F.sum(F.when(F.col("ts") >= week, uses)), F.lit(0)).alias("invocations_7d"),
        usd_sum(F.when(own & ~F.col("is_sidechain"), F.col("cost_units"))).alias("inline_usd"),
        usd_sum(F.when(own & F.col("is_sidechain"), F.col("cost_units"))).alias("subagent_usd"),
        usd_sum(F.col("cost_units")).alias("grand_total"),
        F.count_if(own).alias("n"),
    )
    lead = projects_of(skill_turns(turns, skill), projects).orderBy(F.desc("cost_usd"), "cwd").limit(1).select(
        F.when(F.col("cwd") == K.UNKNOWN, K.NO_PROJECT).otherwise(paths.basename(F.col("cwd"))).alias("top_project")
    )
    return topk.beside(sums, lead).filter("n > 0 or invocations > 0").select(
        "cost_usd", "output_tokens", "invocations", "invocations_7d", "inline_usd", "subagent_usd",
        F.coalesce(ratios.ratio(F.col("cost_usd"), F.col("grand_total")), F.lit(0.0)).alias("share_of_total"), "top_project",
    )


def skill_models(turns: DataFrame, skill: str) -> DataFrame:
    return skill_turns(turns, skill).groupBy(_model().alias("name")).agg(usd_sum(F.col("cost_units")).alias("cost_usd"))


# -- session and turn --------------------------------------------------------


def session_turn_rows(numbered: DataFrame) -> DataFrame:
    """Turn rows of sessions with the four cost components."""
    return numbered.select(
        "session_id", "turn_idx", "ts", "model", *series.SUMS, usd(F.col("cost_units")).alias("cost_usd"),
        "is_sidechain", "tool_use_count", "tool_error_count", "stop_reason",
        *[usd(F.col(f"{c}_units")).alias(f"{c}_usd") for c in rollups.COMPONENTS],
    )


def smoothed_hit_rate(numbered: DataFrame) -> DataFrame:
    """Five-point average of the per-turn hit rate; the first rows use the first five turns."""
    rate = F.coalesce(
        ratios.hit_rate(F.col("cache_read_tokens"), F.col("cache_creation_tokens"), F.col("input_tokens")), F.lit(0.0)
    )
    rows = numbered.select("session_id", "turn_idx", rate.alias("rate"))
    blocked, window = ordered.neighbourhoods(rows, ["session_id"], "turn_idx", 2, 4)
    mean = lambda a, b: F.avg("rate").over(window.rowsBetween(a, b))
    value = F.when(F.col("turn_idx") == 0, mean(0, 4)).when(F.col("turn_idx") == 1, mean(-1, 3)).otherwise(mean(-2, 2))
    return blocked.withColumn("smoothed", value).filter("core").select("session_id", "turn_idx", "rate", "smoothed")


def growth_line(numbered: DataFrame) -> DataFrame:
    """Fitted context line per session: first context plus slope times position."""
    fit = numbered.groupBy("session_id").agg(
        F.min_by("ctx", "turn_idx").alias("ctx0"),
        ratios.exact_slope(F.col("turn_idx"), F.col("ctx")).alias("slope"),
    )
    return numbered.select("session_id", "turn_idx", "ctx").join(fit, "session_id").select(
        "session_id", "turn_idx", "ctx", (F.col("ctx0") + F.col("slope") * F.col("turn_idx")).alias("fitted"),
        ratios.growth_class(F.col("slope")).alias("badge"),
    )


def top_in_time_order(numbered: DataFrame, session_id: str, top: int = 30) -> DataFrame:
    """The costliest turns of a session, shown in the order they happened."""
    own = numbered.filter(F.col("session_id") == session_id)
    return topk.top_rows(own, "cost_units", top, ["turn_idx"]).orderBy("turn_idx")


def stop_reasons(turns: DataFrame, keys: list[str]) -> DataFrame:
    return turns.groupBy(*keys, text.stop_reason(F.col("stop_reason")).alias("stop_reason")).agg(F.count(F.lit(1)).alias("turns"))


def prior_prompts(events: DataFrame) -> DataFrame:
    """Assistant lines with the nearest earlier user line of the same file and session.

    ``events``: file, session_id, line, role, text. An empty prompt still counts
    as the nearest one.
    """
    placed = events.withColumn("block", ordered.line_chunk())
    linked = ordered.scan(
        placed, ["file", "session_id"], ["line"], "block",
        {"prompt": ("last", F.when(F.col("role") == "user", F.struct(F.coalesce("text", F.lit("")).alias("text"))))},
    )
    return linked.filter(F.col("role") == "assistant").select(
        "file", "session_id", "line",
        text.snippet(F.coalesce("prompt.text", F.lit(""))).alias("user_prompt"),
        text.snippet(F.coalesce("text", F.lit(""))).alias("assistant_preview"),
    )


def call_outcomes(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Tool calls with an ok flag: not ok once any result for the id, in the file and session, is an error.

    ``calls``: file, session_id, line, pos, name, block_id. ``results``: file,
    session_id, tool_use_id, is_error. Errors are reduced to distinct ids first.
    """
    failed = (
        results.filter("is_error")
        .select("file", "session_id", F.col("tool_use_id").alias("block_id"))
        .distinct()
        .withColumn("failed", F.lit(True))
    )
    return calls.join(failed, ["file", "session_id", "block_id"], "left").select(
        "file", "session_id", "line", "pos", F.coalesce("name", F.lit("")).alias("name"), F.col("failed").isNull().alias("ok")
    )


def source_lines(turns: DataFrame, events: DataFrame) -> DataFrame:
    """First assistant line of each turn in its session's file: by message id or by equal timestamp.

    ``turns``: session_id, source_file, turn_key, message_id, ts; ``events``: file,
    session_id, line, message_id, ts and, where other than assistant lines are in
    it, type. Events are reduced to their first line per
    id and per timestamp, so two equi-joins with at most one match each replace
    the or-condition.
    """
    side = events.filter(F.col("type") == "assistant") if "type" in events.columns else events
    side = side.withColumnRenamed("file", "source_file")
    at = ["source_file", "session_id"]
    by_id = side.filter(F.col("message_id").isNotNull()).groupBy(*at, "message_id").agg(F.min("line").alias("id_line"))
    by_ts = side.groupBy(*at, "ts").agg(F.min("line").alias("ts_line"))
    return (
        turns.join(by_id, [*at, "message_id"], "left")
        .join(by_ts, [*at, "ts"], "left")
        .select("turn_key", "session_id", F.least("id_line", "ts_line").alias("source_line"))
    )


def turn_context(events: DataFrame, turns: DataFrame) -> DataFrame:
    """What the logs say about turns: prior prompt, preview, source line and calls with their outcome.

    ``events`` are parsed log lines with line numbers, ``turns`` (session_id,
    source_file, turn_key, message_id, ts) the turns to explain. One row per turn,
    its calls as an array in the order of the message, which bounds it.
    """
    lines = source_lines(turns, events).join(turns.select("turn_key", "session_id", F.col("source_file").alias("file")), ["turn_key", "session_id"])
    own = events.join(turns.select(F.col("source_file").alias("file"), "session_id").distinct(), ["file", "session_id"], "left_semi")
    said = own.filter(F.col("type").isin("user", "assistant")).select("file", "session_id", "line", F.col("type").alias("role"), logs.message_text(F.col("content")).alias("text"))
    at = ["file", "session_id", "line"]
    blocks = logs.content_blocks(own).join(own.select(*at), ["file", "line"])
    outcomes = call_outcomes(blocks.filter("kind = 'tool_use'"), blocks.filter("kind = 'tool_result'"))
    calls = outcomes.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("pos", "name", "ok"))).alias("calls"))
    found = lines.withColumnRenamed("source_line", "line").join(prior_prompts(said), at, "left").join(calls, at, "left")
    return found.select("turn_key", "session_id", F.col("line").alias("source_line"), "user_prompt", "assistant_preview", "calls")


def turn_detail(numbered: DataFrame, session_id: str, turn_idx: int) -> DataFrame:
    """Cost components and token counts of one turn."""
    return numbered.filter((F.col("session_id") == session_id) & (F.col("turn_idx") == turn_idx)).select(
        "session_id", "turn_idx", "ts", "model", "stop_reason", "is_sidechain",
        *[usd(F.col(f"{c}_units")).alias(f"{c}_usd") for c in rollups.COMPONENTS],
        *series.SUMS, F.col("ctx").alias("total_visible"),
    )
