"""Session, project and model rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnledger import constants as K
from turnledger.functions import pricing, ratios
from turnledger.functions.money import units_sum, usd_sum
from turnledger.operators import ordered, topk, windows5h
from turnledger.operators.series import SUMS

COMPONENTS = ("input", "output", "cache_read", "cache_creation")


def component_sums(suffix: str = "_usd") -> list[Column]:
    return [usd_sum(F.col(f"{c}_units")).alias(f"{c}{suffix}") for c in COMPONENTS]


def dominant_model(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent model per key; on a tie the one seen first."""
    counted = (
        turns.filter(F.coalesce("model", F.lit("")) != "")
        .groupBy(*keys, "model")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "file", "line")).alias("seen"))
    )
    return counted.groupBy(*keys).agg(F.min_by("model", F.struct(-F.col("n"), "seen")).alias("model"))


def session_rollups(turns: DataFrame, sessions: DataFrame, limits: dict | None = None) -> DataFrame:
    """One row per session with its verdict.

    Only the billed position needs an order; it comes from an hourly-chunked
    scan. Everything else is one partial aggregation per session, joined with
    per-session results (dominant model, costliest window, first-seen values).
    """
    billed = ~F.col("is_interrupted")
    steps = ordered.with_position(
        turns.withColumn("chunk", ordered.time_chunk()), ["session_id"], ["ts", "file", "line"], "chunk", "step", billed
    ).withColumn("ctx", ratios.context_tokens())
    latest = F.when(billed, F.struct("ts", "file", "line"))
    sums = steps.groupBy("session_id").agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("turns"),
        *[F.sum(c).alias(c) for c in SUMS],
        (units_sum(F.col("cost_units")) / float(K.USD_UNITS)).alias("cost_usd"),
        F.coalesce(F.max(F.when(billed, F.col("ctx"))), F.lit(0)).alias("max_turn_input"),
        ratios.exact_slope(F.when(billed, F.col("step")), F.col("ctx")).alias("context_growth"),
        F.sum("tool_use_count").alias("tool_use_count"),
        F.sum("tool_error_count").alias("tool_error_count"),
        F.max_by("ctx", latest).alias("latest_ctx"),
    )
    dimension = sessions.select("session_id", "source_file", "cwd", "is_sidechain")
    read, creation, out = F.col("cache_read_tokens"), F.col("cache_creation_tokens"), F.col("output_tokens")
    return (
        sums.join(dominant_model(turns, ["session_id"]), "session_id", "left")
        .join(windows5h.peak_window_cost(turns, ["session_id"]), "session_id", "left")
        .join(dimension, "session_id", "left")
        .withColumns(
            {
                "peak_window_cost": F.coalesce("peak_window_cost", F.lit(0.0)),
                "is_sidechain": F.coalesce("is_sidechain", F.lit(False)),
                "cache_reuse_ratio": ratios.reuse_share(read, creation),
                "cache_hit_rate": ratios.hit_rate(read, creation, F.col("input_tokens")),
                "ctx_ratio": ratios.ratio(read, out),
                "cache_reuse": ratios.ratio(read, creation),
                "cost_per_kw": ratios.cost_per_kw(F.col("cost_usd"), out),
                "tool_error_rate": F.coalesce(
                    ratios.ratio(F.col("tool_error_count"), F.col("tool_use_count")), F.lit(0.0)
                ),
                "ctx_used": F.col("latest_ctx") / pricing.context_window(F.col("model")),
            }
        )
        .withColumn("verdict", ratios.verdict(limits))
    )


def tool_calls(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Calls per (keys, tool) from the tool name counts."""
    return (
        turns.select(*keys, F.explode("tool_names").alias("tool", "calls"))
        .groupBy(*keys, "tool")
        .agg(F.sum("calls").alias("calls"))
    )


def tool_mix(turns: DataFrame, top: int = 10) -> DataFrame:
    """Tool calls ranked, the tail in one row."""
    ranked = topk.head_and_other(tool_calls(turns, []), "tool", "calls", top, other="others")
    return ranked.select("tool", F.col("calls").alias("count"))


def verdict_counts(rollups: DataFrame) -> DataFrame:
    """Sessions per verdict, zeros kept."""
    names = rollups.sparkSession.sql("select explode(array(" + ",".join(f"'{v}'" for v in K.VERDICTS) + ")) as verdict")
    counted = rollups.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counted, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("sessions"))


def project_rollups(rollups: DataFrame, key: str = "cwd") -> DataFrame:
    """Session rollups per project. Sessions without a directory form one project."""
    read, creation = F.col("cache_read_tokens"), F.col("cache_creation_tokens")
    inp, out = F.col("input_tokens"), F.col("output_tokens")
    f = K.PROJECT_FLAGS
    mix = [F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in K.VERDICTS]
    sums = rollups.groupBy(F.coalesce(F.nullif(key, F.lit("")), F.lit(K.UNKNOWN)).alias("cwd")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("turns").alias("turns"),
        *[F.sum(c).alias(c) for c in SUMS],
        usd_sum(F.round(F.col("cost_usd") * float(K.USD_UNITS)).cast("bigint")).alias("cost_usd"),
        F.coalesce(F.avg(F.when(F.col("context_growth") != 0.0, F.col("context_growth"))), F.lit(0.0)).alias("avg_context_growth"),
        F.sum("tool_use_count").alias("tool_use_count"),
        F.sum("tool_error_count").alias("tool_error_count"),
        F.max("peak_window_cost").alias("peak_window_cost"),
        F.max_by("ctx_used", F.struct("last_ts", "session_id")).alias("ctx_used"),
        *mix,
    )
    return (
        sums.withColumns(
            {
                "cache_reuse_ratio": ratios.reuse_share(read, creation),
                "cache_hit_rate": ratios.hit_rate(read, creation, inp),
                "cache_creation_dominance": creation / F.greatest(read, F.lit(1)),
                "tool_error_rate": F.coalesce(ratios.ratio(F.col("tool_error_count"), F.col("tool_use_count")), F.lit(0.0)),
                "ctx_ratio": ratios.ratio(read, out),
                "cache_reuse": ratios.ratio(read, creation),
                "cost_per_kw": ratios.cost_per_kw(F.col("cost_usd"), out),
            }
        )
        .withColumn(
            "flagged",
            F.coalesce(F.col("cache_hit_rate") < f["hit_rate"], F.lit(False))
            | (F.col("cache_creation_dominance") > f["creation_dominance"])
            | (F.col("avg_context_growth") > f["growth"])
            | (F.col("tool_error_rate") > f["error_rate"])
            | (F.col("n_ok") < F.col("sessions")),
        )
    )


def project_model_mix(rollups: DataFrame, key: str = "cwd") -> DataFrame:
    """Share of a project's cost per dominant model of its sessions."""
    name = F.coalesce(F.nullif(key, F.lit("")), F.lit(K.UNKNOWN)).alias("cwd")
    units = F.round(F.col("cost_usd") * float(K.USD_UNITS)).cast("bigint")
    known = rollups.filter(F.col("model").isNotNull())
    part = known.groupBy(name, "model").agg(usd_sum(units).alias("cost_usd"))
    total = known.groupBy(name).agg(usd_sum(units).alias("total"))
    share = F.when(F.col("total") > 0, F.col("cost_usd") / F.col("total")).otherwise(F.col("cost_usd"))
    return part.join(total, "cwd").select("cwd", "model", share.alias("share"))


def with_model_share(rollup: DataFrame, value: str, share: str) -> DataFrame:
    """Share of the grand total. For rows already reduced to one per model, a short list."""
    total = F.sum(value).over(Window.partitionBy())
    return rollup.withColumn(share, F.when(total > 0, F.col(value) / total).otherwise(F.col(value) * 1.0))


def model_rollups(turns: DataFrame) -> DataFrame:
    """Turns per model with cost components, ratios and cost share."""
    read, creation, out = F.col("cache_read_tokens"), F.col("cache_creation_tokens"), F.col("output_tokens")
    sums = turns.groupBy(F.coalesce(F.nullif("model", F.lit("")), F.lit(K.UNKNOWN)).alias("model")).agg(
        F.count(F.lit(1)).alias("turns"),
        *[F.sum(c).alias(c) for c in SUMS],
        usd_sum(F.col("cost_units")).alias("cost_usd"),
        F.sum("tool_use_count").alias("tool_use_count"),
        F.sum("tool_error_count").alias("tool_error_count"),
        *component_sums(),
        F.count_if("is_sidechain").alias("sidechain_turns"),
        F.count_if("is_interrupted").alias("interrupted_turns"),
    )
    rated = sums.withColumns(
        {
            "hit_pct": ratios.hit_pct(read, creation, F.col("input_tokens")),
            "ctx_ratio": ratios.ratio(read, out),
            "cache_reuse": ratios.ratio(read, creation),
            "cost_per_kw": ratios.cost_per_kw(F.col("cost_usd"), out),
            "tool_error_rate": ratios.ratio(F.col("tool_error_count"), F.col("tool_use_count")),
        }
    )
    return with_model_share(rated, "cost_usd", "cost_share")


def session_totals(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id").agg(
        *[F.sum(c).alias(c) for c in SUMS], (units_sum(F.col("cost_units")) / float(K.USD_UNITS)).alias("cost_usd")
    )


SORT_KEYS = {
    "cost": "cost_usd",
    "input": "input_tokens",
    "output": "output_tokens",
    "cache_read": "cache_read_tokens",
    "turns": "turns",
    "max_input": "max_turn_input",
    "duration": "duration_s",
}


def top_sessions(rollups: DataFrame, sort: str = "cost", top: int = 20) -> DataFrame:
    span = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(1e6)
    return topk.top_rows(rollups.withColumn("duration_s", span), SORT_KEYS[sort], top, ["session_id"])


def growth_histogram(rollups: DataFrame) -> DataFrame:
    """Sessions per slope bucket, empty buckets kept."""
    names = ",".join(f"named_struct('bucket', {i}, 'label', '{label}')" for i, label in enumerate(K.GROWTH_LABELS))
    buckets = rollups.sparkSession.sql(f"select inline(array({names}))")
    counted = rollups.groupBy(ratios.growth_bucket(F.col("context_growth")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return buckets.join(counted, "bucket", "left").select("bucket", "label", F.coalesce("n", F.lit(0)).alias("sessions"))
