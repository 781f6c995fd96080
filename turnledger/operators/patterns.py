"""Detectors over the turns of a session.

Input of each detector: ``session_id``, ``turn_idx`` (0-based position, see
``numbered``) and the turn's columns. Bounded look-ahead runs on blocks of
positions with a copied margin; unbounded state is carried between blocks. Hits
name their turns as a range, or as rows of ``pattern_turns``, never as one array
that could grow with the session.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from turnledger import constants as K
from turnledger.functions import pricing
from turnledger.functions.money import units_sum, usd
from turnledger.functions.ratios import context_tokens
from turnledger.operators import ordered
from turnledger.session import stored

_KEY = ["session_id"]
_ORDER = ["ts", "file", "line"]
_LOOK = 5

# Advice given with each finding.
ADVICE = {
    "idle_expiry": "Start a fresh session after breaks longer than {hours}h — the 5-minute default prompt-cache TTL has long expired.",
    "compaction_reinflation": "If the sub-tasks are unrelated, /clear + fresh session avoids paying to re-summarise the old context.",
    "context_ceiling_plateau": "Split the work across sessions; there's no way to economise once you're pinned to the ceiling.",
    "sidechain_explosion": "Review the task-agent prompts — they did most of the spending. Consider scoping them tighter.",
    "tool_error_storm": "Check which tool is failing — a single bad tool in a loop can dominate cost.",
}


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with their position in the session and the context they see."""
    placed = turns.withColumn("chunk", ordered.time_chunk())
    return (
        ordered.with_position(placed, _KEY, _ORDER, "chunk", "turn_idx")
        .withColumn("ctx", context_tokens())
        .drop("chunk")
    )


def _limits(overrides: dict | None) -> dict:
    return {**K.THRESHOLDS, **(overrides or {})}


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _whole(value: Column) -> Column:
    """Half-even rounding to a whole number, as text."""
    return F.bround(value, 0).cast("bigint").cast("string")


def _hit(kind: str, severity: Column, first: Column, last: Column, count: Column, headline: Column, reason: Column, **words):
    return [
        "session_id",
        F.lit(kind).alias("kind"),
        severity.alias("severity"),
        first.cast("bigint").alias("first_turn"),
        last.cast("bigint").alias("last_turn"),
        count.cast("bigint").alias("n_turns"),
        headline.alias("headline"),
        reason.alias("reason"),
        F.lit(ADVICE[kind].format(**words)).alias("suggested_fix"),
    ]


def idle_expiry(turns: DataFrame, overrides: dict | None = None) -> DataFrame:
    """The prompt cache was rebuilt after a long gap; red from three such gaps in a session."""
    t = _limits(overrides)
    blocked, window = ordered.neighbourhoods(turns, _KEY, "turn_idx", 1, 0)
    gaps = (
        blocked.withColumn("gap", (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(window))) / F.lit(1e6))
        .filter("core")
        .withColumn("rebuilt", F.when(F.col("ctx") > 0, F.col("cache_creation_tokens") / F.col("ctx")))
        .filter(
            (F.col("gap") >= t["idle_expiry_gap_seconds"]) & (F.col("rebuilt") > t["idle_expiry_creation_ratio"])
        )
        .select("session_id", "turn_idx", "gap", "rebuilt")
    )
    counts = gaps.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("hits"))
    hours = F.bround(F.col("gap") / 3600, 1)
    at = F.col("turn_idx")
    return gaps.join(counts, "session_id").select(
        *_hit(
            "idle_expiry",
            F.when(F.col("hits") >= 3, "red").otherwise("amber"),
            at,
            at,
            F.lit(1),
            _say("Prompt cache expired during a ", hours.cast("string"), "h idle gap before turn ", at.cast("string"), "."),
            _say("Next turn was ", _whole(F.col("rebuilt") * 100), "% cache_creation."),
            hours=round(t["idle_expiry_gap_seconds"] / 3600, 1),
        )
    )


def reinflation_cycles(turns: DataFrame, overrides: dict | None = None, size: int = 4096) -> DataFrame:
    """Cycles peak -> compacted -> back at the peak, non-overlapping: (session_id, first, low, last)."""
    t = _limits(overrides)
    blocked, window = ordered.neighbourhoods(turns.select("session_id", "turn_idx", "ctx"), _KEY, "turn_idx", 0, 2 * _LOOK, size)
    ahead = F.collect_list("ctx").over(window.rowsBetween(1, 2 * _LOOK))
    low_at = F.array_position(
        F.transform(F.slice("ahead", 1, _LOOK), lambda v: v <= (1 - t["compaction_drop_ratio"]) * F.col("ctx")), F.lit(True)
    )
    back_at = F.array_position(
        F.transform(
            F.slice("ahead", F.col("drop") + 1, F.lit(_LOOK)), lambda v: v >= t["compaction_reinflate_ratio"] * F.col("ctx")
        ),
        F.lit(True),
    )
    found = (
        blocked.withColumn("ahead", ahead)
        .filter(F.col("core") & (F.col("ctx") > 0))
        .withColumn("drop", low_at.cast("int"))
        .filter("drop > 0")
        .withColumn("rise", back_at)
        .filter("rise > 0")
        .select(
            "session_id",
            F.col("turn_idx").alias("first"),
            (F.col("turn_idx") + F.col("drop")).alias("low"),
            (F.col("turn_idx") + F.col("drop") + F.col("rise")).alias("last"),
        )
    )
    return ordered.pick_disjoint(found, _KEY, 2 * _LOOK, size)


def compaction_reinflation(turns: DataFrame, overrides: dict | None = None) -> DataFrame:
    t = _limits(overrides)
    cycles = reinflation_cycles(turns, overrides).groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("cycles"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    return cycles.select(
        *_hit(
            "compaction_reinflation",
            F.when(F.col("cycles") >= int(t["compaction_red_cycles"]), "red").otherwise("amber"),
            F.col("first"),
            F.col("last"),
            F.col("cycles") * 3,
            _say("Context was compacted ", F.col("cycles").cast("string"), " time(s) and re-inflated to the ceiling."),
            F.lit(
                "Each compaction was followed by tokens climbing back to "
                f"≥{round(t['compaction_reinflate_ratio'] * 100)}% of the previous peak."
            ),
        )
    )


def ceiling_plateau(turns: DataFrame, overrides: dict | None = None) -> DataFrame:
    """Longest run of turns near the context window; the first one among equals."""
    t = _limits(overrides)
    need = int(t["context_plateau_min_turns"])
    room = F.coalesce(pricing.context_window(F.col("model")), F.lit(K.DEFAULT_CONTEXT))
    marked = turns.select(
        "session_id", "turn_idx", (F.col("ctx") >= t["context_plateau_fraction"] * room).alias("high")
    ).withColumn("chunk", F.floor(F.col("turn_idx") / 65536))
    # Within a run, position minus the number of earlier high turns is constant.
    counted = ordered.scan(marked, _KEY, ["turn_idx"], "chunk", {"before": ("sum", F.col("high").cast("int"))})
    runs = (
        counted.filter("high")
        .groupBy("session_id", (F.col("turn_idx") - F.col("before")).alias("run"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("turn_idx").alias("first"))
        .groupBy(*_KEY)
        .agg(F.max_by(F.struct("n", "first"), F.struct("n", -F.col("first"))).alias("best"))
        .select("session_id", "best.*")
        .filter(F.col("n") >= need)
    )
    return runs.select(
        *_hit(
            "context_ceiling_plateau",
            F.when(F.col("n") >= need * 2, "red").otherwise("amber"),
            F.col("first"),
            F.col("first") + F.col("n") - 1,
            F.col("n"),
            _say(
                f"Session ran at ≥{round(t['context_plateau_fraction'] * 100)}% of the model's context window for ",
                F.col("n").cast("string"), " turns.",
            ),
            F.lit("Each of those turns paid near-full-context input rates."),
        )
    )


def sidechain_explosion(turns: DataFrame, overrides: dict | None = None) -> DataFrame:
    limit = _limits(overrides)["sidechain_explosion_cost_share"]
    side = F.col("is_sidechain")
    sums = (
        turns.groupBy(*_KEY)
        .agg(
            units_sum(F.col("cost_units")).alias("total"),
            F.coalesce(F.sum(F.when(side, F.col("cost_units"))), F.lit(0)).alias("side"),
            F.count_if(side).alias("n"),
            F.min(F.when(side, F.col("turn_idx"))).alias("first"),
            F.max(F.when(side, F.col("turn_idx"))).alias("last"),
        )
        .filter("total > 0")
        .withColumn("share", F.col("side") / F.col("total"))
        .filter(F.col("share") > limit)
    )
    return sums.select(
        *_hit(
            "sidechain_explosion",
            F.when(F.col("share") >= 0.6, "red").otherwise("amber"),
            F.col("first"),
            F.col("last"),
            F.col("n"),
            _say("Sidechain/task-agent work accounted for ", _whole(F.col("share") * 100), "% of this session's cost."),
            _say(
                "$", F.format_string("%.2f", usd(F.col("side"))), " of $", F.format_string("%.2f", usd(F.col("total"))),
                " billed was sidechain.",
            ),
        )
    )


def tool_error_storm(turns: DataFrame, overrides: dict | None = None, size: int = 4096) -> DataFrame:
    """Non-overlapping frames of turns whose tool calls fail too often."""
    t = _limits(overrides)
    width, limit = int(t["tool_error_storm_window"]), t["tool_error_storm_rate"]
    blocked, window = ordered.neighbourhoods(
        turns.select("session_id", "turn_idx", "tool_use_count", "tool_error_count"), _KEY, "turn_idx", 0, width - 1, size
    )
    frame = window.rowsBetween(0, width - 1)
    spans = (
        blocked.withColumn("uses", F.sum("tool_use_count").over(frame))
        .withColumn("errors", F.sum("tool_error_count").over(frame))
        .withColumn("rows", F.count(F.lit(1)).over(frame))
        .filter(F.col("core") & (F.col("rows") == width) & (F.col("uses") > 0))
        .filter(F.col("errors") / F.col("uses") > limit)
        .select(
            "session_id", F.col("turn_idx").alias("first"), (F.col("turn_idx") + width - 1).alias("last"), "uses", "errors"
        )
    )
    rate = F.col("errors") / F.col("uses")
    return ordered.pick_disjoint(spans, _KEY, width - 1, size).select(
        *_hit(
            "tool_error_storm",
            F.when(rate > 0.5, "red").otherwise("amber"),
            F.col("first"),
            F.col("last"),
            F.lit(width),
            _say(
                "Tool errors spiked in turns ", F.col("first").cast("string"), "–", F.col("last").cast("string"), " (",
                _whole(rate * 100), "% error rate).",
            ),
            _say(F.col("errors").cast("string"), " errors across ", F.col("uses").cast("string"), " tool uses."),
        )
    )


def _kept(turns: DataFrame) -> DataFrame:
    """The detectors' columns, numbered once for all of them."""
    return stored(
        turns.select(
            "session_id", "turn_idx", "ts", "model", "ctx", "cache_creation_tokens", "cost_units", "is_sidechain",
            "tool_use_count", "tool_error_count",
        ),
        "numbered",
    )


def detect_patterns(turns: DataFrame, overrides: dict | None = None) -> DataFrame:
    """All five detectors over numbered turns, with optional threshold overrides."""
    turns = _kept(turns)
    detectors = (idle_expiry, compaction_reinflation, ceiling_plateau, sidechain_explosion, tool_error_storm)
    return reduce(DataFrame.unionByName, [d(turns, overrides) for d in detectors])


def pattern_turns(turns: DataFrame, overrides: dict | None = None) -> DataFrame:
    """The turns behind the findings: (session_id, kind, turn_idx)."""
    turns = _kept(turns)
    cycles = reinflation_cycles(turns, overrides).select(
        "session_id", F.lit("compaction_reinflation").alias("kind"), F.explode(F.array("first", "low", "last")).alias("turn_idx")
    )
    bounded = idle_expiry(turns, overrides).unionByName(tool_error_storm(turns, overrides)).select(
        "session_id", "kind", F.explode(F.sequence("first_turn", "last_turn")).alias("turn_idx")
    )
    side = turns.filter("is_sidechain").join(sidechain_explosion(turns, overrides).select("session_id"), "session_id", "left_semi")
    plateau = ceiling_plateau(turns, overrides).select("session_id", "first_turn", "last_turn")
    high = turns.join(plateau, "session_id").filter("turn_idx between first_turn and last_turn")
    return (
        cycles.unionByName(bounded)
        .unionByName(side.select("session_id", F.lit("sidechain_explosion").alias("kind"), "turn_idx"))
        .unionByName(high.select("session_id", F.lit("context_ceiling_plateau").alias("kind"), "turn_idx"))
        .distinct()
    )
