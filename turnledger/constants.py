"""Fixed values whose content decides results: names, sentinels, thresholds."""

from __future__ import annotations

# Sentinels of the tool and skill dimensions.
UNATTRIBUTED_TOOL = "__unattributed__"
UNKNOWN_TOOL = "__unknown__"
SKILL_TOOL = "Skill"
OTHER = "other"
UNKNOWN = "(unknown)"
NO_PROJECT = "—"
SYNTHETIC_MODEL = "<synthetic>"
EMPTY_LABEL = "–"

# Assumption tags.
TAG_FALLBACK = "UNKNOWN_MODEL_FALLBACK"
TAG_PASSTHROUGH = "DEDUP_PASSTHROUGH"
TAG_INTERRUPTED = "INTERRUPTED_TURN_SKIPPED"
TAG_UNPRICED = "GEMINI_UNPRICED"
TAG_WINDOW = "WINDOW_BOUNDARY_HEURISTIC"
TAGS = (TAG_WINDOW, TAG_FALLBACK, TAG_PASSTHROUGH, TAG_INTERRUPTED, TAG_UNPRICED)

# Session verdicts.
RUNAWAY_WINDOW = "RUNAWAY_WINDOW"
CONTEXT_CREEP = "CONTEXT_CREEP"
TOOL_ERROR_STORM = "TOOL_ERROR_STORM"
SIDECHAIN_HEAVY = "SIDECHAIN_HEAVY"
OK = "OK"
VERDICTS = (RUNAWAY_WINDOW, CONTEXT_CREEP, TOOL_ERROR_STORM, SIDECHAIN_HEAVY, OK)

# Limits behind the verdicts.
VERDICT_LIMITS = {
    "window_usd": 50.0,
    "creep_input": 500_000,
    "creep_slope": 2000.0,
    "storm_uses": 10,
    "storm_rate": 0.3,
    "sidechain_usd": 5.0,
}

# Colour and detector thresholds (overridable per call).
THRESHOLDS = {
    "hit_rate_good_pct": 95.0,
    "hit_rate_red_pct": 85.0,
    "cost_per_kw_good": 0.20,
    "cost_per_kw_red": 0.40,
    "ctx_ratio_red": 400.0,
    "cache_reuse_good": 50.0,
    "cache_reuse_red": 20.0,
    "idle_expiry_gap_seconds": 3600,
    "idle_expiry_creation_ratio": 0.8,
    "compaction_drop_ratio": 0.8,
    "compaction_reinflate_ratio": 0.8,
    "compaction_red_cycles": 3,
    "context_plateau_fraction": 0.9,
    "context_plateau_min_turns": 20,
    "sidechain_explosion_cost_share": 0.4,
    "tool_error_storm_window": 10,
    "tool_error_storm_rate": 0.2,
}

# Cut-offs that flag a project.
PROJECT_FLAGS = {"hit_rate": 0.25, "creation_dominance": 1.0, "growth": 2000.0, "error_rate": 0.10}

# Shares of the usual value beyond which a tile is an anomaly.
ANOMALY = {"cache_reuse": 0.4, "hit_pct": 0.88, "cost_per_kw": 2.5}

# Slope histogram.
GROWTH_EDGES = (500, 1000, 2000, 5000, 10000)
GROWTH_LABELS = ("<500", "500-1k", "1k-2k", "2k-5k", "5k-10k", "10k+")

# A later turn starts a new context epoch when its input pool times this factor
# is still below the running peak (a drop of more than 80 percent).
COMPACTION_FACTOR = 5

WINDOW_HOURS = 5
DEFAULT_CONTEXT = 200_000
USD_UNITS = 10**10  # money is counted in whole 1e-10 USD
