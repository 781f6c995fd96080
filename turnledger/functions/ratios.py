"""Ratios, colours, verdicts. Every ratio is NULL on a zero denominator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnledger import constants as K


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def context_tokens(prefix: str = "") -> Column:
    """Everything the model reads: plain input, cache reads, cache writes."""
    return F.col(prefix + "input_tokens") + F.col(prefix + "cache_read_tokens") + F.col(prefix + "cache_creation_tokens")


def hit_rate(read: Column, creation: Column, inp: Column) -> Column:
    return ratio(read, read + creation + inp)


def hit_pct(read: Column, creation: Column, inp: Column) -> Column:
    return hit_rate(read, creation, inp) * 100


def reuse_share(read: Column, creation: Column) -> Column:
    return ratio(read, read + creation)


def plain_input_share(inp: Column, context: Column) -> Column:
    return ratio(inp, context)


def cost_per_kw(cost: Column, out: Column) -> Column:
    return F.when(out > 0, cost * 1000.0 / out)


def efficiency(cost: str = "cost_usd") -> dict[str, Column]:
    """The four headline ratios from rolled-up token columns."""
    read, creation = F.col("cache_read_tokens"), F.col("cache_creation_tokens")
    inp, out = F.col("input_tokens"), F.col("output_tokens")
    return {
        "hit_pct": hit_pct(read, creation, inp),
        "cost_per_kw": cost_per_kw(F.col(cost), out),
        "ctx_ratio": ratio(read, out),
        "cache_reuse": ratio(read, creation),
    }


def exact_slope(x: Column, y: Column) -> Column:
    """Least-squares slope of whole numbers from exact sums; 0 for fewer than two points.

    Exact sums do not depend on row order, and a flat series gives exactly 0.
    """
    both = x.isNotNull() & y.isNotNull()

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(both, value).cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)")

    n = F.count_if(both).cast("decimal(19,0)")
    num = (n * total(x * y)).cast("decimal(38,0)") - (total(x) * total(y)).cast("decimal(38,0)")
    den = (n * total(x * x)).cast("decimal(38,0)") - (total(x) * total(x)).cast("decimal(38,0)")
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def metric(name: str) -> Column:
    """One plottable metric of a rolled-up row."""
    if name == "output":
        return F.col("output_tokens").cast("double")
    if name in efficiency():
        return efficiency()[name]
    return F.col("cost_usd")


# Unit label of each metric.
METRIC_UNITS = {
    "hit_pct": "percent",
    "cost_per_kw": "usd",
    "ctx_ratio": "ratio",
    "cache_reuse": "ratio",
    "output": "tokens",
    "cost": "usd",
}


def _limits(overrides: dict | None) -> dict:
    return {**K.THRESHOLDS, **(overrides or {})}


def colour_hit_pct(value: Column, overrides: dict | None = None) -> Column:
    t = _limits(overrides)
    return (
        F.when(value >= t["hit_rate_good_pct"], "good").when(value >= t["hit_rate_red_pct"], "amber")
        .when(value.isNotNull(), "red")
    )


def colour_cost_per_kw(value: Column, overrides: dict | None = None) -> Column:
    t = _limits(overrides)
    return (
        F.when(value <= t["cost_per_kw_good"], "good").when(value <= t["cost_per_kw_red"], "amber")
        .when(value.isNotNull(), "red")
    )


def colour_ctx_ratio(value: Column, overrides: dict | None = None) -> Column:
    red = _limits(overrides)["ctx_ratio_red"]
    return F.when(value >= red, "red").when(value >= red * 0.5, "amber").when(value.isNotNull(), "good")


def colour_cache_reuse(value: Column, overrides: dict | None = None) -> Column:
    t = _limits(overrides)
    return (
        F.when(value >= t["cache_reuse_good"], "good").when(value >= t["cache_reuse_red"], "amber")
        .when(value.isNotNull(), "red")
    )


def verdict(limits: dict | None = None) -> Column:
    """First matching blow-up verdict of a session rollup row."""
    t = {**K.VERDICT_LIMITS, **(limits or {})}
    uses, errors = F.col("tool_use_count"), F.col("tool_error_count")
    return (
        F.when(F.col("peak_window_cost") > t["window_usd"], K.RUNAWAY_WINDOW)
        .when(
            (F.col("max_turn_input") > t["creep_input"]) & (F.col("context_growth") > t["creep_slope"]),
            K.CONTEXT_CREEP,
        )
        .when((uses >= t["storm_uses"]) & (ratio(errors, uses) > t["storm_rate"]), K.TOOL_ERROR_STORM)
        .when(F.col("is_sidechain") & (F.col("cost_usd") > t["sidechain_usd"]), K.SIDECHAIN_HEAVY)
        .otherwise(K.OK)
    )


def delta_badge(value: Column, lower_is_better: bool = False) -> Column:
    """Change against a baseline ratio as struct(pct, class); NULL when it rounds to zero."""
    pct = F.floor((value - 1) * 100 + 0.5).cast("int")
    if lower_is_better:
        css = F.when(pct < 0, "delta-down-good").when(value >= 1.5, "delta-up-red").otherwise("delta-up-amber")
    else:
        css = F.when(pct > 0, "delta-down-good").when(value <= 0.75, "delta-up-red").otherwise("delta-up-amber")
    return F.when(pct != 0, F.struct(pct.alias("pct"), css.alias("class")))


def growth_class(slope: Column) -> Column:
    return F.when(slope > 5000, "alarm").when(slope > 2000, "amber").otherwise("mute")


def growth_bucket(slope: Column) -> Column:
    """Index 0..5 of the slope histogram; an edge value belongs to the bucket it opens."""
    out = None
    for position, edge in enumerate(K.GROWTH_EDGES):
        out = F.when(slope < edge, position) if out is None else out.when(slope < edge, position)
    return out.otherwise(len(K.GROWTH_EDGES))
