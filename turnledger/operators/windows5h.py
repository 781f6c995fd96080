"""Five-hour windows anchored at the hour of their first billed turn, and the burn rate.

Starts fall on whole hours and windows last whole hours, so membership depends
on the hour alone: turns are summed per (key, hour) first, and only the hours
of a key (bounded by the calendar, not by the data) are walked in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnledger.constants import USD_UNITS, WINDOW_HOURS
from turnledger.functions.ratios import context_tokens
from turnledger.operators import topk

_PLACE = ("ts", "file", "line")


def hour_number() -> Column:
    return F.floor(F.unix_timestamp("ts") / 3600)


def hours_of(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Per (key, hour): billed sums, first billed turn, interrupted turns in all and after that first one."""
    by = [*keys, "hour"]
    placed = turns.withColumn("hour", hour_number())
    billed = ~F.col("is_interrupted")
    sums = placed.groupBy(*by).agg(
        F.count_if(billed).alias("billed"),
        F.sum("cost_units").alias("units"),
        F.sum(context_tokens()).alias("tokens"),
        F.count_if(F.col("is_interrupted")).alias("interrupted"),
        F.min(F.when(billed, F.struct(*_PLACE))).alias("first"),
    )
    opened = sums.filter("billed > 0 and interrupted > 0").select(*by, F.col("first").alias("opening"))
    late = (
        placed.filter("is_interrupted")
        .join(opened, by)
        .filter(F.struct(*_PLACE) > F.col("opening"))
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("late"))
    )
    return sums.join(late, by, "left").withColumn("late", F.coalesce("late", F.lit(0)))


_WINDOW = "struct<start:bigint,units:bigint,tokens:bigint,turns:bigint,first:struct<ts:timestamp,file:string,line:bigint>>"


def windows_of(hours: DataFrame, keys: list[str]) -> DataFrame:
    """One row per window from hourly rows (columns of ``hours_of``)."""
    item = F.struct("hour", "billed", "units", "tokens", "interrupted", "late", "first")
    opens = f"(h.billed > 0 and (acc.open is null or h.hour >= acc.open.start + {WINDOW_HOURS}))"
    inside = f"(acc.open is not null and h.hour < acc.open.start + {WINDOW_HOURS})"
    closed = "if(acc.open is null, acc.done, array_append(acc.done, acc.open))"
    fresh = (
        "named_struct('start', h.hour, 'units', h.units, 'tokens', h.tokens, 'turns', h.billed + h.late, 'first', h.first)"
    )
    grown = (
        "named_struct('start', acc.open.start, 'units', acc.open.units + h.units, 'tokens', acc.open.tokens + h.tokens, "
        "'turns', acc.open.turns + h.billed + h.interrupted, 'first', acc.open.first)"
    )
    start = f"named_struct('open', cast(null as {_WINDOW}), 'done', cast(array() as array<{_WINDOW}>))"
    fold = (
        f"aggregate(hours, {start}, (acc, h) -> if({opens}, named_struct('open', {fresh}, 'done', {closed}), "
        f"if({inside}, named_struct('open', {grown}, 'done', acc.done), acc)), acc -> {closed})"
    )
    per_key = hours.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("hours"))
    # sort_array orders by hour, the first field, which is unique per key
    return (
        per_key.select(*keys, F.explode(F.expr(fold)).alias("w"))
        .select(
            *keys,
            F.timestamp_seconds(F.col("w.start") * 3600).alias("window_start"),
            F.timestamp_seconds((F.col("w.start") + WINDOW_HOURS) * 3600).alias("window_end"),
            F.col("w.turns").alias("turns"),
            F.col("w.tokens").alias("total_tokens"),
            (F.col("w.units") / float(USD_UNITS)).alias("cost_usd"),
            F.col("w.first").alias("first_billed"),
        )
    )


def anchored_windows(turns: DataFrame, keys: list[str]) -> DataFrame:
    return windows_of(hours_of(turns, keys), keys)


def peak_window_cost(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Costliest window per key; interrupted turns cost nothing and are left out early."""
    by = [*keys, "hour"]
    hours = (
        turns.filter(~F.col("is_interrupted"))
        .withColumn("hour", hour_number())
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("billed"), F.sum("cost_units").alias("units"))
        .withColumns({"tokens": F.lit(0).cast("bigint"), "interrupted": F.lit(0).cast("bigint"), "late": F.lit(0).cast("bigint")})
        .withColumn("first", F.lit(None).cast("struct<ts:timestamp,file:string,line:bigint>"))
    )
    return windows_of(hours, keys).groupBy(*keys).agg(F.max("cost_usd").alias("peak_window_cost"))


def burn_projection(turns: DataFrame, as_of: str, lookback_minutes: int, scope_hours: int = 10) -> DataFrame:
    """Projection of the window open at ``as_of``; no row when none is open."""
    now = F.lit(as_of).cast("timestamp")
    recent = turns.filter(
        (F.col("ts") >= now - F.expr(f"interval {scope_hours} hours")) & (F.col("ts") <= now)
    ).withColumn("scope", F.lit("all"))
    latest = (
        anchored_windows(recent, ["scope"])
        .groupBy("scope")
        .agg(F.max_by(F.struct("window_start", "window_end", "cost_usd", "first_billed"), "window_start").alias("w"))
        .select("scope", "w.*")
        .filter(F.col("window_end") >= now)
    )
    attached = ~F.col("is_interrupted") | (F.struct(*_PLACE) > F.col("first_billed"))
    cutoff = now - F.expr(f"interval {lookback_minutes} minutes")
    start_hour = F.floor(F.unix_timestamp("window_start") / 3600)
    # The open window is one row, so its hours are at most WINDOW_HOURS rows.
    open_hours = latest.select("first_billed", F.explode(F.sequence(start_hour, start_hour + WINDOW_HOURS - 1)).alias("hour"))
    late = (
        recent.filter(F.col("ts") >= cutoff)
        .withColumn("hour", hour_number())
        .join(F.broadcast(open_hours), "hour")
        .filter(attached)
        .agg(F.sum("cost_units").alias("units"), F.count(F.lit(1)).alias("recent_turns"))
    )
    hours = lookback_minutes / 60
    left = F.greatest(F.unix_micros("window_end") - F.unix_micros(now), F.lit(0)) / F.lit(3.6e9)
    rate = F.col("recent_cost") / hours if hours > 0 else F.lit(0.0)
    return (
        topk.beside(latest.drop("scope", "first_billed"), late)
        .filter("window_start is not null")
        .withColumn("recent_cost", F.coalesce("units", F.lit(0)) / float(USD_UNITS))
        .withColumn("recent_turns", F.coalesce("recent_turns", F.lit(0)))
        .withColumn("burn_rate_usd_per_hour", rate)
        .withColumn("elapsed_hours", (F.unix_micros(now) - F.unix_micros("window_start")) / F.lit(3.6e9))
        .withColumn("remaining_hours", left)
        .withColumn("projected_cost", F.col("cost_usd") + F.col("burn_rate_usd_per_hour") * F.col("remaining_hours"))
        .withColumn("over_reference", F.col("projected_cost") > 50.0)
        .drop("units")
    )
