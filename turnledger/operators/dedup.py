"""From logged responses to turns and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnledger import constants as K

PLACE = ["file", "line"]


def _one(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row of each key in the given order; rows without a key count as keys of their own.

    One pass over the input and one exchange. Spark limits each task's rows to
    the first of a key before the exchange, so a key that holds a third of the
    rows reaches its reducer as one row per task; unused columns stay unread.
    """
    alone = F.when(F.col(key).isNull(), F.concat_ws("#", *PLACE))
    first = Window.partitionBy(key, alone).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") == 1).drop("_nth")


def keep_last(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last row per non-NULL key; rows without a key all stay."""
    return _one(df, key, [F.desc(c) for c in order])


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per non-NULL key (the rule of incremental appends)."""
    return _one(df, key, [F.asc(c) for c in order])


def passthrough_key(key: Column, uuid: Column, file: Column, line: Column) -> Column:
    """Key of a turn: its dedup key, else its uuid, else its place in the logs."""
    return F.coalesce(key, F.nullif(uuid, F.lit("")), F.concat(file, F.lit("#"), line.cast("string")))


def new_rows(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates that history does not hold: by dedup key, and by place where there is no key."""
    keyed = candidates.filter(F.col("dedup_key").isNotNull())
    keyless = candidates.filter(F.col("dedup_key").isNull())
    old_keys = known.filter(F.col("dedup_key").isNotNull()).select("dedup_key").distinct()
    old_places = known.filter(F.col("dedup_key").isNull()).select(*PLACE).distinct()
    return keyed.join(old_keys, "dedup_key", "left_anti").unionByName(
        keyless.join(old_places, PLACE, "left_anti").select(*keyed.columns)
    )


def session_dimension(events: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per session with turns: first working directory and file seen, flag of the first turn.

    A turn comes where the first copy of its key stands; turns without a key come before all others.
    """
    place = F.struct(*PLACE)
    key = F.col("dedup_key") if "dedup_key" in events.columns else F.concat("message_id", F.lit(":"), "request_id")
    copies = events.filter(~F.col("model").eqNullSafe(K.SYNTHETIC_MODEL)).select(key.alias("dedup_key"), place.alias("place")).filter("dedup_key is not null")
    turns = turns.join(copies.groupBy("dedup_key").agg(F.min("place").alias("first_place")), "dedup_key", "left")
    seen = events.groupBy("session_id").agg(
        F.min_by("file", place).alias("source_file"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), place)).alias("cwd"),
    )
    order = F.struct(F.col("dedup_key").isNotNull(), F.coalesce("first_place", place), place)
    flags = turns.groupBy("session_id").agg(
        F.min_by("is_sidechain", order).alias("is_sidechain"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("turns"),
    )
    return flags.join(seen, "session_id", "left")


def assumption_tags(dedup_key: Column, interrupted: Column, price_tag: Column) -> Column:
    """Distinct assumption tags of a turn, in the order they arise."""
    return F.array_compact(
        F.array(
            F.when(dedup_key.isNull(), F.lit(K.TAG_PASSTHROUGH)),
            F.when(interrupted, F.lit(K.TAG_INTERRUPTED)),
            price_tag,
        )
    )
