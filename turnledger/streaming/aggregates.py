"""Continuous rollups over turns, each counted once.

A micro-batch first becomes turns: the last row of a key inside the batch, minus
the keys of earlier batches, which are looked up in hash buckets. Those turns are
stored, and what they add to hours, windows or sessions is stored as one part per
group and batch. Parts are merged by age, so a report opens few folders and sums
them. Nothing falls out of a watermark: late rows count in their own hour and are
listed apart. Writing a batch again overwrites what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from turnledger.functions.money import usd_sum
from turnledger.operators import dedup, windows5h
from turnledger.operators.series import SUMS
from turnledger.session import stored
from turnledger.streaming import ingest
from turnledger.streaming.parts import Parts

LATENESS = "1 day"


def once(path: str, each: Callable[[DataFrame, int], None] | None = None, lateness: str = LATENESS) -> Callable[[DataFrame, int], None]:
    """Batch function: store the new turns of a batch of priced responses, list its late rows, hand the turns on.

    Of earlier batches it reads the key buckets that its own keys fall in, and one row with the latest time so far.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keys = Parts(spark, f"{path}/keys", "turn_key string", by="turn_key")
        key = dedup.passthrough_key(F.col("dedup_key"), F.col("uuid"), F.col("file"), F.col("line"))
        latest = dedup.keep_last(batch.withColumn("turn_key", key), "turn_key", dedup.PLACE)
        if batch_id:
            latest = stored(latest, "batch")
            latest = latest.join(keys.read(before=batch_id, near=latest.select("turn_key")), "turn_key", "left_anti")
        ingest.append_updates(f"{path}/turns")(latest, batch_id)
        turns = spark.read.parquet(f"{path}/turns/batch={batch_id}")
        newest = turns.agg(F.max("ts").alias("ts"))
        if batch_id:
            before = spark.read.schema("ts timestamp").parquet(f"{path}/newest/batch={batch_id - 1}")
            horizon = before.select((F.col("ts") - F.expr(f"interval {lateness}")).alias("horizon"))
            late = ingest.split_late(turns.crossJoin(F.broadcast(horizon)), F.col("horizon"))[1]  # one row of horizon
            ingest.append_updates(f"{path}/late")(late.drop("horizon"), batch_id)
            newest = newest.union(before).agg(F.max("ts").alias("ts"))
        ingest.append_updates(f"{path}/newest")(newest, batch_id)
        keys.add(turns, batch_id)
        if each is not None:
            each(turns, batch_id)

    return run


def keep(path: str, group: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Batch function for ``once``: what the turns of a batch add to the groups; ``merge`` adds the parts of one group together."""

    def run(turns: DataFrame, batch_id: int) -> None:
        Parts(turns.sparkSession, path, fold=merge).add(group(turns), batch_id)

    return run


def parts_of(spark, path: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One part per group over all batches."""
    return Parts(spark, path, fold=merge).read()


def added(*by: str, lowest: tuple[str, ...] = (), highest: tuple[str, ...] = ()) -> Callable[[DataFrame], DataFrame]:
    """The merge of parts per group: sums, but for the columns of which the least or the greatest counts."""

    def merge(parts: DataFrame) -> DataFrame:
        how = {**dict.fromkeys(lowest, F.min), **dict.fromkeys(highest, F.max)}
        return parts.groupBy(*by).agg(*[how.get(c, F.sum)(c).alias(c) for c in parts.columns if c not in by])

    return merge


by_hour = added("hour")
by_window = added("window_start", "project")
by_session = added("session_id", lowest=("first_ts",), highest=("last_ts",))


def by_key_and_hour(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """The merge of ``window_parts``: hours are summed, interrupted turns stay rows."""
    hourly = added(*keys, "hour", lowest=("first",))

    def merge(parts: DataFrame) -> DataFrame:
        sums = hourly(parts.filter("stopped is null").drop("stopped"))
        return sums.unionByName(parts.filter("stopped is not null"), allowMissingColumns=True).select(*parts.columns)

    return merge


def turns_of(spark, path: str) -> DataFrame:
    return ingest.read_updates(spark, f"{path}/turns")


def late_rows(spark, path: str) -> DataFrame:
    return ingest.read_updates(spark, f"{path}/late")


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("turns"), F.count_if("is_interrupted").alias("interrupted_turns"), *[F.sum(c).alias(c) for c in SUMS], F.sum("cost_units").alias("units")]


def hour_parts(turns: DataFrame) -> DataFrame:
    return turns.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(*_sums())


def hours(parts: DataFrame) -> DataFrame:
    """Tumbling hours from the parts of all batches."""
    counted = [F.sum(c).alias(c) for c in ("turns", "interrupted_turns", *SUMS)]
    return parts.groupBy("hour").agg(*counted, usd_sum(F.col("units")).alias("cost_usd"))


def sliding_parts(turns: DataFrame, key: str = "cwd", slide: str = "5 minutes") -> DataFrame:
    """The hours that begin every ``slide`` per project, as one batch adds to them."""
    project = F.coalesce(F.col(key), F.lit("(unknown)")).alias("project")
    return turns.groupBy(F.window("ts", "60 minutes", slide).alias("w"), project).agg(*_sums()).select(F.col("w.start").alias("window_start"), "project", "turns", "output_tokens", "units")


def sliding_hours(parts: DataFrame) -> DataFrame:
    return parts.groupBy("window_start", "project").agg(F.sum("turns").alias("turns"), F.sum("output_tokens").alias("output_tokens"), usd_sum(F.col("units")).alias("cost_usd"))


def session_parts(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("turns"), F.sum("cost_units").alias("units"))


def sessions(parts: DataFrame) -> DataFrame:
    """Live state per session: first and last turn, count, cost."""
    return parts.groupBy("session_id").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("turns").alias("turns"), usd_sum(F.col("units")).alias("cost_usd"))


def window_parts(turns: DataFrame, keys: list[str]) -> DataFrame:
    """What one batch adds to the hours of each key, and one row for each interrupted turn."""
    by_hour = windows5h.hours_of(turns, keys).drop("late").withColumn("stopped", F.lit(None).cast("struct<ts:timestamp,file:string,line:bigint>"))
    hour = windows5h.hour_number()
    stopped = turns.filter("is_interrupted").select(*keys, hour.alias("hour"), F.struct("ts", "file", "line").alias("stopped"))
    return by_hour.unionByName(stopped, allowMissingColumns=True)


def open_windows(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Anchored windows from the parts of all batches.

    Parts are summed per (key, hour): a key costs as many rows as it has active
    hours. Interrupted turns of the hour that opens a window count from its first
    billed turn on, whichever batch brought it.
    """
    by = [*keys, "hour"]
    hourly = parts.filter("stopped is null").groupBy(*by).agg(
        F.sum("billed").alias("billed"), F.sum("units").alias("units"), F.sum("tokens").alias("tokens"), F.sum("interrupted").alias("interrupted"), F.min("first").alias("first"),
    )
    late = parts.filter("stopped is not null").select(*by, "stopped").join(hourly.select(*by, "first"), by).filter("stopped > first").groupBy(*by).agg(F.count(F.lit(1)).alias("late"))
    return windows5h.windows_of(hourly.join(late, by, "left").withColumn("late", F.coalesce("late", F.lit(0))), keys)
