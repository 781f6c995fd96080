"""From landed log files to the history, batch by batch and exactly once by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from turnledger.operators import dedup
from turnledger.plans import turns as turn_plan
from turnledger.sources import logs
from turnledger.session import stored
from turnledger.sources.history import History, with_slices
from turnledger.streaming import tallies

DELETE_SCHEMA = "session_id string, cwd string, older_than timestamp"


def run_available(rows: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything that has landed, then stop."""
    start(rows, checkpoint, each, mode, available=True).awaitTermination()


def start(
    rows: DataFrame,
    checkpoint: str,
    each: Callable[[DataFrame, int], None],
    mode: str = "append",
    interval: str = "5 seconds",
    available: bool = False,
) -> StreamingQuery:
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available else writer.trigger(processingTime=interval)).start()


def into_history(history: History, requests: str | None = None) -> Callable[[DataFrame, int], None]:
    """Batch function: apply waiting deletions, then append the new turns of a batch of raw lines.

    Inside a batch the last row of a key wins, against history the first one
    does. A batch that runs again after a failure finds its keys present. Turns
    are stored with the costs of their tools, split from the batch's lines and
    the saved state of their files.
    """
    states = tallies.states(history.spark, f"{history.root}/tallies")

    def each(batch: DataFrame, batch_id: int) -> None:
        if requests is not None:
            apply_requests(history, requests)
        lines = logs.with_place(batch).persist()
        try:
            numbered = stored(logs.with_line_numbers(logs.events(lines), lines), "events")
            per_tool, rest = tallies.split_batch(states, logs.attribution_lines(numbered), logs.content_blocks(numbered), batch_id)
            turns = turn_plan.build_turns(logs.responses(numbered))
            history.append(with_slices(turns, per_tool, rest), dedup.session_dimension(numbered, turns), flush=batch_id)
        finally:
            lines.unpersist()

    return each


def apply_requests(history: History, path: str) -> tuple[int, int]:
    """Run the deletions that wait in a folder of JSON files, all in one pass, and record them as done.

    A turn of a deleted session that arrives later stays: its request is no longer open.
    """
    asked = history.read_json(path, DELETE_SCHEMA)
    if asked is None:
        return 0, 0
    asked = asked.select("*", F.col("_metadata.file_path").alias("request"))
    done = history.done_requests()
    waiting = stored(asked.join(done, "request", "left_anti"), "requests")
    dropped = history.forget_requested(waiting)
    history.mark_done(waiting.select("request").distinct())
    return dropped


def split_late(batch: DataFrame, horizon: Column | str) -> tuple[DataFrame, DataFrame]:
    """(rows on time, rows older than the horizon)."""
    late = F.col("ts") < (F.lit(horizon).cast("timestamp") if isinstance(horizon, str) else horizon)
    return batch.filter(~late), batch.filter(late)


def latest(updates: DataFrame, keys: list[str], version: str = "batch") -> DataFrame:
    """Current rows from a table of updates, one version per micro-batch."""
    rest = [c for c in updates.columns if c not in (*keys, version)]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("row"))
    return newest.select(*keys, "row.*")


def append_updates(path: str, name: str = "batch") -> Callable[[DataFrame, int], None]:
    """Batch function that keeps the rows a batch changed; writing a batch twice overwrites it."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{name}={batch_id}")

    return each


def read_updates(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The rows of all batches with their number, or of those before one; None where there is none yet."""
    try:
        rows = spark.read.option("basePath", path).parquet(path)
    except AnalysisException:
        return None
    return rows if before is None else rows.filter(F.col("batch") < before)
