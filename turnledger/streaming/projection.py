"""The open five-hour window of every key and its projected cost, kept while turns arrive.

A batch of turns becomes one part per (key, minute), so a key that holds most of
the turns reaches its state as at most one row per minute. State is the minutes of
the last SCOPE_HOURS of a key; older ones cannot touch the window that is open at
the newest. An event-time timer clears a key that has gone quiet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from turnledger.constants import USD_UNITS, WINDOW_HOURS
from turnledger.functions.ratios import context_tokens
from turnledger.streaming import ingest

SCOPE_HOURS = 10
REFERENCE_USD = 50.0

#: Times in places and in the state are microseconds: Python gets timestamps with a zone from the state and without one from a batch.
_PLACE = "struct<ts:bigint,file:string,line:bigint>"
MINUTE = f"billed bigint, units bigint, tokens bigint, first {_PLACE}, stopped array<{_PLACE}>"
STATE = f"newest bigint, held array<struct<minute:bigint,billed:bigint,units:bigint,tokens:bigint,first:{_PLACE},stopped:array<{_PLACE}>>>"
RESULT = """key string, batch bigint, as_of timestamp, window_start timestamp, window_end timestamp, cost_usd double, recent_turns bigint,
  recent_cost double, burn_rate_usd_per_hour double, elapsed_hours double, remaining_hours double, projected_cost double, over_reference boolean"""
_TIMES = ("as_of", "window_start", "window_end")


def minute_parts(turns: DataFrame, key: str) -> DataFrame:
    """What a batch of turns adds to the minutes of each key; the array holds the interrupted turns of one minute."""
    billed, place = ~F.col("is_interrupted"), F.struct(F.unix_micros("ts").alias("ts"), "file", "line")
    return turns.groupBy(F.coalesce(key, F.lit("(unknown)")).alias("key"), F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count_if(billed).alias("billed"), F.sum("cost_units").alias("units"), F.sum(context_tokens()).alias("tokens"),
        F.min(F.when(billed, place)).alias("first"), F.collect_list(F.when(~billed, place)).alias("stopped"),
    )


def open_window(minutes: dict[int, tuple], now: int, lookback: int) -> dict | None:
    """The window open at minute ``now`` among minutes -> (billed, units, tokens, first billed turn, interrupted turns); None if there is none."""
    start = None
    for at in sorted(m for m in minutes if now - 60 * SCOPE_HOURS <= m <= now):
        billed, units, _tokens, first, stopped = minutes[at]
        if billed and (start is None or at >= start + 60 * WINDOW_HOURS):
            start, opened, opening, cost, inside = at - at % 60, at, first, 0, []
        if start is not None and at < start + 60 * WINDOW_HOURS:
            cost += units
            attached = len(stopped) if at > opened else sum(x > opening for x in stopped)
            inside.append((at, units, billed + attached))
    if start is None or start + 60 * WINDOW_HOURS < now:
        return None
    recent = [x for x in inside if x[0] >= now - lookback]
    recent_cost = sum(x[1] for x in recent) / float(USD_UNITS)
    left = max(start + 60 * WINDOW_HOURS - now, 0) / 60
    rate = recent_cost / (lookback / 60) if lookback else 0.0
    projected = cost / float(USD_UNITS) + rate * left
    return {
        "start": start, "cost_usd": cost / float(USD_UNITS), "recent_turns": sum(x[2] for x in recent), "recent_cost": recent_cost,
        "burn_rate_usd_per_hour": rate, "elapsed_hours": (now - start) / 60, "remaining_hours": left, "projected_cost": projected,
        "over_reference": projected > REFERENCE_USD,
    }


def _place(x) -> tuple:
    """A place as Python gets it from a batch (a mapping) or from the state (a row)."""
    return (x["ts"], x["file"], x["line"])


class OpenWindow(StatefulProcessor):
    """Minutes of one key; every batch that adds to them gives the projection at the minute after the newest turn."""

    def __init__(self, lookback: int):
        self.lookback = lookback

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("minutes", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, kept = self.state.get() if self.state.exists() else (None, [])
        held = {m["minute"]: (m["billed"], m["units"], m["tokens"], m["first"] and _place(m["first"]), [*map(_place, m["stopped"])]) for m in kept}
        batch = -1
        for row in rows:
            at, batch = row.at, max(batch, row.batch)
            billed, units, tokens, first, stopped = held.get(at, (0, 0, 0, None, []))
            firsts = [x for x in (first, row.first and _place(row.first)) if x]
            held[at] = (billed + row.billed, units + row.units, tokens + row.tokens, min(firsts, default=None), [*stopped, *map(_place, row.stopped)])
        newest = max(held)
        held = {m: x for m, x in held.items() if m >= newest + 1 - 60 * SCOPE_HOURS}
        self.state.update((newest, [(m, *x) for m, x in held.items()]))
        if before != newest:
            if before is not None:
                self.handle.deleteTimer(self._ends(before))
            self.handle.registerTimer(self._ends(newest))
        found = open_window(held, newest + 1, self.lookback)
        if found is not None:
            start = found.pop("start")
            yield Row(key=key[0], batch=batch, as_of=60 * (newest + 1), window_start=60 * start, window_end=60 * (start + 60 * WINDOW_HOURS), **found)

    @staticmethod
    def _ends(minute: int) -> int:
        return (minute + 60 * SCOPE_HOURS + 1) * 60_000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterable[Row]:
        if self.state.exists() and self._ends(self.state.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def run(spark, parts: str, path: str, lookback_minutes: int = 20) -> None:
    """Process the parts that have landed in ``parts`` (one folder per batch); projections go to ``path``/projections."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = f"key string, minute timestamp, {MINUTE}, batch bigint"
    rows = spark.readStream.schema(schema).option("basePath", parts).parquet(parts).withWatermark("minute", f"{SCOPE_HOURS} hours")
    rows = rows.withColumn("at", F.floor(F.unix_timestamp("minute") / 60))
    found = rows.groupBy("key").transformWithState(OpenWindow(lookback_minutes), RESULT.replace(" timestamp", " bigint"), "Update", "EventTime")
    found = found.withColumns({c: F.timestamp_seconds(c) for c in _TIMES})
    ingest.run_available(found, f"{path}/checkpoint", ingest.append_updates(f"{path}/projections", "run"), mode="update")


def projections(spark, path: str) -> DataFrame:
    """The projections of all batches: per key and batch of turns the window open after it."""
    return spark.read.schema(RESULT).parquet(f"{path}/projections").drop("run")
