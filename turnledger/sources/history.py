"""Durable history: turns partitioned by day, and one attribute row per session and flush.

All tables only grow. Sessions are derived on read: first, last and count from the
turns, attributes from the newest flush that names them. Deleted turns are rows of
a table of deletions, taken off on read until ``compact`` writes what is left to a new
folder. Every append has a number; a deletion reaches the appends before it, so a
deleted turn may come again.

Which keys history holds is read from an index in hash buckets (``Parts``), of
which an append opens the buckets of its own keys. Its keys are written before its
turns and counted after them: an append that was cut off is completed or taken back
by the next one, from the days it names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from turnledger.operators import dedup
from turnledger.session import stored
from turnledger.streaming.parts import Parts

SLICES = "array<struct<tool: string, tool_input_tokens: double, tool_output_tokens: double, tool_usd: double, tool_usd_uncached: double>>"
REST = "struct<rest_input_tokens: double, rest_output_tokens: double, rest_usd: double>"

# Columns added after the first layout, with the value old rows get.
LATER_COLUMNS = {
    "cache_creation_1h_tokens": "0L", "attribution_skill": "cast(null as string)", "skill_names": "cast(null as map<string,bigint>)",
    "tool_slices": f"cast(null as {SLICES})", "rest": f"cast(null as {REST})", "added": "-1L",
}

TURN_SCHEMA = f"""turn_key string, file string, line bigint, ts timestamp, session_id string, model string, input_tokens bigint,
  output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint, cache_creation_1h_tokens bigint, input_units bigint,
  output_units bigint, cache_read_units bigint, cache_creation_units bigint, cache_saved_units bigint, cost_units bigint,
  is_sidechain boolean, is_interrupted boolean, stop_reason string, tool_use_count bigint, tool_error_count bigint,
  tool_names map<string,bigint>, tags array<string>, attribution_skill string, skill_names map<string,bigint>,
  tool_slices {SLICES}, rest {REST}, added bigint, date date"""
ATTRIBUTE_SCHEMA = "session_id string, source_file string, cwd string, is_sidechain boolean, flush bigint, added bigint"
KEY_SCHEMA = "turn_key string, session_id string, date date, added bigint"
#: before: the number of the first append that the deletion does not reach; last: the session lost its last turn.
DELETION_SCHEMA = "turn_key string, session_id string, date date, before bigint, last boolean"


class History:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.attributes_path = f"{self.root}/session_attributes"
        self.done_path = f"{self.root}/requests_done"
        self.keys = Parts(spark, f"{self.root}/keys", KEY_SCHEMA, by="turn_key")
        self.deletions = Parts(spark, f"{self.root}/deletions", DELETION_SCHEMA, by="turn_key")
        self.versions = Parts(spark, f"{self.root}/versions", "n bigint")
        self.lookup = Parts(spark, f"{self.root}/session_days", "session_id string, date date", by="session_id", fold=DataFrame.distinct)

    @property
    def turns_path(self) -> str:
        """The folder with the turns; every compaction begins a new one."""
        return f"{self.root}/turns-{self.versions.count()}"

    # -- reading ---------------------------------------------------------------

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException:  # no such folder yet
            return self.spark.createDataFrame([], schema)

    def read_json(self, path: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).json(path)
        except AnalysisException:
            return None

    def done_requests(self) -> DataFrame:
        return self._read(self.done_path, "request string")

    def mark_done(self, requests: DataFrame) -> None:
        requests.select("request").write.mode("append").parquet(self.done_path)

    def _written(self) -> DataFrame:
        rows = self._read(self.turns_path, TURN_SCHEMA)
        return rows.withColumns({c: F.coalesce(F.col(c), F.expr(value)) for c, value in LATER_COLUMNS.items()})

    def turns(self) -> DataFrame:
        """All turns but the deleted ones; columns that old files lack get their default."""
        rows = self._written()
        if not self.deletions.count():
            return rows
        gone = self.deletions.read().groupBy("date", "turn_key").agg(F.max("before").alias("before"))
        return rows.join(gone.withColumnRenamed("turn_key", "gone_key"), (rows.date == gone.date) & (F.col("turn_key") == F.col("gone_key")) & (F.col("added") < F.col("before")), "left_anti")

    def split(self) -> tuple[DataFrame, DataFrame]:
        """(slices per turn and tool, rest per turn) as stored with the turns; reports need not split again."""
        turns = self.turns()
        per_tool = turns.select("file", "line", F.inline("tool_slices"))
        return per_tool, turns.filter(F.col("rest").isNotNull()).select("file", "line", "rest.*")

    def attributes(self) -> DataFrame:
        return self._read(self.attributes_path, ATTRIBUTE_SCHEMA)

    def named(self) -> DataFrame:
        """Session attributes: a newer flush replaces the flag, and file and directory where it knows them."""
        rows = self.attributes()
        if self.deletions.count():  # a session that lost all its turns begins anew
            lost = self.deletions.read().filter("last").groupBy("session_id").agg(F.max("before").alias("before"))
            rows = rows.join(lost, "session_id", "left").filter("before is null or coalesce(added, -1) >= before")
        return rows.groupBy("session_id").agg(
            F.max_by("source_file", F.when(F.col("source_file").isNotNull(), F.col("flush"))).alias("source_file"),
            F.max_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("flush"))).alias("cwd"),
            F.max_by("is_sidechain", "flush").alias("is_sidechain"),
        )

    def sessions(self) -> DataFrame:
        """Session rows with what the turns say about them."""
        named = self.named()
        spans = self.turns().groupBy("session_id").agg(
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("turns")
        )
        return spans.join(named, "session_id", "left").withColumn("is_sidechain", F.coalesce("is_sidechain", F.lit(False)))

    def query_turns(
        self, since: str | None = None, until: str | None = None, project: str | None = None, model: str | None = None
    ) -> DataFrame:
        """Turns between two days (both included), of one model, of sessions in one directory."""
        rows = self.turns()
        if since is not None:
            rows = rows.filter(F.col("date") >= F.lit(since).cast("date"))
        if until is not None:
            rows = rows.filter(F.col("date") <= F.lit(until).cast("date"))
        if model is not None:
            rows = rows.filter(F.col("model") == model)
        if project is not None:
            members = self.named().filter(F.col("cwd") == project).select("session_id")  # attributes only, no turns
            rows = rows.join(members, "session_id", "left_semi")
        return rows

    def session(self, session_id: str) -> DataFrame:
        """Turns of one session in time order, read from the days it was active on; row groups of other sessions are skipped."""
        wanted = self.spark.createDataFrame([(session_id,)], "session_id string")
        days = [r.date for r in self.lookup.read(near=wanted).filter(F.col("session_id") == session_id).select("date").distinct().toLocalIterator()]
        return self.turns().filter(F.col("date").isin(days) & (F.col("session_id") == session_id)).orderBy("ts", "file", "line")

    def hot(self, days: int, as_of: str) -> tuple[DataFrame, DataFrame]:
        """Turns of the last days and the sessions they belong to."""
        start = F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
        rows = self.turns().filter((F.col("date") >= F.to_date(start)) & (F.col("ts") >= start))
        return rows, self.sessions().join(rows.select("session_id").distinct(), "session_id", "left_semi")

    def high_water(self) -> DataFrame:
        return self.turns().groupBy("session_id").agg(F.max("ts").alias("last_ts"))

    # -- writing ---------------------------------------------------------------

    def append(self, turns: DataFrame, sessions: DataFrame | None = None, flush: int = 0) -> None:
        """Add turns whose key history does not hold; running it again adds nothing."""
        number = self._settled()
        key = dedup.passthrough_key(F.col("dedup_key"), F.col("uuid"), F.col("file"), F.col("line"))
        columns = {c: F.expr(value) for c, value in LATER_COLUMNS.items() if c not in turns.columns}
        keyed = turns.withColumns({"turn_key": key, **columns, "date": F.to_date("ts"), "added": F.lit(number).cast("bigint")})
        names = self._read(self.turns_path, TURN_SCHEMA).columns
        keyed = stored(keyed.select(*names, F.monotonically_increasing_id().alias("row_id")), "candidates")
        # Keys are compared without the turns, whose slices are wide; the rows that stay are picked by their number.
        one = dedup.keep_first(keyed.select("turn_key", "file", "line", "session_id", "date", "added", "row_id"), "turn_key", dedup.PLACE)
        one = one.select("turn_key", "session_id", "date", "added", "row_id")
        fresh = stored(one.join(self.held(one.select("turn_key")), "turn_key", "left_anti"), "fresh")
        self.keys.prepare(fresh, number)
        fresh = keyed.join(fresh.select("row_id"), "row_id", "left_semi").select(*names)
        self._write_turns(fresh, self.turns_path)
        if sessions is not None:
            named = sessions.select("session_id", "source_file", "cwd", "is_sidechain", F.lit(flush).cast("bigint").alias("flush"), F.lit(number).cast("bigint").alias("added"))
            named.write.mode("append").parquet(self.attributes_path)
        self._finish(number)

    def held(self, keys: DataFrame) -> DataFrame:
        """Of some keys (turn_key) those that history holds, from the buckets they fall in."""
        known = self.keys.read(near=keys).select("turn_key", "added")
        if self.deletions.count():
            gone = self.deletions.read(near=keys).groupBy("turn_key").agg(F.max("before").alias("before"))
            known = known.join(gone, "turn_key", "left").filter("before is null or added >= before")
        return known.select("turn_key")

    @staticmethod
    def _write_turns(rows: DataFrame, path: str) -> None:
        # Rebalancing by day groups a day's rows and lets AQE split a day that is too big; inside a file sessions lie together.
        rows.hint("rebalance", "date").sortWithinPartitions("date", "session_id", "ts").write.partitionBy("date").mode("append").parquet(path)

    def _finish(self, number: int) -> None:
        self.lookup.add(self.keys.prepared(number).select("session_id", "date").distinct(), number)
        self.keys.finish(number)

    def _settled(self) -> int:
        """The number of the next append. One that was cut off before keeps the turns it had written."""
        number = self.keys.count()
        begun = self.keys.prepared(number)
        if begun is None:
            return number
        dates = [r.date for r in begun.select("date").distinct().toLocalIterator()]
        there = self._written().filter(F.col("date").isin(dates) & (F.col("added") == number)).select("turn_key")
        self.keys.prepare(stored(begun.join(there, "turn_key", "left_semi"), "cut-off"), number)
        self._finish(number)
        return number + 1

    def forget(
        self,
        *,
        session_ids: list[str] | None = None,
        cwd: str | None = None,
        older_than: str | None = None,
        everything: bool = False,
    ) -> tuple[int, int]:
        """Delete history by exactly one criterion; returns (sessions, turns) dropped.

        ``older_than`` works per turn: a session goes when none of its turns is left.
        """
        if sum([session_ids is not None, cwd is not None, older_than is not None, everything]) != 1:
            raise ValueError("forget needs exactly one of session_ids, cwd, older_than, everything")
        turns = self.turns()
        if everything:
            doomed = turns
        elif older_than is not None:
            limit = F.lit(older_than).cast("timestamp")
            doomed = turns.filter((F.col("ts") < limit) & (F.col("date") <= F.to_date(limit)))
        elif session_ids is not None:
            doomed = turns.filter(F.col("session_id").isin(session_ids))
        else:
            doomed = turns.join(self.named().filter(F.col("cwd") == cwd).select("session_id"), "session_id", "left_semi")
        return self._drop(doomed)

    def forget_requested(self, requests: DataFrame) -> tuple[int, int]:
        """Delete in one pass what any of the requests (session_id, cwd or older_than, the first that is set) asks for."""
        ids = requests.filter("session_id is not null").select("session_id")
        places = requests.filter("session_id is null and cwd is not null").select("cwd")
        limit = requests.filter("session_id is null and cwd is null").agg(F.max("older_than").alias("limit"))
        gone = ids.union(self.named().join(places, "cwd", "left_semi").select("session_id")).distinct().withColumn("gone", F.lit(True))
        marked = self.turns().join(gone, "session_id", "left").crossJoin(F.broadcast(limit))  # one row of limit
        return self._drop(marked.filter("gone or ts < limit"))

    def _drop(self, doomed: DataFrame) -> tuple[int, int]:
        """Record the deletion of turns, in one write; nothing that is there is touched."""
        before = self._settled()
        doomed = stored(doomed.select("turn_key", "session_id", "date"), "doomed")
        dropped_turns = doomed.count()
        if dropped_turns == 0:
            return 0, 0
        sizes = doomed.groupBy("session_id").agg(F.count(F.lit(1)).alias("gone"))
        left = self.turns().join(sizes.select("session_id"), "session_id", "left_semi").groupBy("session_id").agg(F.count(F.lit(1)).alias("there"))
        lost = stored(sizes.join(left, "session_id", "left").filter("there is null or there <= gone").select("session_id", F.lit(True).alias("last")), "lost")
        rows = doomed.join(lost, "session_id", "left").withColumns({"last": F.coalesce("last", F.lit(False)), "before": F.lit(before).cast("bigint")})
        self.deletions.add(rows, self.deletions.count())
        return lost.count(), dropped_turns

    def compact(self) -> None:
        """Write the turns without the deleted ones to a new folder and turn readers to it; the old folder can then be removed."""
        self._settled()
        version = self.versions.count()
        target = f"{self.root}/turns-{version + 1}"
        left = self.turns().select(*[f.name for f in self._read(self.turns_path, TURN_SCHEMA).schema])
        left.hint("rebalance", "date").sortWithinPartitions("date", "session_id", "ts").write.partitionBy("date").mode("overwrite").parquet(target)
        self.versions.add(self.spark.createDataFrame([(version,)], "n bigint"), version)


def with_slices(turns: DataFrame, per_tool: DataFrame, rest: DataFrame) -> DataFrame:
    """Turns with their tool slices and the rest, ready for ``append``; an array holds the tools of one turn."""
    place = ["file", "line"]
    slices = per_tool.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct(*[c for c in per_tool.columns if c not in place]))).alias("tool_slices"))
    left = rest.select(*place, F.struct(*[c for c in rest.columns if c not in place]).alias("rest"))
    return turns.join(slices, place, "left").join(left, place, "left")


def merge_tiers(hot: DataFrame, warm: DataFrame, key: str = "turn_key") -> DataFrame:
    """Recent rows plus the older rows they do not already hold."""
    columns = hot.columns
    return hot.unionByName(warm.join(hot.select(key), key, "left_anti").select(*columns))


def encode_tool_costs(per_tool: DataFrame) -> DataFrame:
    """Tool slices of a turn as compact JSON: name -> {i, o, c}. For export."""
    value = F.struct(
        F.col("tool_input_tokens").alias("i"), F.col("tool_output_tokens").alias("o"), F.col("tool_usd").alias("c")
    )
    entries = F.sort_array(F.collect_list(F.struct(F.col("tool"), value.alias("slice"))))
    return per_tool.groupBy("file", "line").agg(F.to_json(F.map_from_entries(entries)).alias("tool_costs"))


def decode_tool_costs(rows: DataFrame) -> DataFrame:
    parsed = F.from_json("tool_costs", "map<string, struct<i: double, o: double, c: double>>")
    return rows.select("file", "line", F.explode(parsed).alias("tool", "slice")).select(
        "file", "line", "tool", F.col("slice.i").alias("tool_input_tokens"),
        F.col("slice.o").alias("tool_output_tokens"), F.col("slice.c").alias("tool_usd"),
    )


def changed_rows(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows of a panel that differ from the last one sent."""
    return current.exceptAll(previous.select(*current.columns))
