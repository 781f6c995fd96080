"""Projects and models as entities: ancestor roll-up of directories, short unique labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnledger import constants as K
from turnledger.functions import paths, pricing

MAX_SEGMENTS = 20


def canonical_cwd(sessions: DataFrame) -> DataFrame:
    """(session_id, project): each directory rolls up to its shortest ancestor that is itself in use.

    Path prefixes are exploded and equi-joined with the directories in use, so
    the work is directories times depth instead of pairs of directories.
    """
    raw = sessions.select("session_id", F.coalesce(F.nullif("cwd", F.lit("")), F.lit(K.UNKNOWN)).alias("cwd"))
    used = raw.select("cwd").distinct().filter(F.col("cwd") != K.UNKNOWN)
    prefixes = used.select("cwd", F.explode(paths.ancestors(F.col("cwd"))).alias("prefix"))
    found = prefixes.join(used.select(F.col("cwd").alias("prefix")), "prefix")
    shortest = found.groupBy("cwd").agg(F.min_by("prefix", F.length("prefix")).alias("top"))
    return raw.join(shortest, "cwd", "left").select("session_id", F.coalesce("top", "cwd").alias("project"))


def labels(cwds: DataFrame) -> DataFrame:
    """Shortest path suffix that tells apart all directories sharing a basename."""
    based = cwds.select("cwd").distinct().withColumn("base", paths.basename(F.col("cwd")))
    groups = based.groupBy("base").agg(F.count(F.lit(1)).alias("members"))
    clashing = based.join(groups.filter("members > 1"), "base")
    tried = clashing.withColumn("segments", F.explode(F.sequence(F.lit(2), F.lit(MAX_SEGMENTS)))).withColumn(
        "label", paths.suffix(F.col("cwd"), F.col("segments"))
    )
    enough = (
        tried.groupBy("base", "segments", "members")
        .agg(F.countDistinct("label").alias("distinct_labels"))
        .filter("distinct_labels = members")
        .groupBy("base")
        .agg(F.min("segments").alias("segments"))
    )
    solved = clashing.join(enough, "base", "left").withColumn(
        "label",
        F.when(F.col("segments").isNull(), F.col("cwd")).otherwise(
            F.coalesce(F.nullif(paths.suffix(F.col("cwd"), F.col("segments")), F.lit("")), F.lit(K.EMPTY_LABEL))
        ),
    )
    return based.join(solved.select("cwd", "label"), "cwd", "left").select("cwd", F.coalesce("label", "base").alias("label"))


def with_project(rollup: DataFrame, projects: DataFrame) -> DataFrame:
    """Attach the project of a session to rows already reduced per session."""
    return rollup.join(projects, "session_id", "left").withColumn(
        "project", F.coalesce("project", F.lit(K.UNKNOWN))
    )


def active_entities(turns: DataFrame, projects: DataFrame) -> DataFrame:
    """Distinct projects and models of the turns with their labels."""
    per_session = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    cwds = with_project(per_session, projects).filter(F.col("project") != K.UNKNOWN).select(F.col("project").alias("cwd"))
    named = labels(cwds).select(F.lit("project").alias("kind"), "label", F.col("cwd").alias("value"))
    seen = turns.filter(F.coalesce("model", F.lit("")) != "").groupBy("model").agg(F.min(F.struct("ts", "file", "line")).alias("at"))
    models = (
        seen.groupBy(pricing.short_model(F.col("model")).alias("label"))
        .agg(F.min_by("model", "at").alias("value"))
        .select(F.lit("model").alias("kind"), "label", "value")
    )
    return named.unionByName(models)


def archived(sessions: DataFrame, live_files: DataFrame) -> DataFrame:
    """Flag sessions whose id is not the stem of a live file; needs a listing (file), no content."""
    stem = F.regexp_replace(F.regexp_extract("file", "([^/]+)/*$", 1), "(?<=.)[.][^.]*$", "")
    live = live_files.select(stem.alias("session_id")).distinct().withColumn("live", F.lit(True))
    return sessions.join(live, "session_id", "left").withColumn("archived", F.col("live").isNull()).drop("live")


