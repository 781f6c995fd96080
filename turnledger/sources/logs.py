"""JSONL session logs as DataFrames: raw lines, events, content blocks, responses.

Everything up to the events is narrow: lines are parsed where they are read,
only parsed fields reach a shuffle.
"""

from __future__ import annotations

import re
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnledger.functions import paths
from turnledger.operators import dedup
from turnledger.operators.attribution import real_skill, real_tool
from turnledger.plans import turns as turn_plan

EVENT = """type string, timestamp string, sessionId string, requestId string, uuid string, isSidechain boolean,
  cwd string, model string, version string, attributionSkill string,
  message struct<id: string, model: string, stop_reason: string, content: variant,
    usage: struct<input_tokens: variant, output_tokens: variant, cache_read_input_tokens: variant,
      cache_creation_input_tokens: variant, cache_creation: struct<ephemeral_1h_input_tokens: variant>>>"""
#: What surrounds a line without being part of it.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
BLOCK = """type string, name string, id string, tool_use_id string, is_error boolean, text string,
  input struct<skill: string>"""


def split_roots(value: str) -> list[str]:
    """Roots from one string separated by commas or colons (a colon before // belongs to a URI)."""
    return [part for part in re.split(r",|:(?!//)", value) if part]


def log_folders(roots: list[str]) -> list[str]:
    return [f"{root.rstrip('/')}/projects" for root in roots]


def _files(reader, folders):
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(folders)


def plain_path(path: Column) -> Column:
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def read_lines(spark: SparkSession, folders: list[str] | str) -> DataFrame:
    """Every line below the folders with its file and split; bytes that are not UTF-8 are replaced."""
    return located(_files(spark.read.format("text"), folders))


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The same for landed, immutable files as a stream."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return located(_files(reader, folder), placed=False)


def located(text: DataFrame, placed: bool = True) -> DataFrame:
    """Lines with file and split; ``placed`` adds their order, which a stream gets per batch."""
    lines = text.select(
        F.make_valid_utf8("value").alias("value"),
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
    )
    return with_place(lines) if placed else lines


def with_place(lines: DataFrame) -> DataFrame:
    """Number rows in reading order; consecutive within a split."""
    return lines.withColumn("place", F.monotonically_increasing_id())


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def parse(lines: DataFrame) -> DataFrame:
    """One row per line with the fields the reports use; columns other than ``value`` pass through.

    Lines that are blank, not JSON, not an object or without a type get a NULL type.
    """
    # one element of a one-element array: what follows the object on the line makes the line unusable
    listed = F.transform(
        F.array(stripped(F.col("value"))),
        lambda t: F.when(F.startswith(t, F.lit("{")), F.from_json(F.concat(F.lit("["), t, F.lit("]")), f"array<struct<{EVENT}>>", {"allowSingleQuotes": "false"})),
    )
    # Generated, so that filters on parsed fields stay above: pushed below, each of them would parse the line again.
    parsed = lines.select("*", F.explode_outer(F.transform(listed, lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))))).alias("e"))
    message, usage = F.col("e.message"), F.col("e.message.usage")
    # the JSON type decides: a string is one text block whatever it begins with, of a list only the objects are blocks
    given = message["content"]
    plain = F.when(F.schema_of_variant(given) == "STRING", F.try_variant_get(given, "$", "string"))
    wrapped = F.when(plain != "", F.array(F.to_json(F.struct(F.lit("text").alias("type"), plain.alias("text")))))
    blocks = F.when(F.schema_of_variant(given).startswith("ARRAY"), F.try_variant_get(given, "$", "array<variant>"))
    objects = F.transform(F.filter(blocks, lambda b: F.schema_of_variant(b).startswith("OBJECT")), lambda b: F.to_json(b))
    content = F.coalesce(objects, wrapped, F.array().cast("array<string>"))
    default_session = F.regexp_extract("file", r"([^/]+)\.[^./]*$", 1)
    has_usage = usage["input_tokens"].isNotNull()

    def tokens(value: Column) -> Column:
        whole = F.coalesce(F.try_variant_get(value, "$", "bigint"), F.try_variant_get(value, "$", "double").try_cast("bigint"))
        return F.when(has_usage, F.coalesce(whole, F.lit(0)))

    when = F.coalesce(F.try_to_timestamp(F.col("e.timestamp")), F.timestamp_seconds(F.lit(0)))
    skill = F.col("e.attributionSkill")
    rest = [c for c in lines.columns if c != "value"]
    return parsed.select(
        *rest,
        F.nullif("e.type", F.lit("")).alias("type"),
        F.coalesce(F.nullif("e.sessionId", F.lit("")), default_session).alias("session_id"),
        F.col("e.requestId").alias("request_id"),
        message["id"].alias("message_id"),
        F.col("e.uuid").alias("uuid"),
        when.alias("ts"),
        tokens(usage["input_tokens"]).alias("input_tokens"),
        tokens(usage["output_tokens"]).alias("output_tokens"),
        tokens(usage["cache_read_input_tokens"]).alias("cache_read_tokens"),
        tokens(usage["cache_creation_input_tokens"]).alias("cache_creation_tokens"),
        tokens(usage["cache_creation"]["ephemeral_1h_input_tokens"]).alias("cache_creation_1h_tokens"),
        (~F.coalesce(has_usage, F.lit(False))).alias("is_interrupted"),
        F.coalesce(F.nullif("e.model", F.lit("")), F.nullif(message["model"], F.lit(""))).alias("model"),
        F.coalesce("e.isSidechain", F.array_contains(F.split("file", "/"), "subagents")).alias("is_sidechain"),
        message["stop_reason"].alias("stop_reason"),
        paths.normalise_cwd(F.col("e.cwd")).alias("cwd"),
        F.when(F.col("e.type") == "system", F.col("e.version")).alias("version"),
        F.when(real_skill(skill), skill).alias("attribution_skill"),
        content.alias("content"),
    )


def events(lines: DataFrame) -> DataFrame:
    return parse(lines).filter(F.col("type").isNotNull())


def rejected(lines: DataFrame) -> DataFrame:
    """Unusable lines per file, blank ones apart."""
    blank = stripped(F.col("value")) == ""
    return (
        parse(lines.withColumn("blank", blank))
        .groupBy("file")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.count_if("blank").alias("blank_lines"),
            F.count_if(F.col("type").isNull() & ~F.col("blank")).alias("bad_lines"),
        )
    )


def with_line_numbers(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """1-based line number in the file, blank lines counted, without sorting a file.

    Places are consecutive within a split, so a line number is the number of
    lines in earlier splits plus the distance from the first place of its own
    split. ``lines`` are the unfiltered lines that ``rows`` came from; only one
    row per split is shuffled and joined.
    """
    splits = lines.groupBy("file", "split").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "split", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return (
        rows.join(starts, ["file", "split"])
        .withColumn("line", F.col("before") + F.col("place") - F.col("first") + 1)
        .drop("split", "place", "first", "before")
    )


def _counts(names: Column) -> Column:
    pairs = F.transform(
        F.array_distinct(names), lambda n: F.struct(n, F.size(F.filter(names, lambda x: x == n)).cast("bigint"))
    )
    return F.when(F.size(names) > 0, F.map_from_entries(pairs))


def responses(rows: DataFrame) -> DataFrame:
    """Assistant events as logged responses, ready for ``build_turns``."""
    blocks = F.transform("content", lambda b: F.from_json(b, BLOCK))
    calls = F.filter("blocks", lambda b: b["type"] == "tool_use")
    names = F.transform(F.filter(calls, lambda b: real_tool(b["name"])), lambda b: b["name"])
    skills = F.transform(
        F.filter(calls, lambda b: F.coalesce(b["name"] == "Skill", F.lit(False)) & real_skill(b["input"]["skill"])),
        lambda b: b["input"]["skill"],
    )
    errors = F.filter("blocks", lambda b: (b["type"] == "tool_result") & F.coalesce(b["is_error"], F.lit(False)))
    return (
        rows.filter(F.col("type") == "assistant")
        .withColumn("blocks", blocks)
        .withColumns(
            {
                "tool_use_count": F.size(calls).cast("bigint"),
                "tool_error_count": F.size(errors).cast("bigint"),
                "tool_names": _counts(names),
                "skill_names": _counts(skills),
                "dedup_key": F.concat("message_id", F.lit(":"), "request_id"),
            }
        )
        .drop("blocks", "content", "type", "version", "request_id", "message_id")
    )


def content_blocks(rows: DataFrame) -> DataFrame:
    """One row per content block with its size as compact JSON."""
    exploded = rows.select("file", "line", F.posexplode("content").alias("pos", "block"))
    parsed = F.from_json("block", BLOCK)
    return exploded.withColumn("b", parsed).select(
        "file", "line", F.col("pos").cast("bigint").alias("pos"),
        F.col("b.type").alias("kind"), F.col("b.name").alias("name"), F.col("b.id").alias("block_id"),
        F.col("b.tool_use_id").alias("tool_use_id"), F.col("b.is_error").alias("is_error"),
        F.octet_length("block").cast("bigint").alias("nbytes"),
    )


def message_text(content: Column) -> Column:
    """Text blocks of a message joined by blanks."""
    parsed = F.transform(content, lambda b: F.from_json(b, BLOCK))
    return F.array_join(F.transform(F.filter(parsed, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), " ")


def attribution_lines(rows: DataFrame) -> DataFrame:
    """All lines with prices, pool set on billed assistant lines: input of ``attribute``."""
    billed = (F.col("type") == "assistant") & ~F.col("is_interrupted")
    pool = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    keyed = rows.withColumn("dedup_key", F.concat("message_id", F.lit(":"), "request_id"))
    return turn_plan.price_turns(keyed).withColumn("pool", F.when(billed, pool))


def load(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events with line numbers, turns, sessions) of everything below the roots."""
    lines = read_lines(spark, log_folders(roots))
    numbered = with_line_numbers(events(lines), lines)
    turns = turn_plan.build_turns(responses(numbered))
    return numbered, turns, dedup.session_dimension(numbered, turns)


def log_versions(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("version").isNotNull()).groupBy("version").agg(F.count(F.lit(1)).alias("events"))


# -- which files changed -------------------------------------------------------


def listing(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Path, size and modification time of every log file; contents are not read."""
    files = _files(spark.read.format("binaryFile"), folders)
    return files.select(plain_path(F.col("path")).alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def changed_files(found: DataFrame, marks: DataFrame) -> DataFrame:
    """Files that are new or whose modification time differs from the mark."""
    return found.join(marks.select("file", "mtime"), ["file", "mtime"], "left_anti")


def fingerprint(found: DataFrame) -> DataFrame:
    """One row that changes when any file does, whatever the listing order."""
    code = F.xxhash64("file", "size", "mtime")
    return found.agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
        F.bit_xor(code).alias("mixed"), F.sum(code.cast("decimal(20,0)")).cast("string").alias("summed"),
    )


def literal(path: str) -> str:
    """A path as a pattern that names itself only."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_changed(spark: SparkSession, folders: list[str], marks: DataFrame | None, group: int = 10_000) -> DataFrame:
    """Lines of changed files only, read in groups of at most ``group`` paths; paths are taken literally."""
    if marks is None:
        return read_lines(spark, folders)
    found, paths_ = None, (literal(row.file) for row in changed_files(listing(spark, folders), marks).select("file").toLocalIterator())
    while some := list(islice(paths_, group)):
        part = located(spark.read.format("text").load(some))
        found = part if found is None else found.unionByName(part)
    return read_lines(spark, folders).filter(F.lit(False)) if found is None else found
