"""Cross-site boilerplate lines: distinct-site spread by HyperLogLog, exact counts near the threshold.

A line that stands on ``min_sites`` or more sites (sources) is boilerplate and is
removed wherever it stands. Lines are keyed by 128 bits of hashes of the trimmed
line. One hash aggregation drops the lines of a single site, which are most;
the others get a HyperLogLog sketch of their sites, merged by aggregation. A
sketch settles what is clearly above or below the threshold; lines within its
error are counted exactly. A very common line is one partial row per task.

Copies do not make boilerplate: all rows with one text count as one site, the least
of their sources. A document with edits of a text that was copied far and wide is
known by its lines: over half of it, and ``many`` of them at least, are spread. It is
left whole, for near-duplicate removal to keep one of its kind. Every other document
loses all its spread lines, however much of it they are.

Texts are shuffled only for documents that may lose a line.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.shared import maybe_in, packed
from turnledger.session import stored

MIN_SITES, MIN_CHARS, MAX_LOSS, MANY = 8, 1, 0.5, 8
#: log2 of the sketch's registers, and how many standard errors count as near the threshold.
LG_K, ERRORS = 12, 5

BLANK = " \t\r\u000b\f"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    keys = [F.xxhash64("row.doc_id", text).alias("_k1"), F.xxhash64(F.lit(1), "row.doc_id", text).alias("_k2")]
    return packed(docs).select("row", *keys, F.split(text, "\n").alias("_lines"))


def _lines(docs: DataFrame, min_chars: int, *columns) -> DataFrame:
    line = F.trim(F.col("_line"), F.lit(BLANK))
    exploded = docs.select(*columns, F.posexplode("_lines").alias("_pos", "_line")).where(F.length(line) >= min_chars)
    return exploded.select(*[c for c in exploded.columns if c != "_line"], F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), F.length("_line").alias("chars"))


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2) of the lines of ``docs`` (source, text) that stand on ``min_sites`` distinct sources or more; a null source is no site, copies of a text are one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.where(F.col("source").isNotNull()).select(F.col("source").cast("string").alias("source"), text).select("*", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    copied = rows.groupBy("t1", "t2").agg(F.min("source").alias("lo"), F.max("source").alias("hi")).where("lo < hi").select("t1", "t2")
    flagged = maybe_in(rows, "t1", stored(copied, "copied"))
    one = flagged.where("_maybe").groupBy("t1", "t2").agg(F.min("source").alias("source"), F.any_value("text").alias("text"))
    texts = flagged.where("not _maybe").select("source", "text").unionByName(stored(one.select("source", "text"), "copied-texts"))
    sites = texts.select(F.xxhash64("source").alias("site"), F.split("text", "\n").alias("_lines"))
    lines = _lines(sites, min_chars, "site").select("h1", "h2", "site")
    several = lines.groupBy("h1", "h2").agg(F.min("site").alias("lo"), F.max("site").alias("hi")).where("lo < hi").select("h1", "h2")
    several = stored(several, "several")
    wide = maybe_in(lines, "h1", several).where("_maybe").select("h1", "h2", "site")
    sketches = wide.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("estimate"))
    slack = ceil(ERRORS * 1.04 / sqrt(1 << LG_K) * min_sites) + 1
    sketches = stored(sketches.where(F.col("estimate") >= min_sites - slack), "spread")
    sure = sketches.where(F.col("estimate") > min_sites + slack).select("h1", "h2")
    near = sketches.where(F.col("estimate") <= min_sites + slack).select("h1", "h2")
    pairs = maybe_in(wide, "h1", near).where("_maybe").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("sites")).join(near, ["h1", "h2"]).where(F.col("sites") >= min_sites).select("h1", "h2")
    return sure.unionByName(exact)


def marked(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, max_loss: float = MAX_LOSS, many: int = MANY) -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` with key and lines, the positions to drop of the documents that lose a line by key)."""
    keyed = _keyed(docs)
    boilerplate = stored(spread_lines(docs, min_sites, min_chars), "boilerplate")
    lines = _lines(keyed.withColumn("_all", F.length(F.col("row.text").cast("string"))), min_chars, "_k1", "_k2", "_all", "_lines")
    found = maybe_in(lines, "h1", boilerplate).where("_maybe").join(boilerplate, ["h1", "h2"], "left_semi")
    # rows that repeat a document give the same positions: count each once
    once = found.groupBy("_k1", "_k2", "_pos").agg(F.max("chars").alias("chars"), F.max("_all").alias("_all"))
    drops = once.groupBy("_k1", "_k2").agg(F.collect_list("_pos").alias("_drop"), F.sum("chars").alias("lost"), F.max("_all").alias("_all"))
    copy = (F.col("lost") > max_loss * F.col("_all")) & (F.size("_drop") >= many)
    return keyed, stored(drops.where(~copy).select("_k1", "_k2", "_drop"), "drops")


def _cleaned(keyed: DataFrame, drops: DataFrame) -> DataFrame:
    """(row, _text, _drop): texts rid of the marked lines; rows that certainly lose nothing do not move."""
    split = maybe_in(keyed.drop("_lines"), "_k1", drops)
    raw = F.col("row.text").cast("string")
    same = split.where(~F.col("_maybe")).select("row", raw.alias("_text"), F.lit(None).cast("array<int>").alias("_drop"))
    some = split.where("_maybe").join(drops, ["_k1", "_k2"], "left").withColumn("_lines", F.split(F.coalesce(raw, F.lit("")), "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    lines = F.col("_lines")
    text = F.when(F.col("_drop").isNull(), raw).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return same.unionByName(some.select("row", text.alias("_text"), "_drop"))


def remove_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, max_loss: float = MAX_LOSS, many: int = MANY) -> DataFrame:
    """``docs``, all columns and rows, with boilerplate lines taken out of ``text``.

    Lines lie between newlines and are compared without surrounding blanks;
    lines of fewer than ``min_chars`` characters, with 1 the blank ones, are never
    boilerplate. Null and empty texts stay as they are. Equal rows are cleaned
    alike. An empty table gives an empty one.
    """
    keyed, drops = marked(docs, min_sites, min_chars, max_loss, many)
    cleaned = _cleaned(keyed, drops)
    return cleaned.select(*[F.col("_text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def line_report(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, max_loss: float = MAX_LOSS, many: int = MANY) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_lines, n_removed, text_md5) of the text after removal; null text: 0 lines, null hash."""
    keyed, drops = marked(docs.select("doc_id", "source", F.col("text").cast("string").alias("text")), min_sites, min_chars, max_loss, many)
    raw = F.col("row.text")
    n_lines = F.when(raw.isNull(), 0).otherwise(F.size(F.split(raw, "\n"))).cast("bigint")
    return _cleaned(keyed, drops).select("row.doc_id", n_lines.alias("n_lines"), F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("bigint").alias("n_removed"), F.md5(F.col("_text").cast("binary")).alias("text_md5"))


def report_sql(min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, max_loss: float = MAX_LOSS, many: int = MANY) -> str:
    blank = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
    return f"""
with rows as (select row_number() over () as r, doc_id, source, text, min(source) over (partition by coalesce(text, '')) as site from documents),
lines as (
  select r, doc_id, case when source is not null then site end as source, length(text) as total, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line from rows),
spread as (
  select trim(line, {blank}) as key from lines where length(trim(line, {blank})) >= {min_chars}
  group by 1 having count(distinct source) >= {min_sites}),
hits as (select r, total, pos, length(line) as chars from lines where trim(line, {blank}) in (select key from spread)),
loss as (select r from hits group by r having sum(chars) <= {max_loss} * max(total) or count(*) < {many}),
kept as (
  select l.r, count(*) as n_lines, count(*) filter (where h.pos is not null) as n_removed,
    coalesce(string_agg(line, chr(10) order by l.pos) filter (where h.pos is null), '') as text
  from lines l left join (select hits.* from hits join loss using (r)) h on l.r = h.r and l.pos = h.pos group by l.r)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, case when rows.text is null then null else md5(kept.text) end as text_md5
from rows left join kept using (r)"""
