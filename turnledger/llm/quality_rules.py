"""Line-first cleaning: rules per line, failing lines out, then documents that lost too much text.

Lines lie between newlines; blank ones pass. A line fails by punctuation (it ends
in no closing mark and has no sentence inside, or has an exclamation mark for
every other word), by navigation (separators between most of its words) or as
boilerplate (markup symbols, or a phrase of notices). A document is kept if its
base counts pass and the failing lines hold no more than ``MAX_LOSS`` of its
characters.

Built-in functions on the row that holds the text: one scan, no shuffle, no Python
on executors. Repeated eight-word windows are found by sorting window hashes
inside the row, and only where two windows of a text are equal at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.secrets import let
from turnledger.llm.shared import packed

MAX_LOSS = 0.5
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30
BLANKS = "\t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|>»·•"
BLANK = "[\\x20\\x09-\\x0D]"
CLOSING = ".!?…:;\"'”’»)]。！？"
SENTENCE = "[.!?…][\\x20\"'”’»)]+[^\\x20]"
NOTICES = ("cookie", "javascript", "all rights reserved", "terms of use", "terms of service", "privacy policy", "lorem ipsum", "skip to content", "subscribe to our")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def _solid(text: Column) -> Column:
    """Characters that are not blank."""
    return F.length(F.regexp_replace(text, BLANK + "+", ""))


def _count(text: Column, characters: str) -> Column:
    """How many of the characters a text holds; one plain search for each, which is cheap where there are none."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.length(text) - F.length(rest)


def line_fails(line: Column) -> Column:
    """Whether a line fails a rule; a blank line does not."""
    words = F.size(_words(line))
    marks, separators, symbols = _count(line, "!"), _count(line, SEPARATORS), _count(line, SYMBOLS)
    closed = F.right(F.rtrim(line, F.lit(" " + BLANKS)), F.lit(1)).isin(list(CLOSING))
    # dear expressions stand behind a cheap one that most lines settle
    punctuation = (~closed & ~line.rlike(SENTENCE)) | ((marks > 0) & (2 * marks > words + 2))
    navigation = (separators >= 3) & (2 * separators >= words - separators)
    lower = F.lower(line)
    notice = F.contains(lower, F.lit(NOTICES[0]))
    for phrase in NOTICES[1:]:
        notice = notice | F.contains(lower, F.lit(phrase))
    return line.rlike("[^\\x20\\x09-\\x0D]") & (punctuation | navigation | ((symbols > 0) & (10 * symbols > _solid(line))) | notice)


def repeated_words(words: Column) -> Column:
    """Words that stand in a window of WINDOW words found twice or more in the list."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(at, i - 1))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, v: a + v)

    def twice(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def counted(w: Column) -> Column:
        ranked = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(let(let(ranked, twice), covered))

    return F.when(F.size(words) >= WINDOW, let(let(hashes, windows), counted)).otherwise(F.lit(0).cast("bigint"))


def judge(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """``docs`` with base counts, ``base_failed``, ``n_removed``, ``clean_text`` and ``kept``.

    A null text counts as empty: no words, so it fails the base rules. Equal rows
    get equal verdicts; other columns are passed on untouched, those with the
    names of the new columns are replaced.
    """
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    counted = packed(docs).select("row", _words(text).alias("_words"), F.split(text, "\n").alias("_lines"))
    real = F.filter("_lines", lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = counted.select(
        "*", F.size("_words").cast("bigint").alias("n_words"), _solid(text).cast("bigint").alias("word_chars"),
        _count(text, SYMBOLS).cast("bigint").alias("n_symbols"),
        let(real, lambda r: F.size(r) - F.size(F.array_distinct(r))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.filter("_lines", lambda x: ~line_fails(x)).alias("_good"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    clean = F.array_join("_good", "\n")
    judged = counted.withColumn("base_failed", failed).withColumn("n_removed", (F.size("_lines") - F.size("_good")).cast("bigint")).withColumn("clean_text", clean)
    kept = ~F.col("base_failed") & ((F.col("n_removed") == 0) | (_solid(F.col("clean_text")) >= (1 - max_loss) * F.col("word_chars")))
    judged = judged.withColumn("kept", kept).drop("_words", "_lines", "_good")
    new = [c for c in judged.columns if c != "row"]
    return judged.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *new)


def report(docs: DataFrame) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed"]
    return judge(docs.select("doc_id", "text")).select(*columns)


def report_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    blanks = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    words = lambda t: f"list_filter(string_split(translate({t}, {blanks}, '     '), ' '), lambda w: w <> '')"
    less = lambda t, c: f"length(translate({t}, {c}, ''))"
    count = lambda c: f"(length(x) - {less('x', c)})"
    solid = less("x", f"' ' || {blanks}")
    fails = f"""({solid} > 0 and (
      (not contains({quote(CLOSING)}, right(rtrim(x, ' ' || {blanks}), 1)) and not regexp_matches(x, {quote(SENTENCE)}))
      or 2 * {count("'!'")} > len({words("x")}) + 2
      or ({count(quote(SEPARATORS))} >= 3 and 2 * {count(quote(SEPARATORS))} >= len({words("x")}) - {count(quote(SEPARATORS))})
      or 10 * {count(quote(SYMBOLS))} > {solid}
      or {" or ".join(f"contains(lower(x), {quote(n)})" for n in NOTICES)}))"""
    return f"""
with texts as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
split as (select r, doc_id, t, {words("t")} as w, string_split(t, chr(10)) as lines from texts),
windows as (
  select r, i, list_slice(w, i, i + {WINDOW - 1}) as v from (select r, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from split where len(w) >= {WINDOW})),
twice as (select r, i from (select r, i, count(*) over (partition by r, v) as n from windows) where n > 1),
covered as (select r, sum(least({WINDOW}, coalesce(i - before, {WINDOW}))) as n from (select r, i, lag(i) over (partition by r order by i) as before from twice) group by r),
judged as (
  select r, doc_id, t, cast(len(w) as bigint) as n_words, {less("t", f"' ' || {blanks}")} as word_chars, length(t) - {less("t", quote(SYMBOLS))} as n_symbols,
    list_filter(lines, lambda x: {solid} > 0) as real, lines, list_filter(lines, lambda x: not {fails}) as good from split)
select doc_id, n_words, word_chars, n_symbols, cast(len(real) - len(list_distinct(real)) as bigint) as n_dup_lines,
  cast(coalesce(n, 0) as bigint) as n_repeat_words, n_words < {MIN_WORDS} or 100 * coalesce(n, 0) > {MAX_REPEATED} * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * coalesce(n, 0) > {MAX_REPEATED} * n_words)
    and {less("array_to_string(good, chr(10))", f"' ' || {blanks}")} >= {1 - MAX_LOSS} * word_chars as kept,
  cast(len(lines) - len(good) as bigint) as n_removed
from judged left join covered using (r)"""
