"""Secret scan: base rules for credentials, and weak parts that count only next to their complement.

Base spans (assigned secrets, access keys, long hex runs) are always reported.
Weak parts are mixed-case keys, account identifiers and endpoints; each is
reported only if a complementary part (a secret for an identifier or endpoint, an
identifier or endpoint for a key) starts within ``REACH`` code points of it and
does not overlap it. This interval join runs inside each row: parts are sorted
by start, and spans of one kind do not overlap, so all partners of a part lie
within ``NEIGHBOURS`` places of it.

Everything is built-in functions on the row that holds the text: no shuffle, no
Python on executors. Texts without a part cost a few regular expression passes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.shared import packed

REACH = 200


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _assigned(words: list[str], value: str) -> str:
    return "(?:" + "|".join(map(_either_case, words)) + ")[\"']?\\x20*[:=]\\x20*[\"']?(" + value + ")"


#: kind -> (pattern, least characters of a match, is the kind reported without a complement). Fixed values for the first three.
KINDS = {
    "assign": (_assigned(["password", "passwd", "secret", "token", "api_?key"], "[A-Za-z0-9+/_.=-]+"), 18, True),
    "access": ("AKIA[A-Z0-9]{14,}", 18, True),
    "hex": ("[0-9a-f]{16,}", 16, True),
    "key": ("[A-Za-z0-9+/_-]{20,}", 20, False),
    "ident": (_assigned(["username", "user", "login", "account", "client_?id"], "[A-Za-z0-9._@+-]{3,}"), 8, False),
    "endpoint": ("https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?", 8, False),
}
NAMES = list(KINDS)
SECRETS, OWNERS = ("assign", "hex", "key"), ("access", "ident", "endpoint")
#: Parts that can start within REACH to one side of a part: each kind's spans are disjoint and of a least length.
NEIGHBOURS = sum(REACH // least + 1 for _, least, _ in KINDS.values())
VALUE = 12

_SPAN = "array<struct<start:bigint,kind:int,stop:bigint>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(values: Column, block: int = 256) -> Column:
    """Sums of the first 1, 2, ... elements; in blocks, so that the work does not grow with the square of the length."""
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, v: a + v)

    def sums(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: total(F.slice(v, b * block + 1, block)))
        starts = lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda b: total(F.slice(t, F.lit(1), b)))
        each = lambda s: F.transform(v, lambda _, i: F.get(s, F.floor(i / block).cast("int")) + total(F.slice(v, (F.floor(i / block) * block + 1).cast("int"), i % block + 1)))
        return let(let(blocks, starts), each)

    return F.when(F.size(values) > 0, let(values, sums)).otherwise(F.array().cast("array<bigint>"))


def _spans(text: Column, kind: str) -> Column:
    """Spans of one kind: what stands between matches and the matches themselves add up to positions."""
    pattern, _, _ = KINDS[kind]
    rank = NAMES.index(kind)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(both: Column) -> Column:
        gaps, found = both["gaps"], both["found"]
        steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))
        starts = running_sums(F.transform(steps, lambda s: s.cast("bigint")))
        return let(starts, lambda at: F.transform(found, lambda m, i: F.struct(F.get(at, i).alias("start"), F.lit(rank).alias("kind"), (F.get(at, i) + F.length(m)).alias("stop"), m.alias("m"))))

    spans = let(F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("found")), located)
    if kind == "assign":
        spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["m"], pattern, 1)) >= VALUE)
    if kind == "key":
        spans = F.filter(spans, lambda s: s["m"].rlike("[0-9]") & s["m"].rlike("[a-z]") & s["m"].rlike("[A-Z]"))
    bare = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    return F.when(text.rlike(pattern), bare).otherwise(F.array().cast(_SPAN))


def _linked(parts: Column) -> Column:
    """Of sorted parts: the base ones, and weak ones with a complement within reach."""
    secret = [NAMES.index(k) for k in SECRETS]
    base = [NAMES.index(k) for k in NAMES if KINDS[k][2]]

    def reported(p: Column, i: Column) -> Column:
        near = F.slice(parts, F.greatest(i - NEIGHBOURS, F.lit(0)) + 1, F.lit(2 * NEIGHBOURS + 1))
        return p["kind"].isin(base) | F.exists(
            near,
            lambda q: (q["kind"].isin(secret) != p["kind"].isin(secret))
            & (F.abs(q["start"] - p["start"]) <= REACH)
            & ((q["stop"] <= p["start"]) | (p["stop"] <= q["start"])),
        )

    return F.filter(parts, reported)


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``found``: the reported spans (start, kind, stop) of ``text``, sorted by start, then kind as in KINDS.

    Positions are code points, stop exclusive. A null text counts as empty; equal
    rows give equal spans; other columns are passed on untouched, one named
    ``found`` is replaced.
    """
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    named = packed(docs).select("row", *[_spans(text, k).alias(f"_{k}") for k in NAMES if k != "key"])
    # a key alone is never reported: only texts with an owner are searched for keys
    owned = F.size("_access") + F.size("_ident") + F.size("_endpoint") > 0
    keys = F.when(owned, _spans(text, "key")).otherwise(F.array().cast(_SPAN))
    parts = F.array_sort(F.concat(*[F.col(f"_{k}") if k != "key" else keys for k in NAMES]))
    weak = F.size("_ident") + F.size("_endpoint") > 0
    found = F.when(weak | owned, let(parts, _linked)).otherwise(parts)
    return named.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "found"], found.alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) of every row."""
    found = scan(docs.select("doc_id", "text")).select("doc_id", "found")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == NAMES.index(kind))).cast("bigint")
    base = F.filter("found", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in NAMES[:3]], F.sha2(_text_of(base).cast("binary"), 256).alias("base_sha256"),
        _text_of(F.col("found")).alias("spans"), (F.size("found") - F.size(base)).cast("bigint").alias("n_linked"),
    )


def report_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda kinds: ", ".join(str(NAMES.index(k)) for k in kinds)
    parts = " union all ".join(
        f"select r, {k} as kind, unnest(regexp_extract_all(t, {quote(KINDS[n][0])})) as m, unnest(string_split_regex(t, {quote(KINDS[n][0])})) as gap, "
        f"generate_subscripts(string_split_regex(t, {quote(KINDS[n][0])}), 1) as i from texts" for k, n in enumerate(NAMES))
    names = "case s.kind " + " ".join(f"when {k} then '{n}'" for k, n in enumerate(NAMES)) + " end"
    return f"""
with texts as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
matches as ({parts}),
placed as (
  select r, kind, m, sum(length(gap)) over w + coalesce(sum(length(m)) over (w rows between unbounded preceding and 1 preceding), 0) as start
  from matches window w as (partition by r, kind order by i)),
valid as (
  select r, kind, cast(start as bigint) as start, cast(start + length(m) as bigint) as stop from placed
  where m is not null and (kind <> 0 or length(regexp_extract(m, {quote(KINDS["assign"][0])}, 1)) >= {VALUE})
    and (kind <> 3 or (regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]')))),
shown as (
  select * from valid p where kind < 3 or exists (
    select 1 from valid q where q.r = p.r and (q.kind in ({listed(SECRETS)})) <> (p.kind in ({listed(SECRETS)}))
      and abs(q.start - p.start) <= {REACH} and (q.stop <= p.start or p.stop <= q.start))),
texts_of as (
  select r, string_agg({names} || ':' || start || ':' || stop, ',' order by start, kind) as spans,
    string_agg({names} || ':' || start || ':' || stop, ',' order by start, kind) filter (where kind < 3) as base,
    count(*) filter (where kind = 0) as a, count(*) filter (where kind = 1) as k, count(*) filter (where kind = 2) as h, count(*) filter (where kind > 2) as w
  from shown s group by r)
select doc_id, coalesce(a, 0) as n_assign, coalesce(k, 0) as n_access, coalesce(h, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(w, 0) as n_linked
from texts left join texts_of using (r)"""
