"""URL filter: per host a tree of path templates, rejected by smoothed labelled purity.

Paths are generalised level by level. A segment becomes a type where its form
says so (numbers, hashes, dates, names with digits); below a node with many
children the rare ones become a wildcard; and labelled sibling branches whose
share of bad pages and whose mix of next segments do not differ significantly
are merged into one. A template is rejected when its smoothed share of bad labels
reaches ``REJECT``. Explicit rules come first.

Few templates of few hosts have labels of their own, so the share is smoothed by
``STRENGTH`` labels towards that of the same template in the parent domain (its last
three, then its last two labels), and there towards the same template on all hosts.
At the top the prior is moved by how much likelier the template is among bad labels
than among good ones: a template that is no worse than the rest keeps the prior.

Rows are reduced to distinct (host, path) before the tree. A round takes one segment
of every path, and all that follow without a branch; it groups the children of nodes
with map-side sums, and hands the decisions back by a join salted over ``SALT`` parts,
so one host or node may hold most of the rows. Rounds end when no path has a segment
left, however deep it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.shared import maybe_in
from turnledger.session import stored

#: Fixed values: (host, path, verdict); a rule fits its host and all subdomains if the path starts with the rule's, the longest wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

FANOUT, SHARE = 20, 0.05
MIN_LABELS, Z = 5, 2.0
PRIOR, STRENGTH, REJECT = 0.3, 4.0, 0.7
SALT = 8
#: Pages of one url beyond which their rows are spread over SALT tasks.
HOT = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "^[\\s\\S]*?://([^/?#]*)([^?#]*)"


def parsed(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` and ``path``; both empty for a null url or one without ``://``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    part = lambda k: F.regexp_extract(url, _URL, k)
    return pages.withColumn("host", F.translate(part(1), _UPPER, _LOWER)).withColumn("path", part(2))


def ruled(df: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``df`` with ``rule`` (host and path of the longest rule that fits, else null) and ``ruled`` (its verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("ruled", verdict)


def typed(segment: Column) -> Column:
    """The segment, or the type its form gives away."""
    return (
        F.when(segment.rlike("^[0-9]+$"), F.lit("{number}"))
        .when(segment.rlike("^[0-9]+[.][A-Za-z]{2,5}$"), F.lit("{number}.page"))
        .when(segment.rlike("^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("{date}"))
        .when(segment.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("{hash}"))
        .when(segment.rlike("[0-9].*[0-9].*[0-9]"), F.lit("{coded}"))
        .otherwise(segment)
    )


def _salted(rows: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with ``decided``, unique by ``keys``, so that the rows of one key meet in SALT tasks."""
    salt = F.pmod(F.xxhash64("host", "path"), F.lit(SALT)).cast("int")
    copies = decided.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(SALT)])))
    return rows.withColumn("_salt", salt).join(copies, [*keys, "_salt"]).drop("_salt")


def _chain(low: str, high: str) -> Column:
    """The common beginning of all arrays between the least and the greatest."""
    differ = F.array_position(F.zip_with(low, high, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differ == 0, F.col(low)).otherwise(F.slice(low, 1, (differ - 1).cast("int")))


def templates(pages: DataFrame) -> DataFrame:
    """(host, path, template) of distinct paths; ``pages`` has (host, path, n, labelled, bad), unique by host and path."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = stored(pages.withColumn("rest", F.transform(segments, typed)).withColumns({"template": F.lit(""), "open": F.lit(True)}), "paths")
    while rows.where("open").take(1):
        done, rows = rows.where("not open"), rows.where("open")
        here = F.coalesce(F.get("rest", 0), F.lit(""))  # "" ends the path
        follows = F.coalesce(F.get("rest", 1).startswith("{"), F.lit(False))
        later = F.when(F.size("rest") > 1, F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
        children = rows.groupBy("host", "template", here.alias("segment")).agg(
            F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.sum(F.when(follows, F.col("n")).otherwise(0)).alias("variable"),
            F.min(later).alias("low"), F.max(later).alias("high"),
        ).withColumn("chain", _chain("low", "high")).drop("low", "high")
        plain = (F.col("segment") != "") & ~F.col("segment").startswith("{")
        witness = plain & (F.col("labelled") >= MIN_LABELS)
        node = children.groupBy("host", "template").agg(
            F.sum("n").alias("all"), F.count_if(plain).alias("kinds"), F.count_if(witness).alias("witnesses"),
            *[F.sum(F.when(witness, F.col(c)).otherwise(0)).alias(f"w_{c}") for c in ("n", "labelled", "bad", "variable")],
        )
        joined = children.join(node, ["host", "template"])

        def near(part: str, whole: str) -> Column:
            """A branch's share against its labelled siblings' pooled share: is the difference within Z standard errors?"""
            pooled = F.try_divide(F.col(f"w_{part}"), F.col(f"w_{whole}"))
            gap = F.abs(F.try_divide(F.col(part), F.col(whole)) - pooled)
            return F.coalesce(gap * gap * F.col(whole) <= Z * Z * pooled * (1 - pooled) + 1e-9, F.lit(False))

        alike = witness & (F.col("witnesses") > 1) & near("bad", "labelled") & near("variable", "n")
        rare = plain & (F.col("kinds") > FANOUT) & (F.col("n") < SHARE * F.col("all"))
        step = F.when(alike, F.lit("{like}")).when(rare, F.lit("*")).otherwise(F.col("segment"))
        chain = F.when(step == F.col("segment"), F.col("chain")).otherwise(F.array().cast("array<string>"))
        decided = joined.select("host", "template", "segment", step.alias("step"), chain.alias("chain"))
        moved = _salted(rows.withColumn("segment", here), decided, ["host", "template", "segment"])
        taken = 1 + F.size("chain")
        ended = F.col("step") == ""
        longer = F.when(ended, F.col("template")).otherwise(F.concat("template", F.lit("/"), F.array_join(F.concat(F.array("step"), "chain"), "/")))
        left = F.when(F.size("rest") > taken, F.slice("rest", taken + 1, F.greatest(F.size("rest") - taken, F.lit(0)))).otherwise(F.array().cast("array<string>"))
        # a path that ends here may have longer siblings: it is closed in the round that meets its end
        moved = moved.withColumns({"template": longer, "rest": left, "open": ~ended & ~((F.size("rest") == taken) & (F.size("chain") > 0))})
        rows = stored(done.unionByName(moved.select(*done.columns)), "paths")
    return rows.withColumn("template", F.when(F.col("template") == "", F.lit("/")).otherwise(F.col("template"))).drop("rest", "open")


def purities(tree: DataFrame) -> DataFrame:
    """(host, template, purity) from (host, template, labelled, bad) of paths."""
    own = stored(tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), "rates")
    names = F.split("host", "[.]")
    last = lambda k: F.when(F.size(names) > k, F.array_join(F.slice(names, -k, k), ".")).otherwise(F.col("host"))
    wide = own.withColumns({"three": last(3), "two": last(2)})
    bad, all_ = own.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0))).first()
    base = (bad + 1.0) / (all_ + 2.0)
    odds = (F.sum("bad") + STRENGTH * base) / (F.sum("labelled") - F.sum("bad") + STRENGTH * (1 - base)) * ((1 - base) / base) * (PRIOR / (1 - PRIOR))
    top = own.groupBy("template").agg((odds / (1 + odds)).alias("p0"))
    smooth = lambda bad, all_, towards: (F.col(bad) + F.col(towards) * STRENGTH) / (F.col(all_) + STRENGTH)
    two = wide.groupBy("two", "template").agg(F.sum("labelled").alias("l2"), F.sum("bad").alias("b2")).join(top, "template").withColumn("p2", smooth("b2", "l2", "p0"))
    three = wide.groupBy("three", "two", "template").agg(F.sum("labelled").alias("l3"), F.sum("bad").alias("b3")).join(two, ["two", "template"])
    three = three.withColumn("p3", F.when(F.col("three") == F.col("two"), F.col("p2")).otherwise(smooth("b3", "l3", "p2")))
    host = wide.join(three.select("three", "template", "p3"), ["three", "template"])
    purity = F.when(F.col("host") == F.col("three"), F.col("p3")).otherwise(smooth("bad", "labelled", "p3"))
    return host.select("host", "template", purity.alias("purity"))


def judge(pages: DataFrame, rules: tuple = RULES, labels: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): (page_id, host, path, rule, verdict, template, purity).

    ``labels`` (page_id, bad 0/1) names labelled pages; without it the pages that
    a rule settles are the labelled ones. verdict is the rule's, else block where
    the template is rejected, else allow. Pages without a host share the empty
    host and path. Repeated rows count each; equal urls get equal verdicts. An
    empty table gives an empty one; other columns are not read.
    """
    rows = ruled(parsed(pages.select("page_id", "url")), rules)
    if labels is None:
        rows = rows.withColumn("label", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    else:
        one = labels.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").cast("int").alias("label"))
        rows = rows.join(one, "page_id", "left")
    counted = stored(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")), "counts")
    tree = templates(counted)
    known = _salted(tree.select("host", "path", "template"), purities(tree), ["host", "template"])
    # rows of a url that is met very often are spread over several tasks
    key = F.xxhash64("host", "path")
    hot = counted.where(F.col("n") > HOT).select(key.alias("_key"))
    parts = F.when(F.col("_maybe"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    known = maybe_in(known.withColumn("_key", key), "_key", hot).withColumn("_salt", F.explode(parts)).drop("_key", "_maybe")
    salt = F.when(F.col("_maybe"), F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")).otherwise(0)
    rows = maybe_in(rows.withColumn("_key", key), "_key", hot).withColumn("_salt", salt).drop("_key", "_maybe")
    said = F.coalesce("ruled", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return rows.join(known, ["host", "path", "_salt"]).select("page_id", "host", "path", "rule", said.alias("verdict"), "template", "purity")
