"""Mixing sources to target weights by subset-sum budget fitting.

Targets: the budget (a share of all words) is dealt by weight; a source stops at
``limit`` times its size and what it cannot use is dealt to the others by weight.
A source takes every document a whole number of times, and fits the rest of its
target as a subset sum: documents are counted by exact length, every length
first takes its even share, and a bounded knapsack over the last few documents'
words hits what remains. Which documents of a length are taken follows a seeded
hash, found by cumulative counts of hash buckets, so no group of equal lengths
is ranked as a whole.

What is shuffled is ids and counts; texts are never moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.session import stored

#: Weights by rank of the source in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE, LIMIT, SEED = 1.5, 2, 17
#: Documents of one length are taken by hash bucket; only one bucket of a length is ranked.
BUCKETS = 256
#: Words the knapsack table covers at least; it covers twice the longest text where that is more.
TABLE = 4096


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``: words between ASCII white space, 0 for a null text."""
    plain = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\t\n\u000b\f\r", "     ")
    return docs.withColumn("size", F.size(F.filter(F.split(plain, " "), lambda w: w != "")).cast("bigint"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) of every source; ``sizes`` has (source, size), a null source is one of its own, last.

    Sources are ranked by a range-partitioned sort: counts of the partitions,
    not the sources, are summed in order. The level of the deal falls out of
    repeated sums over the sources: each round takes out those that the last
    one would give more than they can use, until none is left above.
    """
    ranges = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    parts = stored(ranges.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    ranked = parts.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + within - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    deal = stored(ranked.select("source", "source_size", weight.alias("weight")), "weights")
    total = share * (deal.agg(F.sum("source_size")).first()[0] or 0)
    most = F.col("source_size") * float(limit)
    level, full = 0.0, -1
    while True:
        above = most <= F.col("weight") * level if full >= 0 else F.lit(False)
        used, free, count = deal.agg(
            F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)
        ).first()
        if not free or count == full:
            break
        level, full = (total - (used or 0.0)) / free, count
    return deal.select("source", "source_size", F.least(most, F.col("weight") * level).alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` as possible, never above.

    ``lengths`` are distinct and positive, ``counts`` how many there are. The
    even share of each length, longest first, carries its rounding along, so what
    remains is less than a few documents; that rest is solved exactly, with at
    most ``counts`` documents of each length, after handing back some of what the
    shares took so that the knapsack can choose.
    """
    take = np.zeros(len(lengths), np.int64)
    words = int((lengths * counts).sum())
    if not len(lengths) or budget <= 0:
        return take
    if budget >= words:
        return counts.astype(np.int64)
    unit = int(np.gcd.reduce(lengths))  # sums of the lengths are multiples of it
    lengths, budget, words = lengths // unit, budget // unit, words // unit
    order = np.argsort(-lengths, kind="stable")
    passed, used = 0, 0
    for i in order:
        passed += int(lengths[i] * counts[i])
        ideal = budget * passed // words
        take[i] = min(int(counts[i]), max(0, (ideal - used) // int(lengths[i])))
        used += int(take[i] * lengths[i])
    rest, room = budget - used, max(2 * int(lengths[order[0]]), TABLE)
    given = True
    while given and rest < room:  # hand back documents, shortest first, one of each length in turn, so that the knapsack can choose
        given = False
        for i in order[::-1]:
            if take[i] and rest + lengths[i] <= room:
                take[i] -= 1
                rest += int(lengths[i])
                given = True
    limit = rest
    reach, steps, full = 1, [], (1 << (limit + 1)) - 1  # bit w of reach: w words can be taken exactly
    for i in order:
        size = int(lengths[i])
        left, block = min(int(counts[i] - take[i]), limit // size), 1
        while left and reach >> limit == 0:
            n = min(block, left)
            left, block = left - n, block * 2
            steps.append((i, n, reach))
            reach |= (reach << (n * size)) & full
    at = reach.bit_length() - 1
    for i, n, earlier in reversed(steps):
        if not (earlier >> at) & 1:
            take[i] += n
            at -= n * int(lengths[i])
    return take


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): (doc_id, size, source, source_size, target, copies, taken).

    ``taken`` is ``copies`` times ``size``; copies never exceed ``limit``. A null
    source is a source of its own. Documents without words take no part (copies
    1 where their source takes every document, else 0, taken 0 either way). Rows
    that repeat a doc_id are counted and taken each by itself; equal rows may be
    exchanged for each other. The same rows give the same mix in every run.
    """
    rows = stored(sized(docs).select("doc_id", F.col("source").cast("string").alias("source"), "size", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)).alias("turn")), "sizes")
    targets = stored(source_targets(rows.select("source", "size"), weights, share, limit), "targets")
    whole = targets.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
    whole = whole.withColumn("rest", F.floor(F.col("target") - F.col("base") * F.col("source_size")).cast("bigint"))
    counts = rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    histogram = counts.join(whole.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "rest")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        take = fit_budget(part["size"].to_numpy(), part["n"].to_numpy(), int(part["rest"].iloc[0]))
        return part[["source", "size", "n"]].assign(take=take)

    # a group is one row per distinct length of a source: bounded by the longest text, not by the documents
    chosen = stored(histogram.groupBy("source").applyInPandas(fit, "source string, size bigint, n bigint, take bigint"), "lengths")
    some = chosen.where("take > 0 and take < n")
    bucket = F.shiftright("turn", 32).cast("int")
    assert BUCKETS == 1 << 8  # the top 8 of the 40 bits of turn
    partial = rows.join(some.select(F.col("source").alias("s"), F.col("size").alias("z"), "take"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    filled = partial.groupBy("source", "size", "take", bucket.alias("bucket")).agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("source", "size").orderBy("bucket"))
    edge = filled.withColumn("upto", upto).where("upto - m < take and take <= upto").select("source", "size", F.col("bucket").alias("last"), (F.col("take") - (F.col("upto") - F.col("m"))).alias("more"))
    edge = stored(edge, "edges")
    e = edge.select(F.col("source").alias("s"), F.col("size").alias("z"), "last", "more")
    inside = rows.withColumn("bucket", bucket).join(e, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    taken = inside.where("bucket < last").select("doc_id", "source", "size", F.lit(1).alias("extra"))
    at_edge = F.row_number().over(Window.partitionBy("source", "size").orderBy("turn", "doc_id"))
    ranked = inside.where("bucket = last").withColumn("k", at_edge).select("doc_id", "source", "size", (F.col("k") <= F.col("more")).cast("int").alias("extra"))
    beyond = inside.where("bucket > last").select("doc_id", "source", "size", F.lit(0).alias("extra"))
    even = chosen.where("take = 0 or take = n").select(F.col("source").alias("s"), F.col("size").alias("z"), (F.col("take") > 0).cast("int").alias("extra"))
    simple = rows.join(even, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).select("doc_id", "source", "size", "extra")
    none = rows.where("size = 0").select("doc_id", "source", "size", F.lit(0).alias("extra"))
    every = taken.unionByName(ranked).unionByName(beyond).unionByName(simple).unionByName(none)
    t = whole.select(F.col("source").alias("s"), "source_size", "target", "base")
    out = every.join(t, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", F.col("base") + F.col("extra"))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
