"""Spark helpers of the operators: membership filters of bounded size, components, shared intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.session import stored

#: log2 of the slots of a membership filter; its table holds 2^(FILTER_BITS - 6) rows at most (2 MB for 23).
FILTER_BITS = 23


def slots(key: Column, bits: int = FILTER_BITS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def filter_table(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """A bitmap of the hashed keys: (word, bits), never more than 2^(bits - 6) rows however many keys there are."""
    slot = keys.where(F.col(column).isNotNull()).select(slots(F.col(column), bits).alias("_slot"))
    one = F.expr("shiftleft(1L, cast(pmod(_slot, 64) as int))")
    return slot.groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.bit_or(one).alias("_bits"))


def maybe_in(df: DataFrame, column: str, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with ``_maybe``: false only where the column's value is certainly not among the keys.

    The broadcast bitmap has a size that the number of keys cannot raise; more
    keys only let more rows through to the exact join that follows.
    """
    slot = slots(F.col(column), bits)
    table = filter_table(keys, column, bits)
    joined = df.withColumn("_slot", slot).join(F.broadcast(table), F.shiftright("_slot", 6) == F.col("_word"), "left")
    bit = F.expr("shiftright(_bits, cast(pmod(_slot, 64) as int)) & 1")
    return joined.withColumn("_maybe", F.coalesce(bit == 1, F.lit(False))).drop("_slot", "_word", "_bits")


def packed(df: DataFrame) -> DataFrame:
    """``df`` as one column ``row``, so that helper columns cannot clash with its own."""
    return df.select(F.struct("*").alias("row"))


def without(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose value is not among the keys; only rows that may be among them are shuffled."""
    keys = keys.select(F.col(column).alias("key"))
    marked = maybe_in(packed(df).withColumn("key", F.col("row")[column]), "key", keys)
    sure = marked.where(~F.col("_maybe")).select("row")
    return sure.union(marked.where("_maybe").join(keys, "key", "left_anti").select("row")).select("row.*")


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b) of BIGINT: (node, root), root the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each node
    is linked to the smallest node it sees until the edges no longer change.
    Every step groups by node with map-side minima; each round is written to the
    shared folder, so that its lineage ends there.
    """
    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, name)
    before = mark(e)
    while before[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(small.union(least).distinct(), name)
        after = mark(e)
        if tuple(after) == tuple(before):
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
