"""The central fact table: priced, deduplicated turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnledger import constants as K
from turnledger.functions import pricing
from turnledger.operators import dedup

TOKENS = [
    "input_tokens",
    "output_tokens",
    "cache_read_tokens",
    "cache_creation_tokens",
    "cache_creation_1h_tokens",
]


def responses(raw: DataFrame) -> DataFrame:
    """Assistant responses without the synthetic markers; a NULL model survives."""
    return raw.filter(~F.col("model").eqNullSafe(K.SYNTHETIC_MODEL))


def build_turns(raw: DataFrame) -> DataFrame:
    """Deduplicate (last wins), zero the usage of interrupted turns, price, tag."""
    turns = dedup.keep_last(responses(raw), "dedup_key", dedup.PLACE)
    return price_turns(turns)


def price_turns(turns: DataFrame) -> DataFrame:
    clean = turns.withColumns(
        {c: F.when(F.col("is_interrupted"), F.lit(0)).otherwise(F.coalesce(F.col(c), F.lit(0))).cast("bigint") for c in TOKENS}
    )
    tagged = clean.withColumn(
        "tags",
        dedup.assumption_tags(F.col("dedup_key"), F.col("is_interrupted"), pricing.price_tag(F.col("model"))),
    )
    return pricing.with_costs(tagged)


def tag_counts(turns: DataFrame, window_calls: int = 0) -> DataFrame:
    """How often each assumption fired; the window heuristic counts once per window call."""
    spark = turns.sparkSession
    names = spark.sql("select explode(array(" + ",".join(f"'{t}'" for t in K.TAGS) + ")) as tag")
    fired = turns.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    count = F.coalesce("n", F.lit(0)) + F.when(F.col("tag") == K.TAG_WINDOW, window_calls).otherwise(0)
    return names.join(fired, "tag", "left").select("tag", count.cast("bigint").alias("fired"))


def assert_no_assumptions(turns: DataFrame) -> DataFrame:
    """The strict form of a report: the job fails as soon as a turn carries an assumption."""
    clean = F.assert_true(F.size("tags") == 0, F.lit("assumptions fired in strict mode")).isNull()
    return turns.filter(clean)
