"""Check the total cost against totals reported elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnledger.functions.money import usd_sum
from turnledger.operators import topk

TOLERANCE = 0.02


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """JSON totals: a list of rows, or one object, with ``cost`` or ``totalCost``."""
    return spark.read.schema("cost double, totalCost double").option("multiLine", True).json(path)


def compare(turns: DataFrame, totals: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Our total, theirs, the fractional difference and OK or FAIL.

    A row's cost is ``cost`` unless that is missing or zero, then ``totalCost``.
    Amounts are summed in exact units.
    """
    columns = [F.nullif(F.col(c), F.lit(0.0)) for c in ("cost", "totalCost") if c in totals.columns]
    amount = F.coalesce(*columns, F.lit(0.0))
    theirs = totals.agg(usd_sum(F.round(amount * 1e10).cast("bigint")).alias("theirs"))
    ours = turns.agg(usd_sum(F.col("cost_units")).alias("ours"))
    diff = F.abs(F.col("ours") - F.col("theirs")) / F.greatest("theirs", F.lit(1e-9))
    return (
        topk.beside(ours, theirs)
        .withColumn("diff", diff)
        .withColumn("status", F.when(F.col("diff") <= tolerance, "OK").otherwise("FAIL"))
    )
