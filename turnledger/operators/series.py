"""Daily and hourly rollups, calendars, trailing statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnledger.functions import ratios
from turnledger.functions.money import usd_sum

SUMS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
COUNTS = ("turns", "interrupted_turns", *SUMS)


def measures() -> list[Column]:
    """Standard sums over turns; interrupted turns count but carry zero usage."""
    return [
        F.count(F.lit(1)).alias("turns"),
        F.count_if("is_interrupted").alias("interrupted_turns"),
        *[F.sum(c).alias(c) for c in SUMS],
        usd_sum(F.col("cost_units")).alias("cost_usd"),
    ]


def day(ts: str = "ts") -> Column:
    return F.to_date(F.col(ts))


def hour(ts: str = "ts") -> Column:
    return F.date_trunc("hour", F.col(ts))


def days_between(spark: SparkSession, since: str, until: str, name: str = "date") -> DataFrame:
    """Calendar of days; its size is the number of days asked for."""
    return spark.sql(f"select explode(sequence(date'{since}', date'{until}')) as {name}")


def hours_of_day(spark: SparkSession, date: str, name: str = "hour") -> DataFrame:
    return spark.sql(
        f"select explode(sequence(timestamp'{date} 00:00:00', timestamp'{date} 23:00:00', interval 1 hour)) as {name}"
    )


def filled(calendar: DataFrame, rollup: DataFrame, on: list[str]) -> DataFrame:
    """Calendar rows with the rollup's values, zero where it has none."""
    values = [c for c in rollup.columns if c not in on]
    joined = calendar.join(rollup, on, "left")
    return joined.select(*on, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in values])


def in_days(turns: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """Turns between two UTC days, both included, as a range on ts that reaches the scan."""
    if since is not None:
        turns = turns.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        end = str(dt.date.fromisoformat(until) + dt.timedelta(days=1))
        turns = turns.filter(F.col("ts") < F.lit(end).cast("timestamp"))
    return turns


def daily(turns: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """One row per UTC day; with both bounds every day between them is present."""
    rollup = in_days(turns, since, until).groupBy(day().alias("date")).agg(*measures())
    if since is None or until is None:
        return rollup
    return filled(days_between(turns.sparkSession, since, until), rollup, ["date"])


def hourly(turns: DataFrame, date: str | None = None, fill: bool = False) -> DataFrame:
    rollup = in_days(turns, date, date).groupBy(hour().alias("hour")).agg(*measures())
    if not (fill and date):
        return rollup
    return filled(hours_of_day(turns.sparkSession, date), rollup, ["hour"])


def efficiency_series(rollup: DataFrame, by: str = "date") -> DataFrame:
    """Daily rows with the four ratios, starting at the first active day."""
    first = F.min(F.when(F.col("turns") > 0, F.col(by))).over(Window.partitionBy())
    return (
        rollup.withColumn("first_active", first)
        .filter(F.col(by) >= F.col("first_active"))
        .select(by, "cost_usd", "output_tokens", "turns", *[c.alias(n) for n, c in ratios.efficiency().items()])
    )


def moving_average(series: DataFrame, value: str, by: str = "date", rows: int = 7) -> DataFrame:
    """Mean of the last ``rows`` rows, NULLs skipped. For calendar-sized input only."""
    frame = Window.partitionBy().orderBy(by).rowsBetween(1 - rows, 0)
    return series.select(by, F.avg(value).over(frame).alias("value"))


def trailing(series: DataFrame, value: str, today: str, days: int, by: str = "date") -> DataFrame:
    """Median and sample deviation over the ``days - 1`` days before ``today``, guarded against short history."""
    start = str(dt.date.fromisoformat(today) - dt.timedelta(days=days))
    span = series.filter((F.col(by) > F.lit(start).cast("date")) & (F.col(by) < F.lit(today).cast("date")))
    positive, present = F.col(value) > 0, F.col(value) >= 0
    return span.agg(
        F.when(F.count_if(positive) >= max(3, days // 3), F.median(F.when(positive, F.col(value)))).alias("median"),
        F.when(F.count_if(present) >= 4, F.stddev_samp(F.when(present, F.col(value)))).alias("stddev"),
    )


def baselines(series: DataFrame, names: list[str], today: str, by: str = "date") -> DataFrame:
    """Per metric: median of the last 7 (else 3) non-zero days before ``today``, and how it was found."""
    long = series.filter(F.col(by) < F.lit(today).cast("date")).select(
        by, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")
    ).select(by, "m.*").filter("value > 0")
    newest = Window.partitionBy("metric").orderBy(F.desc(by))
    ranked = long.withColumn("rank", F.row_number().over(newest))
    metrics = series.sparkSession.sql("select explode(array(" + ",".join(f"'{n}'" for n in names) + ")) as metric")
    counted = ranked.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.median(F.when(F.col("rank") <= 7, F.col("value"))).alias("week"),
        F.median(F.when(F.col("rank") <= 3, F.col("value"))).alias("short"),
    )
    n = F.coalesce("n", F.lit(0))
    return metrics.join(counted, "metric", "left").select(
        "metric",
        F.when(n >= 7, F.col("week")).when(n >= 3, F.col("short")).alias("baseline"),
        F.when(n >= 7, "7d").when(n >= 3, "3d").otherwise("cold").alias("baseline_label"),
    )


def range_start(name: str, today: str) -> str | None:
    """First day of a named range; None for all time. Days per range."""
    days = {"today": 0, "1d": 0, "7d": 6, "14d": 13, "30d": 29, "90d": 89}
    if name not in days:
        return None
    return str(dt.date.fromisoformat(today) - dt.timedelta(days=days[name]))


def effective_range(turns: DataFrame, name: str, today: str) -> DataFrame:
    """Whether history covers the range: effective start, days at hand, and a flag for the fallback."""
    since = range_start(name, today)
    found = turns.agg(F.min("ts").alias("first")).select(F.to_date("first").alias("earliest"))
    wanted = F.lit(since).cast("date")
    have = F.datediff(F.lit(today).cast("date"), F.col("earliest")) + 1
    short = F.coalesce(F.col("earliest") > wanted, F.lit(False))
    return found.select(
        "earliest",
        F.when(short, F.col("earliest")).otherwise(F.coalesce(wanted, F.col("earliest"))).alias("since"),
        have.alias("have_days"),
        short.alias("fallback"),
    )
