"""Ranking with a collapsed tail."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def head_and_other(
    df: DataFrame,
    name: str,
    value: str,
    top: int,
    other: str = "other",
    extra: tuple[str, ...] = (),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The ``top`` largest rows, and one row that sums the rest (with how many it holds).

    ``extra`` columns are summed too, ``keep`` columns stay on the head only. Ties break by name. The head is a take-ordered limit, the tail one
    aggregate over the rows that do not match the ``top`` names, so no task
    sorts all names.
    """
    head = df.orderBy(F.desc(value), F.asc(name)).limit(top)
    tail = df.join(F.broadcast(head.select(name)), name, "left_anti")
    rest = tail.agg(
        F.sum(value).alias(value), *[F.sum(c).alias(c) for c in extra], F.count(F.lit(1)).alias("members")
    ).filter("members > 0")
    blank = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in keep]
    return head.select(name, value, *extra, *keep, F.lit(None).cast("bigint").alias("members")).unionByName(
        rest.select(F.lit(other).alias(name), value, *extra, *blank, "members")
    )


def top_rows(df: DataFrame, value: str, top: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.desc(value), *[F.asc(c) for c in ties]).limit(top)


def keep_if_few(df: DataFrame, name: str, value: str, order: str, limit: int = 6) -> DataFrame:
    """Up to ``limit`` members stay as they are; more become ``limit - 1`` and ``others``.

    Membership follows ``order`` while ``value`` is what gets summed. For rows
    already reduced to one per model, a short list.
    """
    every = Window.partitionBy()
    ranked = df.select(
        name, value,
        F.row_number().over(every.orderBy(F.desc(order), F.asc(name))).alias("rank"),
        F.count(F.lit(1)).over(every).alias("members"),
    )
    label = F.when((F.col("members") <= limit) | (F.col("rank") < limit), F.col(name)).otherwise("others")
    return ranked.groupBy(label.alias(name)).agg(F.sum(value).alias(value))


def beside(*totals: DataFrame) -> DataFrame:
    """Columns of several one-row totals in one row, without a join."""
    rows = totals[0]
    for other in totals[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
