"""Registry of runnable queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from turnledger.catalog import shapes
from turnledger.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text and integers as BIGINT, so that both engines hand over the same values."""

    def cast(field):
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.col(field.name).cast("string").alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return F.col(field.name).cast("bigint").alias(field.name)
        return F.col(field.name)

    return df.select([cast(f) for f in df.schema])


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round values whose last bits depend on the order of a floating-point sum.

    The nudge decides exact halves the same way in both engines.
    """
    return df.withColumns({c: F.round(F.col(c) + 10.0 ** -(digits + 3), digits) for c in columns})


def nudged(sql: str) -> str:
    """Give every ``round(expression, digits)`` of an oracle the nudge of ``rounded``."""
    out, at = [], 0
    for found in re.finditer(r"(?<![a-z_])round\(", sql):
        depth, end = 1, found.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        digits = re.search(r", (\d+)\)$", sql[found.end() : end])
        if digits:
            cut = end - len(digits.group(0))
            out += [sql[at:cut], f" + 1e-{int(digits.group(1)) + 3}::double"]
            at = cut
    return "".join(out) + sql[at:]


def query(name: str, sql: str | None = None, prelude: str = shapes.ORACLE_TURNS):
    """Register ``build(tables) -> DataFrame`` under ``name``; ``sql`` may use the prelude's CTEs."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain(build(shapes.Tables(configure(spark), sf_dir)))

        run.origin = build.__module__.rsplit(".", 1)[-1]
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = nudged(prelude + sql)
        return build

    return register
