"""Snippets and string scoring."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def snippet(text: Column, size: int = 500) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("…"))).otherwise(text)


def match_score(target: Column, wanted: str) -> Column:
    """1.0 for a prefix, 0.7 for a substring, else 0."""
    if not wanted:
        return F.lit(0.0)
    return (
        F.when(F.startswith(target, F.lit(wanted)), F.lit(1.0))
        .when(F.contains(target, F.lit(wanted)), F.lit(0.7))
        .otherwise(F.lit(0.0))
    )


def stop_reason(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown"))
