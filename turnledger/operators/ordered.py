"""Ordered computations that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(...)`` puts a whole key into one task.
Here each key is cut into chunks (an hour of a session, a run of lines of a
file); the window runs per (key, chunk), one summary row per chunk carries the
state over, and the carry joins back on (key, chunk), the partitioning the
window already has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

LINES_PER_CHUNK = 8192
FANOUT = 1024
_FIRST, _ALL = Window.unboundedPreceding, Window.unboundedFollowing


def line_chunk(line: str = "line", size: int = LINES_PER_CHUNK) -> Column:
    return F.floor(F.col(line) / size)


def time_chunk(ts: str = "ts") -> Column:
    return F.floor(F.unix_timestamp(F.col(ts)) / 3600)


def _local(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return F.sum(value) if kind == "sum" else F.max(value)


def _total(kind: str, value: Column, order: list[str]) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    return _local(kind, value)


def _merge(kind: str, local: Column, carry: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, carry)
    if kind == "max":
        return F.greatest(local, carry)
    return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: str,
    values: dict[str, tuple[str, Column]],
    inclusive: bool = False,
    carry: bool = True,
    summary: DataFrame | None = None,
) -> DataFrame:
    """Running sum, max or last non-null value over all earlier rows of the key.

    ``values`` maps an output name to (kind, column). ``order`` must be unique
    within a key, ``chunk`` must not decrease along it, keys must not be NULL.
    ``carry=False`` is for callers that have checked that every key has one chunk.
    ``summary`` may replace ``df`` in the per-chunk totals when the other rows add
    nothing; it needs a row for every (key, chunk) whose rows use the carry.
    """
    by = [*keys, chunk]
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(_FIRST, 0 if inclusive else -1)
    local = df.withColumns({f"__local_{n}": _local(kind, c).over(frame) for n, (kind, c) in values.items()})
    if not carry:
        zero = {n: F.lit(0) if kind == "sum" else F.lit(None) for n, (kind, _c) in values.items()}
        alone = {n: F.coalesce(F.col(f"__local_{n}"), zero[n]) for n in values}
        return local.withColumns(alone).drop(*[f"__local_{n}" for n in values])
    totals = (df if summary is None else summary).groupBy(*by).agg(*[_total(kind, c, order).alias(n) for n, (kind, c) in values.items()])
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(_FIRST, -1)
    carried = totals.select(
        *by, *[_local(kind, F.col(n)).over(before).alias(f"__carry_{n}") for n, (kind, _c) in values.items()]
    )
    out = local.join(carried, by, "left")
    merged = {n: _merge(kind, F.col(f"__local_{n}"), F.col(f"__carry_{n}")) for n, (kind, _c) in values.items()}
    return out.withColumns(merged).drop(*[f"__{part}_{n}" for n in values for part in ("local", "carry")])


def with_position(
    df: DataFrame, keys: list[str], order: list[str], chunk: str, name: str, counted: Column | None = None
) -> DataFrame:
    """0-based position of each row in its key; only ``counted`` rows advance it."""
    step = F.lit(1) if counted is None else counted.cast("int")
    return scan(df, keys, order, chunk, {name: ("sum", step)}).withColumn(name, F.col(name).cast("bigint"))


def neighbourhoods(df: DataFrame, keys: list[str], position: str, before: int, after: int, size: int = 4096):
    """Copy rows near a block edge into the next block so bounded frames never leave a block.

    Returns the blocked rows (extra columns ``block`` and ``core``) and a window
    over them; frames may reach ``before`` rows back and ``after`` rows ahead.
    Results are valid on ``core`` rows only.
    """
    own = F.floor(F.col(position) / size)
    offset = F.col(position) % size
    copies = F.array_compact(
        F.array(
            own,
            F.when((offset < after) & (own > 0), own - 1),
            F.when(offset >= size - before, own + 1),
        )
    )
    blocked = df.withColumn("block", F.explode(copies)).withColumn("core", F.col("block") == own)
    return blocked, Window.partitionBy(*keys, "block").orderBy(position)


def walk(items: str, label: str, state_type: str, apply: Callable[[str, str], str], initial: str) -> Column:
    """Array of (label, entry state) from a sorted array of struct(label, fn)."""
    pairs = f"array<struct<{label}:bigint,entry:{state_type}>>"
    start = f"named_struct('state', {initial}, 'seen', cast(array() as {pairs}))"
    step = (
        f"named_struct('state', {apply('x.fn', 'acc.state')}, 'seen', "
        f"array_append(acc.seen, named_struct('{label}', x.{label}, 'entry', acc.state)))"
    )
    return F.expr(f"aggregate({items}, {start}, (acc, x) -> {step}, acc -> acc.seen)")


def block_entries(
    blocks: DataFrame,
    keys: list[str],
    apply: Callable[[str, str], str],
    compose: Callable[[str, str], str],
    initial: str,
    state_type: str = "bigint",
    fanout: int = FANOUT,
    last_block: int | None = None,
) -> DataFrame:
    """State on entry to every block of a sequential fold, without walking a key row by row.

    ``blocks`` has one row per (keys, block) with the block's transfer function
    in ``fn``. Runs of ``fanout`` blocks are composed first, the short chain of
    runs is walked per key, then each run is walked from its own entry state,
    so no array exceeds ``fanout`` entries or one entry per run. A caller that
    knows the largest block number passes it: up to ``fanout`` blocks per key
    are walked directly.
    """
    if last_block is not None and last_block < fanout:
        items = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "fn"))).alias("items"))
        return items.select(*keys, F.explode(walk("items", "block", state_type, apply, initial)).alias("at")).select(
            *keys, "at.block", "at.entry"
        )
    runs = blocks.groupBy(*keys, F.floor(F.col("block") / fanout).alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("block", "fn"))).alias("items")
    )
    composed = F.expr(
        "aggregate(slice(items, 2, size(items)), items[0].fn, (f, x) -> " + compose("f", "x.fn") + ")"
    )
    chains = (
        runs.select(*keys, F.struct(F.col("run"), composed.alias("fn")).alias("link"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("link")).alias("chain"))
        .select(*keys, F.explode(walk("chain", "run", state_type, apply, initial)).alias("at"))
        .select(*keys, "at.run", F.col("at.entry").alias("entry"))
    )
    return (
        runs.join(chains, [*keys, "run"])
        .select(*keys, F.explode(walk("items", "block", state_type, apply, "entry")).alias("at"))
        .select(*keys, "at.block", "at.entry")
    )


def pick_disjoint(
    spans: DataFrame, keys: list[str], reach: int, size: int = 4096, fanout: int = FANOUT
) -> DataFrame:
    """Greedy left-to-right choice of non-overlapping spans per key.

    ``spans`` has BIGINT columns ``first`` and ``last`` with last - first <= reach
    and at most one span per first. A span is kept when it starts after the last
    kept one ended. Since a span reaches at most ``reach`` positions into the
    next block, a block is a function of reach + 2 possible entry offsets.
    """
    if size <= reach + 1:
        raise ValueError("block size must exceed the span reach")
    blocks = (
        spans.groupBy(*keys, F.floor(F.col("first") / size).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))
    )
    exits = (
        f"transform(sequence(0, {reach + 1}), e -> aggregate(spans, block * {size} + e, "
        "(free, x) -> if(x.first >= free, x.last + 1, free)))"
    )
    functions = blocks.select(
        *keys, "block", F.expr(f"named_struct('base', block * {size}, 'exits', {exits})").alias("fn")
    )

    def apply(fn: str, state: str) -> str:
        return f"element_at({fn}.exits, cast(least(greatest({state} - {fn}.base, 0), {reach + 1}) as int) + 1)"

    def compose(f: str, g: str) -> str:
        return f"named_struct('base', {f}.base, 'exits', transform({f}.exits, s -> {apply(g, 's')}))"

    entries = block_entries(functions, keys, apply, compose, "0L", fanout=fanout)
    kept = F.expr(
        "aggregate(spans, named_struct('free', entry, 'kept', cast(array() as array<bigint>)), "
        "(acc, x) -> if(x.first >= acc.free, named_struct('free', x.last + 1, 'kept', array_append(acc.kept, x.first)), acc), "
        "acc -> acc.kept)"
    )
    chosen = blocks.join(entries, [*keys, "block"]).select(*keys, F.explode(kept).alias("first"))
    return spans.join(chosen, [*keys, "first"])
