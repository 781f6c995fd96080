"""Which tool caused which part of a turn's cost.

Input side: share of the bytes a tool holds in the context before the turn.
Output side: share of the tool's bytes in the turn's own content. State is per
file and starts anew at each compaction. Files of up to WHOLE chunks of lines are
shuffled once, on the file, and split by windows within it. The steps of longer
files shuffle on (file, chunk of lines), so one huge file spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnledger import constants as K
from turnledger.functions.money import usd
from turnledger.operators import ordered
from turnledger.session import stored

_CLASSES = "array<struct<lo:bigint,peak:bigint>>"
_NO_LIMIT = "9223372036854775807L"
#: A file of up to so many chunks of lines is one group of one task.
WHOLE = 8
_AT_TURN = ["file", "line"]
_BILL = ["pool", "output_tokens", "input_units", "output_units", "cache_read_units", "cache_creation_units"]


def real_tool(name: Column) -> Column:
    """A usable tool name: not empty and none of the reserved words."""
    return F.coalesce((name != "") & ~name.isin(K.UNATTRIBUTED_TOOL, K.UNKNOWN_TOOL, K.OTHER), F.lit(False))


def real_skill(name: Column) -> Column:
    return F.coalesce((name != "") & (name != K.OTHER), F.lit(False))


# A block of lines as a function of the running peak p on entry:
#   p < ub             no compaction inside, the peak leaves as max(p, top)
#   p >= ub            the peak of the last class whose lo <= p
# Once a compaction happened the peak no longer depends on p, so the classes stay few.


def _merged(classes: str) -> str:
    return f"filter({classes}, (c, i) -> i = 0 or c.peak <> {classes}[i - 1].peak)"


def _peak_step(acc: str, pool: str) -> str:
    reset = f"{K.COMPACTION_FACTOR} * {pool}"
    kept = (
        f"transform({acc}.classes, c -> named_struct('lo', c.lo, 'peak', "
        f"if({reset} < c.peak, {pool}, greatest(c.peak, {pool}))))"
    )
    lowest = f"if({reset} < {acc}.top, 0L, {reset} + 1)"
    opened = (
        f"if({lowest} < {acc}.ub, array_prepend({kept}, named_struct('lo', {lowest}, 'peak', {pool})), {kept})"
    )
    return (
        f"named_struct('ub', least({acc}.ub, {lowest}), 'top', greatest({acc}.top, {pool}), 'classes', {opened})"
    )


def _peak_apply(fn: str, p: str) -> str:
    return (
        f"if({p} < {fn}.ub, greatest({p}, {fn}.top), "
        f"element_at(filter({fn}.classes, c -> c.lo <= {p}), -1).peak)"
    )


def _peak_compose(f: str, g: str) -> str:
    crosses = f"({f}.ub > 0 and {f}.top >= {g}.ub)"
    moved = f"transform({f}.classes, k -> named_struct('lo', k.lo, 'peak', {_peak_apply(g, 'k.peak')}))"
    above = f"filter({g}.classes, k -> k.lo < {f}.ub and (k.lo > {f}.top or not {crosses}))"
    bottom = (
        f"if({crosses}, array(named_struct('lo', 0L, 'peak', {_peak_apply(g, f + '.top')})), "
        f"cast(array() as {_CLASSES}))"
    )
    return (
        f"named_struct('ub', if({crosses}, 0L, least({f}.ub, {g}.ub)), 'top', greatest({f}.top, {g}.top), "
        f"'classes', concat({bottom}, {above}, {moved}))"
    )


def _pools() -> Column:
    return F.sort_array(F.collect_list(F.when(F.col("pool").isNotNull(), F.struct("line", "pool")))).alias("pools")


def _resets(entry: str) -> Column:
    """Lines of sorted ``pools`` that start a new epoch, from the running peak before them."""
    return F.expr(
        f"aggregate(pools, named_struct('peak', {entry}, 'at', cast(array() as array<bigint>)), (acc, x) -> "
        f"if({K.COMPACTION_FACTOR} * x.pool < acc.peak, "
        "named_struct('peak', x.pool, 'at', array_append(acc.at, x.line)), "
        "named_struct('peak', greatest(acc.peak, x.pool), 'at', acc.at)), acc -> acc.at)"
    )


def compaction_epochs(
    lines: DataFrame, size: int = ordered.LINES_PER_CHUNK, fanout: int = ordered.FANOUT
) -> DataFrame:
    """Per (file, block of lines): lines that start a new epoch, and epochs before the block.

    ``lines`` has file, line, pool for every line; pool is the input-side token
    count of assistant lines with usage, else NULL.
    """
    blocks = lines.groupBy("file", ordered.line_chunk(size=size).alias("block")).agg(_pools())
    start = f"named_struct('ub', {_NO_LIMIT}, 'top', 0L, 'classes', cast(array() as {_CLASSES}))"
    fold = f"aggregate(pools, {start}, (acc, x) -> {_peak_step('acc', 'x.pool')})"
    thin = (
        f"transform(array({fold}), f -> named_struct('ub', f.ub, 'top', f.top, "
        f"'classes', {_merged('f.classes')}))[0]"
    )
    functions = blocks.select("file", "block", F.expr(thin).alias("fn"))
    entries = ordered.block_entries(functions, ["file"], _peak_apply, _peak_compose, "0L", fanout=fanout)
    entered = blocks.join(entries, ["file", "block"])
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = entered.select("file", "block", _resets("entry").alias("resets"))
    return found.withColumn("before", F.coalesce(F.sum(F.size("resets")).over(earlier), F.lit(0)).cast("bigint"))


def with_epoch(df: DataFrame, epochs: DataFrame, size: int = ordered.LINES_PER_CHUNK) -> DataFrame:
    """Epoch of each line: the number of compactions at or before it."""
    return (
        df.withColumn("block", ordered.line_chunk(size=size))
        .join(epochs, ["file", "block"])
        .withColumn(
            "epoch", F.col("before") + F.size(F.filter("resets", lambda at: at <= F.col("line")))
        )
        .drop("resets", "before")
    )


def reference() -> tuple[Column, Column]:
    """(whether a block calls a tool by a usable name and id, the id a block declares or refers to)."""
    use = (F.col("kind") == "tool_use") & real_tool(F.col("name")) & F.coalesce(F.col("block_id") != "", F.lit(False))
    return use, F.when(use, F.col("block_id")).when(F.col("kind") == "tool_result", F.nullif(F.col("tool_use_id"), F.lit("")))


def match_results(blocks: DataFrame, carry: bool = True) -> DataFrame:
    """Owner of each content block in the context: a tool, unknown, or NULL for plain content.

    A result belongs to the tool use that is the previous mention of its id in
    the same file and epoch; a second result for the same id finds nothing.
    ``carry`` as in ``ordered.scan``.
    """
    use, ref = reference()
    result = F.col("kind") == "tool_result"
    # Rows without an id ride along under the empty id, so the rows are shuffled once.
    marked = blocks.withColumn("ref", F.coalesce(ref, F.lit(""))).withColumn("declared", F.when(use, F.col("name")))
    linked = ordered.scan(
        marked,
        ["file", "epoch", "ref"],
        ["line", "pos"],
        "block",
        {"previous": ("last", F.when(F.col("ref") != "", F.struct("declared")))},
        carry=carry,
        summary=marked.filter(F.col("ref") != ""),
    )
    owner = F.when(result, F.coalesce("previous.declared", F.lit(K.UNKNOWN_TOOL))).otherwise(F.col("declared"))
    return linked.withColumn("owner", owner).drop("previous", "ref", "declared")


def owned_content(
    lines: DataFrame, blocks: DataFrame, size: int = ordered.LINES_PER_CHUNK, fanout: int = ordered.FANOUT
) -> DataFrame:
    """Content blocks with epoch and owner, and one marker row (kind ``turn``) per billed line.

    ``block`` is the chunk of lines of a long file, NULL in the others. ``lines``
    may have ``bill`` (see ``billed``), which the markers keep.
    """
    whole, cut = _owned(lines, blocks, size, fanout)
    return stored(whole if cut is None else whole.unionByName(cut), "owned")


def billed(lines: DataFrame) -> DataFrame:
    """The lines with what the split reads of a billed one as ``bill``."""
    return lines.withColumn("bill", F.when(F.col("pool").isNotNull(), F.struct(*_BILL)))


def _owned(lines: DataFrame, blocks: DataFrame, size: int, fanout: int) -> tuple[DataFrame, DataFrame | None]:
    """The content of files of up to WHOLE chunks, and that of longer files if there are any."""
    marks = lines.filter(F.col("pool").isNotNull()).select(
        "file", "line", F.lit(-1).cast("bigint").alias("pos"), F.lit("turn").alias("kind"),
        F.lit(0).cast("bigint").alias("nbytes"), "pool", *[c for c in ("bill",) if c in lines.columns],
    )
    content = blocks.unionByName(marks, allowMissingColumns=True)
    long = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WHOLE * size).select("file")
    if long.isEmpty():
        return _owned_whole(lines, content), None
    long = stored(long, "long-files")

    def some(df: DataFrame, how: str) -> DataFrame:
        return df.join(long, "file", how)

    pools = some(lines.select("file", "line", "pool"), "left_semi")
    placed = with_epoch(some(content, "left_semi"), compaction_epochs(pools, size, fanout), size)
    whole = _owned_whole(some(lines, "left_anti"), some(content, "left_anti"))
    return whole, match_results(placed).select(*whole.columns)


def _owned_whole(lines: DataFrame, content: DataFrame) -> DataFrame:
    """Epochs and owners by windows within the file."""
    none = F.lit(None).cast("bigint")
    files = lines.groupBy("file").agg(_pools()).select("file", _resets("0L").alias("resets"))
    # One row before all lines opens the first epoch of a file, one more each later epoch.
    opened = F.concat(F.array(F.struct(none.alias("line"), F.lit(0).alias("step"))), F.transform("resets", lambda at: F.struct(at.alias("line"), F.lit(1).alias("step"))))
    opens = files.select("file", F.explode(opened).alias("at")).select("file", "at.line", F.lit(-2).cast("bigint").alias("pos"), "at.step")
    so_far = Window.partitionBy("file").orderBy("line", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = content.unionByName(opens, allowMissingColumns=True).withColumn("epoch", F.sum("step").over(so_far))
    placed = placed.filter(F.col("step").isNull() & F.col("epoch").isNotNull()).drop("step").withColumn("block", none)
    return match_results(placed, carry=False)


def held_whole(owned: DataFrame) -> DataFrame:
    """For content of whole files: the rows of each turn, one per tool in its context and one without a tool
    for plain content, with the bytes ``held`` before it; and the content itself, with its ``owner`` as ``tool``."""
    before = Window.partitionBy("file", "epoch").orderBy("line", "pos").rowsBetween(Window.unboundedPreceding, -1)
    # The marker of a turn sorts before the content of its line, so everything
    # earlier than the marker is what the turn could see.
    seen = owned.withColumn("seen", F.collect_set("owner").over(before))
    tools = F.when(F.col("kind") == "turn", F.concat("seen", F.array(F.lit(None).cast("string")))).otherwise(F.array("owner"))
    earlier = Window.partitionBy("file", "epoch", "tool").orderBy("line", "pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = seen.withColumn("tool", F.explode(tools)).drop("seen")
    return rows.withColumn("held", F.coalesce(F.sum("nbytes").over(earlier), F.lit(0)))


def tool_bytes(owned: DataFrame) -> DataFrame:
    """Bytes each tool holds in the context before each turn: file, line, tool, tool_nbytes."""
    rows = held_whole(owned.filter(F.col("block").isNull())).filter((F.col("kind") == "turn") & F.col("tool").isNotNull())
    held = rows.select("file", "line", "tool", F.col("held").alias("tool_nbytes"))
    cut = owned.filter(F.col("block").isNotNull())
    return held if cut.isEmpty() else held.unionByName(context_bytes(cut)[1])


def context_bytes(owned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the context holds before each turn of files cut into chunks: totals per turn, and bytes per (turn, tool)."""
    is_turn = F.col("kind") == "turn"
    tool_nbytes = F.when(F.col("owner").isNotNull(), F.col("nbytes")).otherwise(0)
    # The marker of a turn sorts before the content of its line, so everything
    # earlier than the marker is what the turn could see.
    totals = (
        ordered.scan(
            owned.select("file", "epoch", "block", "line", "pos", "kind", "nbytes", "owner"),
            ["file", "epoch"],
            ["line", "pos"],
            "block",
            {"context_nbytes": ("sum", F.col("nbytes")), "context_tool_nbytes": ("sum", tool_nbytes)},
        )
        .filter(is_turn)
        .select("file", "epoch", "block", "line", "context_nbytes", "context_tool_nbytes")
    )

    deltas = owned.filter(F.col("owner").isNotNull()).select(
        "file", "epoch", "block", "line", F.col("owner").alias("tool"), "nbytes", F.lit(1).alias("step")
    )
    tools = deltas.groupBy("file", "epoch", "tool").agg(F.min("line").alias("first_line"))
    turns = owned.filter(is_turn).select("file", "epoch", "block", "line")
    # Tools go to the blocks of lines first, so the join with the turns is
    # on (file, epoch, block) and never on a whole file.
    near = turns.select("file", "epoch", "block").distinct().join(tools, ["file", "epoch"])
    paired = turns.join(near, ["file", "epoch", "block"])
    present = near.select("file", "epoch", "block", "tool", F.lit(0).cast("bigint").alias("nbytes"))
    summary = deltas.select(*present.columns).unionByName(present)
    probes = paired.filter(F.col("line") > F.col("first_line")).select(
        "file", "epoch", "block", "line", "tool", F.lit(0).cast("bigint").alias("nbytes"), F.lit(0).alias("step")
    )
    held = (
        ordered.scan(
            deltas.unionByName(probes),
            ["file", "epoch", "tool"],
            ["line", "step"],
            "block",
            {"held": ("sum", F.col("nbytes"))},
            summary=summary,
        )
        .filter("step = 0")
        .select("file", "line", "tool", F.col("held").alias("tool_nbytes"))
    )
    return totals, held


def attribute(
    lines: DataFrame, blocks: DataFrame, size: int = ordered.LINES_PER_CHUNK, fanout: int = ordered.FANOUT
) -> tuple[DataFrame, DataFrame]:
    """Split every turn's cost.

    ``lines``: file, line, pool, input_tokens, output_tokens, input_units,
    output_units, cache_read_units, cache_creation_units (pool NULL off turns).
    ``blocks``: file, line, pos, kind, name, block_id, tool_use_id, nbytes.
    Returns (per turn and tool, rest per turn), both keyed by (file, line).
    """
    lines = usage(lines)
    whole, cut = _owned(billed(lines), blocks, size, fanout)
    return _split(whole, None if cut is None else stored(cut, "owned"), lines)


def usage(lines: DataFrame) -> DataFrame:
    """What the split reads of the lines, written once: parsing and pricing them is dearer than reading it again."""
    return stored(lines.select("file", "line", *_BILL), "usage")


def split_owned(owned: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The split of the billed ones of ``lines``, from content that may hold more lines; their markers have a ``bill``."""
    cut = owned.filter(F.col("block").isNotNull())
    return _split(owned.filter(F.col("block").isNull()), None if cut.isEmpty() else cut, lines)


def _split(whole: DataFrame, cut: DataFrame | None, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    slices = _slices_whole(whole)
    split = stored(slices if cut is None else slices.unionByName(_slices_cut(cut, lines)), "split")
    per_tool = split.filter(F.col("tool").isNotNull()).select(
        *_AT_TURN, "tool", F.col("in_tokens").alias("tool_input_tokens"), F.col("out_tokens").alias("tool_output_tokens"),
        F.col("usd").alias("tool_usd"), F.col("usd_uncached").alias("tool_usd_uncached"),
    )
    rest = split.filter(F.col("tool").isNull()).select(
        *_AT_TURN, F.col("in_tokens").alias("rest_input_tokens"), F.col("out_tokens").alias("rest_output_tokens"),
        F.col("usd").alias("rest_usd"),
    )
    return per_tool, rest


def _own_tool() -> Column:
    return F.when((F.col("kind") == "tool_use") & real_tool(F.col("name")), F.col("name"))


def _slices_whole(owned: DataFrame) -> DataFrame:
    """Slices of whole files; the row without a tool brings the bill of its turn."""
    turn = F.col("kind") == "turn"
    rows = held_whole(owned).select(
        *_AT_TURN, F.when(turn, F.col("tool")).otherwise(_own_tool()).alias("tool"), F.when(turn, F.col("held")).alias("held"),
        F.when(~turn, F.col("nbytes")).alias("own"), *[F.when(F.col("tool").isNull(), F.col(f"bill.{c}")).alias(c) for c in _BILL],
    )
    zero = F.lit(0)
    parts = rows.groupBy(*_AT_TURN, "tool").agg(
        F.coalesce(F.sum("held"), zero).alias("held"), F.coalesce(F.sum("own"), zero).alias("own"), *[F.max(c).alias(c) for c in _BILL]
    )
    every = Window.partitionBy(*_AT_TURN)
    spread = _shares(parts).withColumns({c: F.max(c).over(every) for c in _BILL})
    return _priced(spread.filter(F.col("pool").isNotNull()))


def _slices_cut(owned: DataFrame, lines: DataFrame) -> DataFrame:
    """Slices of files cut into chunks."""
    totals, held = context_bytes(owned)

    # One row per (turn, tool): bytes held before the turn and bytes in its own
    # content; the row without a tool carries the totals. Hashing on the turn
    # serves the grouping, the spread of the totals and the join with the usage.
    none = F.lit(None).cast("bigint")
    parts = (
        held.select(*_AT_TURN, "tool", F.col("tool_nbytes").alias("held"), none.alias("own"))
        .unionByName(
            totals.select(
                *_AT_TURN, F.lit(None).cast("string").alias("tool"),
                (F.col("context_nbytes") - F.col("context_tool_nbytes")).alias("held"), none.alias("own"),
            )
        )
        .unionByName(
            owned.filter("kind <> 'turn'").select(*_AT_TURN, _own_tool().alias("tool"), none.alias("held"), F.col("nbytes").alias("own"))
        )
        .repartition(*_AT_TURN)
        .groupBy(*_AT_TURN, "tool")
        .agg(F.coalesce(F.sum("held"), F.lit(0)).alias("held"), F.coalesce(F.sum("own"), F.lit(0)).alias("own"))
    )
    bills = lines.filter(F.col("pool").isNotNull()).select(*_AT_TURN, *_BILL)
    return _priced(_shares(parts).join(bills, _AT_TURN))


def _shares(parts: DataFrame) -> DataFrame:
    """Shares of each row in the bytes of its turn; a turn without bytes belongs to the row without a tool."""
    every = Window.partitionBy(*_AT_TURN)
    in_total, out_total = F.sum("held").over(every), F.sum("own").over(every)
    rest_only = F.when(F.col("tool").isNull(), 1.0).otherwise(0.0)
    return parts.withColumns(
        {
            "in_share": F.when(in_total > 0, F.col("held") / in_total).otherwise(rest_only),
            "out_share": F.when(out_total > 0, F.col("own") / out_total).otherwise(rest_only),
        }
    )


def _priced(shares: DataFrame) -> DataFrame:
    """Tokens and cost of each share."""
    in_usd = usd(F.col("input_units") + F.col("cache_read_units") + F.col("cache_creation_units"))
    out_usd = usd(F.col("output_units"))
    uncached_usd = usd(F.col("input_units") + F.col("cache_creation_units"))
    return shares.select(
        *_AT_TURN,
        "tool",
        (F.col("pool") * F.col("in_share")).alias("in_tokens"),
        (F.col("output_tokens") * F.col("out_share")).alias("out_tokens"),
        (out_usd * F.col("out_share") + in_usd * F.col("in_share")).alias("usd"),
        (uncached_usd * F.col("in_share") + out_usd * F.col("out_share")).alias("usd_uncached"),
    )
