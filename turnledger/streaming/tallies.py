"""The cost split of log files that grow, from their new lines and a saved state per file.

What the split of later lines depends on is short: the running peak of the pool and,
for the epoch since the last compaction, the bytes each tool holds, the bytes of plain
content and the tool calls whose result is still to come. It is saved as one row per
file whose blocks stand for all of that, and read back as a line before the new ones:
the split of the new lines then is the split of a file that begins with that line.
Rows lie in hash buckets of the file, so a batch opens those of the files it touches.
Lines of a file come in their order, in one batch or in several.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnledger import constants as K
from turnledger.operators import attribution
from turnledger.session import stored
from turnledger.streaming.parts import Parts

_BLOCK = "struct<kind:string,name:string,block_id:string,tool_use_id:string,nbytes:bigint>"
SCHEMA = f"file string, line bigint, pool bigint, blocks array<{_BLOCK}>"
#: Ids of the blocks that stand for the bytes a tool holds; no result refers to them.
HELD = "\u0000held "


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg(F.max_by(F.struct("line", "pool", "blocks"), "line").alias("s")).select("file", "s.*")


def states(spark: SparkSession, path: str) -> Parts:
    return Parts(spark, path, SCHEMA, by="file", fold=_latest)


def saved_lines(saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(line, blocks) of each file that stand for all its earlier lines."""
    blocks = saved.select("file", "line", F.posexplode("blocks").alias("pos", "b")).select("file", "line", F.col("pos").cast("bigint").alias("pos"), "b.*")
    return saved.select("file", "line", "pool"), blocks


def state_of(owned: DataFrame) -> DataFrame:
    """The state after the last line of each file, from its content with owners (and the pools of its billed lines)."""
    last = owned.groupBy("file").agg(F.max("epoch").alias("epoch"), F.max("line").alias("last"))
    now = owned.join(last, ["file", "epoch"])
    kind = F.when(F.col("owner") == K.UNKNOWN_TOOL, "tool_result").when(F.col("owner").isNotNull(), "tool_use").otherwise("text")
    tool = F.when(kind == "tool_use", F.col("owner"))
    none = F.lit(None).cast("string")
    held = now.filter("kind <> 'turn'").groupBy("file", "owner").agg(F.sum("nbytes").alias("nbytes")).select(
        "file", F.struct(kind.alias("kind"), tool.alias("name"), F.when(tool.isNotNull(), F.concat(F.lit(HELD), tool)).alias("block_id"), none.alias("tool_use_id"), "nbytes").alias("b")
    )
    use, ref = attribution.reference()
    mentions = now.withColumns({"ref": ref, "declared": F.when(use, F.col("name"))}).filter(F.col("ref").isNotNull() & ~F.col("ref").startswith(HELD))
    waiting = mentions.groupBy("file", "ref").agg(F.max_by(F.struct("declared"), F.struct("line", "pos")).alias("m")).filter("m.declared is not null").select(
        "file", F.struct(F.lit("tool_use").alias("kind"), F.col("m.declared").alias("name"), F.col("ref").alias("block_id"), none.alias("tool_use_id"), F.lit(0).cast("bigint").alias("nbytes")).alias("b")
    )
    blocks = held.unionByName(waiting).groupBy("file").agg(F.collect_list("b").alias("blocks"))  # tools and open calls of one epoch of one file
    peaks = now.groupBy("file").agg(F.max("pool").alias("pool"), F.max("last").alias("line"))
    empty = F.array().cast(f"array<{_BLOCK}>")
    return peaks.join(blocks, "file", "left").select("file", "line", "pool", F.coalesce("blocks", empty).alias("blocks"))


def split_batch(kept: Parts, lines: DataFrame, blocks: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """(per turn and tool, rest per turn) of the new lines of a batch; the state of their files is saved for the next one.

    ``lines`` and ``blocks`` as for ``attribute``. A batch that runs again reads the states before it and overwrites its own.
    """
    lines = attribution.usage(lines)
    files = lines.select("file").distinct()
    saved = kept.read(before=batch_id, near=files).join(files, "file", "left_semi")
    earlier, content = saved_lines(stored(saved, "tally-states"))
    every = attribution.billed(lines).select("file", "line", "pool", "bill").unionByName(earlier, allowMissingColumns=True)
    owned = attribution.owned_content(every, blocks.unionByName(content, allowMissingColumns=True))
    kept.add(state_of(owned), batch_id)
    return attribution.split_owned(owned, lines)
