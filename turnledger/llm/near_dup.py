"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

The sketch (Dahlgaard, Knudsen and Thorup 2017) fills T coordinates in rounds:
round i throws every shingle into one hashed bin with a value in [i, i + 1); from
round T on all shingles go to bin i - T, so after 2T rounds no coordinate is
empty. A bin keeps its smallest value. Two sets agree on a coordinate with the
probability of their Jaccard similarity, with concentration as for independent
hash functions, and long texts need about one round.

Work per document is one pass over its text. What is shuffled afterwards is
ids, band keys and sketches, and the texts of candidate pairs only.

* Equal sets form one class before banding, so a large group of copies is one row.
* A bucket never emits its pairs. Each member is first verified against one
  central member, the one that shares the most buckets; the verified links give
  components. Members of a bucket that are still in different components are
  compared in blocks inside tasks, on sketches first and then on full sets, and
  only links that join components leave a task. No candidate that could join two
  components is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.arrays import blocks, mix, offsets_of, shingle_sets
from turnledger.llm.shared import components, maybe_in
from turnledger.session import stored

#: Bands of ROWS coordinates: a pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^40 = 1.3e-7.
BANDS, ROWS = 40, 5
#: A pair whose sketches agree on less than its similarity minus this is not verified: 5 standard deviations for 200 coordinates at 0.8.
SLACK = 0.14
#: Shingles on one side of a block of comparisons (a longer text is a block of its own).
CHUNK = 400_000
#: Rows on one side of a block: short texts fill few shingles, but each is compared with all of the other side.
CELL_ROWS = 1024

SKETCHES = "doc_id bigint, n_shingles bigint, set_hi bigint, set_lo bigint, bands array<bigint>, sketch binary"


def sketch(elements: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketches (texts x size) of the sets ``elements[ends[i]:ends[i+1]]``; all ones for an empty set."""
    n = len(ends) - 1
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * size, empty, np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(ends))
    for turn in range(2 * size):
        if not len(elements):
            break
        h = mix(elements + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64))
        bin_of = (h % np.uint64(size)).astype(np.int64) if turn < size else np.full(len(h), turn - size, np.int64)
        cell = owner * size + bin_of
        open_ = out[cell] == empty
        cell, value = cell[open_], (np.uint64(turn) << np.uint64(32)) | (h[open_] >> np.uint64(32))
        order = np.lexsort((value, cell))
        cell, value = cell[order], value[order]
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        out[cell[first]] = value[first]
        unfilled = (out.reshape(n, size) == empty).any(axis=1)
        live = unfilled[owner]
        elements, owner = elements[live], owner[live]
    return out.reshape(n, size)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """One row per document: size and fingerprint of its shingle set, band keys, and a byte of each coordinate."""
    from xxhash import xxh3_128_digest

    size = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                elements, ends = shingle_sets(block.column("text"), words)
                full = sketch(elements, ends, size)
                key = np.zeros((len(full), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for k in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + full[:, k::ROWS])
                counts = np.diff(ends)
                keys = pa.ListArray.from_arrays(pa.array(offsets_of(np.where(counts > 0, BANDS, 0)), pa.int32()), pa.array(key[counts > 0].reshape(-1).view(np.int64)))
                prints = np.array([np.frombuffer(xxh3_128_digest(elements[a:b].tobytes()), np.int64) for a, b in zip(ends[:-1], ends[1:])]).reshape(-1, 2)
                low = (mix(full) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(prints[:, 0]), pa.array(prints[:, 1]), keys, pa.array([r.tobytes() for r in low], pa.binary())],
                    names=["doc_id", "n_shingles", "set_hi", "set_lo", "bands", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SKETCHES)


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of document ids whose full shingle sets reach the similarity, in whole percent."""
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = maybe_in(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", ids).where("_maybe")
    one = texts.drop("_maybe")
    left = one.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = one.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text_b"):
                xs, x_ends = shingle_sets(block.column("text_a"), words)
                ys, y_ends = shingle_sets(block.column("text_b"), words)
                ok = np.zeros(block.num_rows, bool)
                for i in range(block.num_rows):
                    x, y = xs[x_ends[i] : x_ends[i + 1]], ys[y_ends[i] : y_ends[i + 1]]
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared)
                yield block.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint").distinct()


def shingled(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc, shingles): the full shingle sets of the documents in ``ids`` (doc_id), as packed 64-bit hashes."""
    rows = maybe_in(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                sets, ends = shingle_sets(block.column("text"), words)
                packed = pa.array([sets[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), packed], names=["doc", "shingles"])

    return rows.where("_maybe").select("doc_id", "text").mapInArrow(run, "doc bigint, shingles binary")


def _bridges(members: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different components inside the buckets that hold several.

    ``members`` has (key, band, doc, root, main, n_shingles), main the component
    of most members of the bucket, ``contents`` (doc, sketch, bands, shingles), shuffled
    once to the blocks; every pair to compare has a side outside main. A bucket is a grid of blocks of bounded size: rows outside
    main in columns, all rows in rows. In a block, pairs whose sketches come near
    the similarity are verified on the full sets, most alike first, and as soon
    as two components are joined their other pairs need no look; only the
    joining links leave the task. A pair is compared in the first band it shares, read from its full band keys.
    """
    least = int(np.floor((percent / 100 - SLACK) * BANDS * ROWS))
    outside = F.col("root") != F.col("main")
    sizes = members.groupBy("key").agg(
        F.sum("n_shingles").alias("n"), F.count("*").alias("n_rows"), F.sum(F.when(outside, F.col("n_shingles")).otherwise(0)).alias("m"), F.count_if(outside).alias("m_rows"),
    )
    side = lambda shingles, rows: F.greatest(F.ceil(F.col(shingles) / CHUNK), F.ceil(F.col(rows) / CELL_ROWS)).cast("int")
    sizes = sizes.select("key", side("n", "n_rows").alias("rows"), side("m", "m_rows").alias("cols"))
    grid = members.join(sizes, "key")
    own = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    down = grid.withColumn("r", own("rows")).withColumn("c", each("cols")).withColumn("side", F.lit(0))
    across = grid.where(outside).withColumn("c", own("cols")).withColumn("r", each("rows")).withColumn("side", F.lit(1))
    cells = down.unionByName(across).select("key", "r", "c", "band", "side", "doc", "root").join(contents, "doc")

    def join(band: int, side: np.ndarray, doc: np.ndarray, root: np.ndarray, marks: np.ndarray, keys: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        component = root.copy()
        xs = np.flatnonzero(side == 0)
        for y in np.flatnonzero(side == 1):
            alike = (marks[xs] == marks[y]).sum(axis=1)
            ok = (alike >= least) & (component[xs] != component[y])
            ok[ok] = (keys[xs[ok]] == keys[y]).argmax(axis=1) == band  # bytes of coordinates may agree where the keys differ
            left = xs[ok][np.argsort(-alike[ok], kind="stable")]
            while len(left):
                part, left = left[:64], left[64:]
                lengths = np.array([len(sets[x]) for x in part])
                flat = np.concatenate([sets[x] for x in part])
                at = np.minimum(np.searchsorted(sets[y], flat), len(sets[y]) - 1)
                shared = np.add.reduceat((sets[y][at] == flat).astype(np.int64), offsets_of(lengths)[:-1])
                for x in part[100 * shared >= percent * (lengths + len(sets[y]) - shared)]:
                    if component[x] != component[y]:
                        component[component == component[x]] = component[y]
                        yield min(doc[x], doc[y]), max(doc[x], doc[y])
                left = left[component[left] != component[y]]

    def found(part: pa.Table) -> pa.RecordBatch:
        key, r, c, band, side, doc, root = (part.column(n).to_numpy() for n in ("key", "r", "c", "band", "side", "doc", "root"))
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (r[1:] != r[:-1]) | (c[1:] != c[:-1])) + 1
        pairs: list[tuple[int, int]] = []
        for begin, end in zip([0, *cuts], [*cuts, len(key)]):
            if end - begin > 1:
                one = part.slice(begin, end - begin)
                marks = np.frombuffer(b"".join(one.column("sketch").to_pylist()), np.uint8).reshape(end - begin, -1)
                keys = one.column("bands").combine_chunks().flatten().to_numpy().reshape(end - begin, BANDS)
                sets = [np.frombuffer(x, np.uint64) for x in one.column("shingles").to_pylist()]
                pairs += join(band[begin], side[begin:end], doc[begin:end], root[begin:end], marks, keys, sets)
        return pa.RecordBatch.from_arrays([pa.array([int(p[0]) for p in pairs], pa.int64()), pa.array([int(p[1]) for p in pairs], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = part if rest is None else pa.concat_tables([rest, part])
            cell = [part.column(n).to_numpy() for n in ("key", "r", "c")]
            open_ = np.logical_and.reduce([x == x[-1] for x in cell]) if len(part) else np.zeros(0, bool)
            last = int(np.argmax(open_)) if len(part) else 0  # the last cell may go on in the next batch
            if last:
                yield found(part.slice(0, last))
            rest = part.slice(last)
        if rest is not None and len(rest):
            yield found(rest)

    return cells.repartition("key", "r", "c").sortWithinPartitions("key", "r", "c").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): (doc_id, n_shingles, component_id, kept).

    Documents are linked where the Jaccard similarity of their sets of ``words``
    lower-cased words is ``percent`` or more; component_id is the smallest doc_id
    reachable by links, kept marks that document. Null, empty and wordless texts
    have no shingles and are linked with nothing; rows with a null doc_id
    likewise (component_id null, kept). Rows that repeat a doc_id are one
    document: they get one component and stay or go together. Other columns are
    not read.
    """
    prints = stored(sketches(docs, words), "sketches")
    real = prints.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"))
    reps = real.join(classes.select(F.col("rep").alias("doc_id"), "set_hi", "set_lo"), ["doc_id", "set_hi", "set_lo"], "left_semi").select(F.col("doc_id").alias("doc"), "n_shingles", "bands", "sketch")
    spread = reps.select("doc", F.posexplode("bands").alias("band", "key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(spread.join(shared, "key"), "buckets")

    # the central member of a bucket shares the most buckets, counted with their sizes
    weight = members.groupBy("doc").agg(F.sum("n").alias("w"))
    rank = F.struct(F.col("w"), (-F.col("doc")).alias("neg"))
    ranked = members.join(weight, "doc").select("key", "doc", rank.alias("rank"))
    centre = ranked.groupBy("key").agg(F.max("rank").alias("top"))
    star = ranked.join(centre, "key").where("top > rank").groupBy("doc", "top").agg(F.count("*").alias("n"))
    best = star.groupBy("doc").agg(F.max(F.struct("n", "top")).alias("best"))
    first = verified(best.select(F.col("doc").alias("a"), (-F.col("best.top.neg")).alias("b")), docs, words, percent)
    near = stored(components(first, "stars"), "stars")

    # buckets that still hold several components
    rooted = members.join(near, members.doc == near.node, "left").select("key", "band", "doc", F.coalesce("root", "doc").alias("root"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    per_root = rooted.join(open_, "key").groupBy("key", "root").agg(F.count("*").alias("n"))
    main = per_root.groupBy("key").agg(F.max(F.struct("n", (-F.col("root")).alias("neg"))).alias("main")).select("key", (-F.col("main.neg")).alias("main"))
    contested = stored(rooted.join(main, "key").join(reps.select("doc", "n_shingles"), "doc"), "contested")
    ids = contested.select(F.col("doc").alias("doc_id")).distinct()
    contents = shingled(docs, ids, words).join(reps.select("doc", "sketch", "bands"), "doc")
    second = _bridges(contested, contents, percent)
    root_of = near.select(F.col("node"), F.col("root"))
    bridges = second.join(root_of, F.col("a") == F.col("node"), "left").select(F.coalesce("root", "a").alias("a"), "b")
    bridges = bridges.join(root_of, F.col("b") == F.col("node"), "left").select("a", F.coalesce("root", "b").alias("b"))
    joined = components(bridges, "bridges").select(F.col("node").alias("root"), F.col("root").alias("top"))
    top = near.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("top"))
    top = top.unionByName(joined.select(F.col("root").alias("node"), "top")).distinct()

    # the smallest doc_id of the component, then one row per document by its class
    held = classes.join(top, classes.rep == top.node, "left").select("set_hi", "set_lo", F.coalesce("top", "rep").alias("top"), "rep")
    least_of = held.groupBy("top").agg(F.min("rep").alias("component_id"))
    labelled = held.join(least_of, "top").select("set_hi", "set_lo", "component_id")
    linked = real.select("doc_id", "n_shingles", "set_hi", "set_lo").join(labelled, ["set_hi", "set_lo"]).select("doc_id", "n_shingles", "component_id")
    alone = prints.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
