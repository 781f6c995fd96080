"""Repeated strings of a corpus by a suffix array that is built column by column, and their removal.

A byte goes if it is covered by a string of ``length`` bytes that starts at two
places at least. Finding them is split so that no task and no file ever holds the
whole corpus:

* Every string of ``length`` bytes has an anchor, the part of ANCHOR bytes with the
  smallest hash (leftmost of equal ones). Equal strings have equal anchors, and the
  starts that share one occurrence of an anchor are consecutive: a *piece* of text.
  Pieces are first listed without their bytes. Equal pieces are one row with a
  count: two occurrences settle all starts of a piece. An anchor that occurs once is
  dropped. Only anchors with different pieces need their bytes.
* The pieces of an anchor meet in one *collection* of bounded size. An anchor with
  more than ``group`` different pieces is cut finer: starts by their distance from
  the anchor, keyed by all bytes that such starts have in common, down to single
  starts, where equal keys mean equal strings. So no passage, however common and
  whatever stands around it, makes a large collection.
* In a collection the documents are the sequences of SYMBOL-byte symbols of a piece
  that begin at its first, second, ... byte. They are sorted the way of Bauer, Cox
  and Rosone (2013): round j puts the suffix of j symbols of every document in its
  place, which follows from the place of its suffix of j - 1 symbols and from the
  rows in which the symbol stands in the transform so far; common prefixes follow
  from minima over the prefixes between those rows (Cox et al. 2016). The transform,
  the common prefixes and the suffix positions are files in a folder of the task
  that each round reads from the front and writes anew. In the end, neighbours with
  ``length`` bytes in common are the strings that repeat.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.arrays import blocks, mix, offsets_of
from turnledger.llm.shared import maybe_in
from turnledger.session import stored

LENGTH, ANCHOR, SYMBOL = 400, 128, 16
#: Different pieces of one anchor that one collection takes; more are cut finer.
GROUP = 512
#: Bytes of a collection. Its files take some 13 bytes a byte, twice while a round writes.
COLLECTION = 2_000_000
#: Starts per cut of an anchor with too many pieces, one level after the other.
WIDTHS = (48, 6, 1)
#: Rows per Arrow batch: the JVM and Python each hold a whole one of every task.
BATCH = "500"
#: A longer text is read in slices that overlap by LENGTH - 1 bytes.
SLICE = 4_000_000

_LOW = np.uint64((1 << 24) - 1)
_ROW = np.uint64((1 << 32) - 1)


def raw_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls; the bytes are not copied."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data and ends[-1] > ends[0] else np.empty(0, np.uint8), ends - ends[0]


def part_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes (a power of two) from each position on."""
    x, width = data.astype(np.uint64), 1
    while width < size:
        if len(x) <= width:
            return x[:0]
        x = x[:-width] | (x[width:] << np.uint64(8 * width)) if width < 8 else mix(x[:-width] * np.uint64(0x9E3779B97F4A7C15) + x[width:])
        width *= 2
    return x if size > 8 else mix(x)


def pieces_of(data: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, starts, distance from the first start to the anchor) of each piece of texts laid end to end."""
    window = length - anchor + 1
    h = part_hashes(data, anchor)
    if len(h) < window:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    least, width = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * width <= window:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < window:
        least = np.minimum(least[: width - window], least[window - width :])
    opens = np.zeros(len(data) + 2, np.int8)  # starts whose string ends inside its text
    long = np.diff(ends) >= length
    opens[ends[:-1][long]] += 1
    opens[ends[1:][long] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(opens, dtype=np.int8)[: len(least)])
    at = (least[starts] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
    return h[at[first]], starts[first], np.diff(np.append(first, len(at))), at[first] - starts[first]


def _marks(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", 500_000):
                data, ends = raw_of(part.column("text"))
                jobs = [(data, ends, 0, 0)]
                if len(data) > SLICE:  # one long text: slices of it
                    jobs = [(data[a : a + SLICE], np.array([0, min(SLICE, len(data) - a)]), 0, a) for a in range(0, max(1, len(data) - length + 1), SLICE - length + 1)]
                for flat, own, row, base in jobs:
                    key, start, n, off = pieces_of(flat, own, length, anchor)
                    if not len(key):
                        continue
                    rows = np.searchsorted(own, start, side="right") - 1
                    view = memoryview(flat)
                    ph = np.fromiter((xxhash.xxh3_64_intdigest(view[a:z]) for a, z in zip(start.tolist(), (start + n + length - 1).tolist())), np.uint64, len(key))
                    take = pa.array(rows + row)
                    columns = [part.column("t1").take(take), part.column("t2").take(take), pa.array(key.view(np.int64)), pa.array(ph.view(np.int64)), pa.array(start - own[rows] + base), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["t1", "t2", "key", "ph", "start", "n", "off"])

    return run


def _bytes_of(length: int):
    """The bytes of the listed pieces of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_buffer()
                wanted = batch.column("wanted")[k].values
                start, n = wanted.field("start").to_numpy(), wanted.field("n").to_numpy()
                data = pa.array([text.slice(a, z).to_pybytes() for a, z in zip(start.tolist(), (n + length - 1).tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([wanted.field("key"), wanted.field("ph"), wanted.field("off"), wanted.field("n"), data], names=["key", "ph", "off", "n", "data"])

    return run


def _finer(length: int, width: int):
    """Pieces cut into runs of starts whose distance from the anchor has the same multiple of ``width``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "data", 200_000):
                out = []
                for key, ph, off, n, data in zip(*(part.column(c).to_pylist() for c in ("key", "ph", "off", "n", "data"))):
                    for cut in range((off - n + 1) // width, off // width + 1):
                        near = off - cut * width  # the start nearest to the anchor of this cut
                        a, z = max(0, near - width + 1), min(n, near + 1)
                        core = xxhash.xxh3_128_digest(data[near : near - width + 1 + length])
                        own = data[a : z + length - 1]
                        out.append((key, ph, a, z - a, off - a, own, xxhash.xxh3_64_intdigest(core, seed=(key ^ (cut * 4 + width)) & (2**64 - 1)) - 2**63, xxhash.xxh3_64_intdigest(own) - 2**63))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, types)], names=["key", "ph", "a", "n", "off", "data", "subkey", "subph"])

    return run


class RangeMinima:
    """Minima over ranges of a byte array: blocks of eight, a table of powers of two over the blocks."""

    def __init__(self, values: np.ndarray):
        padded = np.full(len(values) // 8 * 8 + 24, 255, np.uint8)
        padded[: len(values)] = values
        self.views = np.lib.stride_tricks.sliding_window_view(padded, 8)
        self.table = [padded.reshape(-1, 8).min(axis=1)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            last, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[: len(last) - step], last[step:]))

    def _some(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.where(np.arange(8) < count[:, None], self.views[at], np.uint8(255)).min(axis=1)

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value from low to high, both included."""
        first, last = (low + 7) >> 3, (high + 1) >> 3  # whole blocks from first to last - 1
        out = np.minimum(self._some(low, np.minimum(8 * first, high + 1) - low), self._some(np.maximum(8 * last, low), high + 1 - np.maximum(8 * last, low)))
        level = np.frexp(np.maximum(last - first, 1).astype(np.float64))[1] - 1
        for k in np.unique(level[last > first]):
            those = np.flatnonzero((level == k) & (last > first))
            row = self.table[k]
            out[those] = np.minimum(out[those], np.minimum(row[first[those]], row[last[those] - (1 << int(k))]))
        return out


class Collection:
    """The suffix array of a collection of documents, one symbol of each document a round.

    Rows are the suffixes in order. File ``transform`` holds, row by row, the first
    symbol of the suffix and the row of the suffix after it, which is the row where
    that symbol stands in the Burrows-Wheeler transform; so the file is the
    transform listed by symbol, and the rank of a symbol before a row is one search
    in it. File ``prefixes`` holds the symbols in common with the row before (255 at
    most), file ``suffixes`` where the suffix begins.
    """

    KINDS = {"transform": np.uint64, "prefixes": np.uint8, "suffixes": np.uint32}

    def __init__(self, folder: str):
        self.files = {name: open(Path(folder) / name, "w+b", buffering=0) for name in self.KINDS}  # noqa: SIM115

    def close(self) -> None:
        for file in self.files.values():
            file.close()

    def _read(self, name: str) -> np.ndarray:
        self.files[name].seek(0)
        return np.fromfile(self.files[name], self.KINDS[name])

    def _write(self, name: str, values: np.ndarray) -> None:
        """From the front over the rows of the round before, which has been read."""
        self.files[name].seek(0)
        values.astype(self.KINDS[name], copy=False).tofile(self.files[name])

    def build(self, symbols: np.ndarray, first: np.ndarray, last: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes, prefixes) of the documents symbols[first], symbols[first + step], ..., symbols[last]; an end sorts before every symbol (codes from 1 on)."""
        m = len(first)
        self._write("transform", np.arange(m, dtype=np.uint64))
        self._write("prefixes", np.zeros(m, np.uint8))
        self._write("suffixes", np.full(m, _ROW, np.uint32))
        row, at, begin = np.arange(m, dtype=np.int64), last.copy(), first
        live = at >= begin
        row, at, begin = row[live], at[live], begin[live]
        while len(at):
            row, at, begin = self._round(symbols, row, at, begin)
            at = at - step
            live = at >= begin
            row, at, begin = row[live], at[live], begin[live]
        return self._read("suffixes"), self._read("prefixes")

    def _round(self, symbols: np.ndarray, row: np.ndarray, at: np.ndarray, begin: np.ndarray):
        """One more symbol before each suffix in ``row``; the new suffixes' rows, in order."""
        transform, prefixes = self._read("transform"), self._read("prefixes")
        key = (symbols[at].astype(np.uint64) << np.uint64(32)) | row.astype(np.uint64)
        order = np.argsort(key)
        key, at, begin = key[order], at[order], begin[order]
        place = np.searchsorted(transform, key)
        # the symbols in common with the row before: one more than between the suffixes without their first symbol
        before = transform[np.maximum(place - 1, 0)]
        before[place == 0] = 0
        before[1:] = np.maximum(before[1:], key[:-1])
        minima = RangeMinima(prefixes)
        own = np.zeros(len(key), np.uint8)
        same = np.flatnonzero((before >> np.uint64(32)) == (key >> np.uint64(32)))
        own[same] = np.minimum(minima.of((before[same] & _ROW).astype(np.int64) + 1, (key[same] & _ROW).astype(np.int64)), 254) + 1
        # and of the old rows that now follow a new one
        ends = np.flatnonzero(np.concatenate([place[1:] != place[:-1], [True]]) & (place < len(transform)))
        after = transform[np.minimum(place[ends], len(transform) - 1)]
        ends, after = (x[(after >> np.uint64(32)) == (key[ends] >> np.uint64(32))] for x in (ends, after))
        prefixes[place[ends]] = np.minimum(minima.of((key[ends] & _ROW).astype(np.int64) + 1, (after & _ROW).astype(np.int64)), 254) + 1
        # the files again with the new rows in their places
        total = len(transform) + len(key)
        new = place + np.arange(len(key))
        old = np.ones(total, bool)
        old[new] = False
        moved = np.flatnonzero(old).astype(np.uint64)  # where each old row stands now
        merged = np.empty(total, np.uint64)
        merged[old] = (transform & ~_ROW) | moved[(transform & _ROW).astype(np.int64)]
        merged[new] = (key & ~_ROW) | moved[(key & _ROW).astype(np.int64)]
        self._write("transform", merged)
        for name, past, now in (("prefixes", prefixes, own), ("suffixes", self._read("suffixes"), at)):
            out = np.empty(total, past.dtype)
            out[old], out[new] = past, now
            self._write(name, out)
        return new, at, begin


def symbol_codes(data: np.ndarray, width: int) -> np.ndarray:
    """The number, from 1 on, of the ``width`` bytes (a power of two) from each position on among all of them; exact."""
    code, done = data.astype(np.uint64), 1
    while done < width:
        if len(code) <= done:
            return np.empty(0, np.int64)
        if done < 8:
            code = (code[:-done] << np.uint64(8 * done)) | code[done:]
        else:
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
            code = (code[:-done] << np.uint64(32)) | code[done:]
        done *= 2
    return np.unique(code, return_inverse=True)[1] + 1


def repeated_starts(pieces: list[bytes], length: int, symbol: int = SYMBOL, folder: str | None = None) -> list[np.ndarray]:
    """For each piece, which of its starts begin a string of ``length`` bytes that another start begins too."""
    while length % symbol:
        symbol //= 2
    pieces = [p if len(p) >= length else b"" for p in pieces]
    if not any(pieces):
        return [np.empty(0, bool) for _ in pieces]
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = offsets_of(sizes)
    codes = symbol_codes(np.frombuffer(b"".join(pieces), np.uint8), symbol)
    first = (ends[:-1, None] + np.arange(symbol)).ravel()
    last = first + ((np.repeat(sizes, symbol) - np.tile(np.arange(symbol), len(sizes))) // symbol - 1) * symbol
    with tempfile.TemporaryDirectory(dir=folder) as own:
        work = Collection(own)
        suffixes, prefixes = work.build(codes, first, last, symbol)
        work.close()
    alike = np.flatnonzero(prefixes >= length // symbol)
    flags = np.zeros(ends[-1] + 1, bool)
    flags[suffixes[alike]] = True
    flags[suffixes[alike - 1]] = True
    return [flags[a : max(a, z - length + 1)] for a, z in zip(ends[:-1], ends[1:])]


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _compare(length: int, collection: int):
    """Pieces in the order of their keys, whole keys per collection: (key, ph, a, b), starts a to b - 1 repeat."""
    def settle(held: list[tuple]) -> pa.RecordBatch:
        out = []
        for (key, ph, _), flags in zip(held, repeated_starts([x[2] for x in held], length)):
            out += [(key, ph, int(a), int(b)) for a, b in zip(*runs_of(flags))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, [pa.int64(), pa.int64(), pa.int32(), pa.int32()])], names=["key", "ph", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "ph", "data"))):
                if size > collection and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield settle(held)

    return run


PIECE = "key bigint, ph bigint, off int, n int, data binary"
RANGES = "key bigint, ph bigint, a int, b int"


def repeated_ranges(pieces: DataFrame, length: int, group: int = GROUP, collection: int = COLLECTION, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(key, ph, a, b): starts a to b - 1 of a piece repeat in another piece of its key; ``pieces`` are different ones."""
    if widths:
        sizes = pieces.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > group).select("key")
        large = stored(sizes, "hot-anchors")
        if not large.isEmpty():
            fine = pieces.join(large, "key", "left_semi").mapInArrow(_finer(length, widths[0]), "key bigint, ph bigint, a int, n int, off int, data binary, subkey bigint, subph bigint")
            fine = stored(fine, "anchor-cuts")
            counted, contested = _contested(fine.select(F.col("subkey").alias("key"), F.col("subph").alias("ph"), "off", "n", "data"), F.any_value("data"))
            deeper = repeated_ranges(stored(contested.withColumnRenamed("at", "data"), "cut-pieces"), length, group, collection, widths[1:])
            found = deeper.union(counted.where("copies > 1").select("key", "ph", F.lit(0).alias("a"), F.col("n").alias("b")))
            found = found.select(F.col("key").alias("subkey"), F.col("ph").alias("subph"), F.col("a").alias("low"), F.col("b").alias("high"))
            cuts = fine.select("key", "ph", "a", "subkey", "subph").join(found, ["subkey", "subph"])
            rest = repeated_ranges(pieces.join(large, "key", "left_anti"), length, group, collection, ())
            return rest.union(cuts.select("key", "ph", (F.col("a") + F.col("low")).alias("a"), (F.col("a") + F.col("high")).alias("b")))
    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(length, collection), RANGES)


def _contested(occurrences: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(pieces with their number of occurrences and one of them as ``at``; those of them whose key has other pieces too)."""
    counted = stored(occurrences.groupBy("key", "ph").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("off").alias("off"), at.alias("at")), "anchor-pieces")
    kinds = counted.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key")
    maybe = maybe_in(counted, "key", kinds).where("_maybe")
    return counted, maybe.join(kinds, "key", "left_semi").select("key", "ph", "off", "n", "at")


def _sums(length: int):
    """Per text with its repeated starts: what goes and the hash of what stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t1, t2, text, spans in zip(*(batch.column(c) for c in ("t1", "t2", "text", "spans"))):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                edges = np.zeros(len(data) + 1, np.int64)
                np.add.at(edges, spans.values.field("low").to_numpy(), 1)
                np.add.at(edges, spans.values.field("high").to_numpy(), -1)
                gone = np.cumsum(edges[:-1]) > 0
                low, high = runs_of(gone)
                rows.append((t1.as_py(), t2.as_py(), int(gone.sum()), len(low), hashlib.sha256(data[~gone].tobytes()).hexdigest(), low.tolist(), high.tolist()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=["t1", "t2", "n_removed", "n_spans", "kept_sha256", "low", "high"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text as bytes, t1, t2): a null text is empty; t1 and t2 name the text, 128 bits together."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id"), text.cast("binary").alias("text")).select("*", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(LENGTH), "text").alias("t2"))


def _one_of_each(texts: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """``wanted`` (one row a text) with the text's bytes; copies of a text are met once, other texts are not shuffled."""
    some = maybe_in(texts, "t1", wanted.select("t1")).where("_maybe").groupBy("t1", "t2").agg(F.any_value("text").alias("text"))
    return some.join(wanted, ["t1", "t2"]).select("text", *columns)


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP, collection: int = COLLECTION) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), spans a list of (low, high) bytes.

    A byte is removed if a string of ``length`` bytes over it also starts anywhere
    else in the table, the same document included. Null and empty texts have no
    bytes and keep the hash of nothing; texts shorter than ``length`` keep all.
    Repeated rows are copies of each other: all bytes of a long enough one go.
    An empty table gives an empty one; other columns are not read.
    ``anchor`` is a power of two below ``length``.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    texts = _texts(docs)
    named = "t1 bigint, t2 bigint, key bigint, ph bigint, start bigint, n int, off int"
    marks = stored(texts.where(F.octet_length("text") >= length).select("text", "t1", "t2").mapInArrow(_marks(length, anchor), named), "anchors")
    counted, contested = _contested(marks, F.min(F.struct("t1", "t2", "start")))
    wanted = contested.select("at.t1", "at.t2", F.struct("key", "ph", "at.start", "n", "off").alias("one")).groupBy("t1", "t2").agg(F.collect_list("one").alias("wanted"))
    pieces = stored(_one_of_each(texts, wanted, ["wanted"]).mapInArrow(_bytes_of(length), PIECE), "pieces")
    found = repeated_ranges(pieces, length, group, collection)
    found = stored(found.union(counted.where("copies > 1").select("key", "ph", F.lit(0).alias("a"), F.col("n").alias("b"))), "repeated")
    spans = maybe_in(marks, "key", found.select("key")).where("_maybe").join(found, ["key", "ph"]).select("t1", "t2", F.struct((F.col("start") + F.col("a")).alias("low"), (F.col("start") + F.col("b") + (length - 1)).alias("high")).alias("span"))
    spans = stored(spans.groupBy("t1", "t2").agg(F.collect_set("span").alias("spans")), "spans")
    sums = _one_of_each(texts, spans, ["t1", "t2", "spans"]).mapInArrow(_sums(length), "t1 bigint, t2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string, low array<bigint>, high array<bigint>")
    sums = stored(sums, "kept")
    rows = texts.select("doc_id", "t1", "t2", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    rows = maybe_in(rows, "t1", sums.select("t1"))
    none = F.array().cast("array<struct<low:bigint,high:bigint>>")
    clean = rows.where("not _maybe").select("doc_id", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.col("whole").alias("kept_sha256"), none.alias("spans"))
    cut = rows.where("_maybe").join(sums, ["t1", "t2"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    zip_spans = F.coalesce(F.expr("transform(low, (x, i) -> named_struct('low', x, 'high', high[i]))"), none)
    return clean.union(cut.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), zip_spans.alias("spans")))
