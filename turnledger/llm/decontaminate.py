"""Benchmark leaks by q-gram lemma filtering over diagonal bands, verified by banded alignment.

Texts and benchmark items are folded to lower-case words with single blanks. A leak
is any part of an item of ``PIECE`` characters (the whole item, where it is shorter)
that stands in a text within k = RATE * length edits. Such a part of length m shares
at least m - q + 1 - k * q of its q-grams with the text (q-gram lemma), on diagonals
that lie at most k apart. So per item and text the shared q-grams are gathered in
bands of diagonals 2(k + 1) wide that overlap by half; wherever a band holds enough
of them inside one window of m characters of the item, windows there are aligned
within the band, one every STRIDE characters. Items so short that the bound is
below one q-gram are looked for by their k + 1 parts, one of which is unchanged.

The benchmark is broadcast in blocks of at most ``BLOCK_CHARS`` characters
(larger sets take more passes); texts are read where they are, nothing of the
corpus is shuffled, and whether a document leaks depends on that document alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.arrays import blocks, offsets_of

Q = 8
PIECE, STRIDE, RATE = 72, 4, 0.08
BLOCK_CHARS = 4_000_000
#: Bytes of text that a task indexes at a time; its arrays take some hundred times as much.
TEXT_BYTES = 500_000
_BITS = 22
#: Bytes of the parts of very short items.
PART = 6

_FOLD = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _FOLD[_b] = _b
for _b in range(65, 91):
    _FOLD[_b] = _b + 32


def folded(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, origin, raw): folded bytes of all texts, where each text begins, the raw byte each came from, the raw bytes."""
    text = pc.fill_null(text, "").cast(pa.string())
    ends = offsets_of(pc.binary_length(text).to_numpy(zero_copy_only=False))
    raw = np.frombuffer(b"".join(x.as_buffer() for x in text) if len(text) else b"", np.uint8)
    flat = _FOLD[raw]
    keep = flat != 32
    keep[1:] |= flat[:-1] != 32  # one blank after each word
    starts = ends[:-1][np.diff(ends) > 0]
    keep[starts] = flat[starts] != 32
    origin = np.flatnonzero(keep)
    return flat[origin], np.searchsorted(origin, ends), origin, raw


def grams(data: np.ndarray) -> np.ndarray:
    """The Q bytes from each position on as one integer; the last Q - 1 positions have none."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | (x[width:] << np.uint64(8 * width)) if len(x) > width else x[:0]
    return x


def edits_within(piece: bytes, region: bytes, limit: int) -> int | None:
    """Least edits between ``piece`` and any part of ``region``, if at most ``limit``; cells off the band are never visited."""
    if piece in region:
        return 0
    m, n = len(piece), len(region)
    band = n - m + limit  # the region reaches at most this far beyond the piece's own diagonal
    row = {j: 0 for j in range(n + 1)}
    for i in range(1, m + 1):
        nxt: dict[int, int] = {}
        for j in range(max(0, i - limit), min(n, i + band) + 1):
            best = min(row.get(j, limit + 1), nxt.get(j - 1, limit + 1)) + 1
            if j and j - 1 in row:
                best = min(best, row[j - 1] + (piece[i - 1] != region[j - 1]))
            if best <= limit:
                nxt[j] = best
        if not nxt:
            return None
        row = nxt
    return min(row.values())


class Index:
    """The q-grams of some items: for each one the items and places where it stands."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float):
        self.items = items
        sizes = np.array([len(x) for _, x in items], np.int64)
        self.window = np.minimum(sizes, PIECE)
        self.budget = (rate * self.window).astype(np.int64)
        self.needs = self.window - Q + 1 - self.budget * Q
        data = np.frombuffer(b"".join(x for _, x in items), np.uint8)
        ends = offsets_of(sizes)
        item = np.repeat(np.arange(len(items)), np.maximum(sizes - Q + 1, 0))
        place = np.arange(len(item)) - np.repeat(offsets_of(sizes - Q + 1)[:-1], sizes - Q + 1)
        g = grams(data)[ends[item] + place]
        order = np.argsort(g, kind="stable")
        g, self.item, self.place = g[order], item[order], place[order]
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
        self.keys, self.first = g[begin], np.append(begin, len(g))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.slot(self.keys)] = True
        # the sparsest hits a matching region can have, over the widest window: a first filter that loses none
        self.least = int(self.needs.min(initial=1))
        self.widest = int((self.window + self.budget).max(initial=1))

    @staticmethod
    def slot(g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)

    def hits(self, g: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(where a text holds a q-gram of an item, the number of that q-gram), only inside regions dense enough for a match."""
        hit = np.flatnonzero(self.seen[self.slot(g)]) if len(self.keys) else np.empty(0, np.int64)
        at = np.searchsorted(self.keys, g[hit])
        real = self.keys[np.minimum(at, len(self.keys) - 1)] == g[hit] if len(self.keys) else np.empty(0, bool)
        hit, at = hit[real], at[real]
        if not len(hit) or self.least <= 1:
            return hit, at
        flags = np.zeros(size + 1, np.int32)
        flags[hit] = 1
        upto = np.concatenate([[0], np.cumsum(flags)])
        end = np.minimum(hit + self.widest, size)
        opens = upto[end] - upto[hit] >= self.least
        cover = np.zeros(size + 1, np.int32)
        np.add.at(cover, hit[opens], 1)
        np.add.at(cover, end[opens], -1)
        dense = np.cumsum(cover)[hit] > 0
        return hit[dense], at[dense]

    def find(self, data: np.ndarray, ends: np.ndarray, g: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first folded byte, last folded byte + 1, edits) of the regions that hold a window of an item."""
        hit, at = self.hits(g, len(data))
        if not len(hit):
            return []
        n = self.first[at + 1] - self.first[at]
        where = np.repeat(hit, n)
        post = np.repeat(self.first[at], n) + (np.arange(n.sum()) - np.repeat(offsets_of(n)[:-1], n))
        item, place = self.item[post], self.place[post]
        doc = np.searchsorted(ends, where, side="right") - 1
        whole = where + Q <= ends[doc + 1]
        item, place, doc, where = item[whole], place[whole], doc[whole], where[whole]
        if not len(where):
            return []
        longest = int(max(len(x) for _, x in self.items)) + 1
        diagonal = where - place + longest  # never negative
        step = self.budget[item] + 1
        bands = int(diagonal.max()) // 2 + 2
        out: list[tuple[int, int, int, int, int]] = []
        done: set[tuple[int, int, int]] = set()
        for shift in (0, 1):  # bands 2 * step wide, half a band apart
            band = (diagonal + shift * step) // (2 * step)
            cell = np.unique((doc * len(self.items) + item) * bands + band, return_inverse=True)[1]
            order = np.argsort(cell * longest + place, kind="stable")
            c, j, t = cell[order], place[order], where[order]
            new = np.concatenate([[True], (c[1:] != c[:-1]) | (j[1:] != j[:-1])])  # a q-gram of the item counts once
            c, j, t, row, own = c[new], j[new], t[new], doc[order][new], item[order][new]
            ahead = np.arange(len(c)) + np.maximum(self.needs[own], 1) - 1
            there = np.minimum(ahead, len(c) - 1)
            full = (ahead < len(c)) & (c[there] == c) & (j[there] - j <= self.window[own] - Q)
            for i in np.flatnonzero(full):
                d, x, m, k = int(row[i]), int(own[i]), int(self.window[own[i]]), int(self.budget[own[i]])
                text = self.items[x][1]
                # windows of the item that hold the q-grams from the i-th to the one that fills the bound
                low, high = max(0, int(j[there[i]]) - (m - Q)), min(int(j[i]), len(text) - m)
                if (d, x, int(t[i]) - int(j[i])) in done:
                    continue
                for s in sorted({*range(low, high, STRIDE), high}):
                    at = int(t[i]) - int(j[i]) + s  # where the window begins on this diagonal
                    slack = 2 * (k + 1)
                    a, z = max(int(ends[d]), at - slack), min(int(ends[d + 1]), at + m + slack)
                    region, part = data[a:z].tobytes(), text[s : s + m]
                    edits = edits_within(part, region, k)
                    if edits is not None:
                        exact = region.find(part)
                        if exact >= 0:
                            a, z = a + exact, a + exact + m
                        out.append((d, self.items[x][0], a, z, edits))
                        done.add((d, x, int(t[i]) - int(j[i])))
                        break
        return out


class ShortItems:
    """Items that may lose all their q-grams to the edits allowed: one of their k + 1 parts is unchanged."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float):
        self.items = [(item, text, int(rate * len(text))) for item, text in items]
        parts = []
        for x, (_, text, k) in enumerate(self.items):
            size = len(text) // (k + 1)
            parts += [(int.from_bytes(text[p * size : p * size + PART], "little"), x, p * size) for p in range(k + 1)]
        self.parts = np.array(sorted(parts), np.int64).reshape(-1, 3)
        self.keys = self.parts[:, 0].astype(np.uint64)

    def find(self, data: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        g = grams(np.append(data, np.full(Q - 1, 32, np.uint8))) & np.uint64((1 << (8 * PART)) - 1)
        low, high = np.searchsorted(self.keys, g, side="left"), np.searchsorted(self.keys, g, side="right")
        out, done = [], set()
        for t in np.flatnonzero(high > low):
            d = int(np.searchsorted(ends, t, side="right")) - 1
            for _, x, at in self.parts[low[t] : high[t]].tolist():
                item, text, k = self.items[x]
                if (d, x) in done:
                    continue
                a, z = max(int(ends[d]), int(t) - at - k), min(int(ends[d + 1]), int(t) - at + len(text) + k)
                edits = edits_within(text, data[a:z].tobytes(), k)
                if edits is not None:
                    done.add((d, x))
                    out.append((d, item, a, z, edits))
        return out


class Pieces:
    """One block of benchmark items [(item_id, text)]: long items, short ones, and those below the lemma, each with its own filter."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        kinds: dict[str, list[tuple[int, bytes]]] = {"long": [], "short": [], "tiny": []}
        if items:
            data, ends, _, _ = folded(pa.array([t for _, t in items], pa.string()))
            for (item, _), a, b in zip(items, ends[:-1], ends[1:]):
                text = data[a:b].tobytes().strip()
                if len(text) >= Q:
                    bound = len(text) - Q + 1 - int(rate * len(text)) * Q
                    kinds["long" if len(text) >= PIECE else "short" if bound > 0 else "tiny"].append((item, text))
        self.indexes = [Index(kinds[k], rate) for k in ("long", "short") if kinds[k]]
        self.tiny = ShortItems(kinds["tiny"], rate) if kinds["tiny"] else None

    def find(self, text: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first raw byte, last raw byte + 1, edits) of every region found in the texts; bytes count from the block's start."""
        data, ends, origin, _ = folded(text)
        if not len(data):
            return []
        g = grams(data)
        found = [x for index in self.indexes for x in index.find(data, ends, g)] + (self.tiny.find(data, ends) if self.tiny else [])
        return [(d, item, int(origin[a]), int(origin[z - 1]) + 1, edits) for d, item, a, z, edits in found]


def _blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks that hold about BLOCK_CHARS characters, read one after another."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-2 * total // BLOCK_CHARS) or 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r[0], r[1]) for r in part.distinct().collect()]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, pieces, first, last, edits) of every item of which a part stands in a text.

    first and last bound the found pieces in code points, last exclusive; edits
    are the least of any piece. Null and empty texts and items have no leaks; an
    item of fewer than Q folded characters is never found. Rows that repeat a
    document repeat its leaks; of equal regions each counts. Empty tables give an
    empty result; other columns are not read.
    """
    out = None
    spark = docs.sparkSession
    for block in _blocks_of(benchmark):
        index = spark.sparkContext.broadcast(cloudpickle.dumps(Pieces(block)))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            pieces = cloudpickle.loads(index.value)
            for batch in batches:
                for part in blocks(batch, "text", TEXT_BYTES):
                    texts, rows = part.column("text"), []
                    found = defaultdict(list)
                    for row, item, a, z, edits in pieces.find(texts):
                        found[row, item].append((a, z, edits))
                    start = offsets_of(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
                    for (row, item), spans in found.items():
                        body = texts[row].as_py().encode()
                        point = lambda at: len(body[: at - start[row]].decode(errors="ignore"))  # noqa: B023, E731
                        rows.append((part.column("doc_id")[row].as_py(), item, len(set(spans)), point(min(s[0] for s in spans)), point(max(s[1] for s in spans)), min(s[2] for s in spans)))
                    columns = list(zip(*rows)) if rows else [[]] * 6
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "pieces", "first", "last", "edits"])

        schema = "doc_id bigint, item_id bigint, pieces bigint, first bigint, last bigint, edits bigint"
        part = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without a leak; decided next to the text, nothing is shuffled.

    Null and empty texts have no leaks; repeated rows stay or go together.
    """
    for block in _blocks_of(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(Pieces(block)))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            pieces = cloudpickle.loads(index.value)
            for batch in batches:
                for part in blocks(batch, "text", TEXT_BYTES):
                    clean = np.ones(part.num_rows, bool)
                    clean[[x[0] for x in pieces.find(part.column("text"))]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
