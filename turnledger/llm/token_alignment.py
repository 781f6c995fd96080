"""Alignment of two tokenizers over the same texts by galloping intersection of their token ends.

Both tokenizations of a text end tokens at byte offsets. The shorter list of ends
drives a search in the longer: from the last place known, steps of 1, 2, 4, ... until
an end is not below the one looked for, then a binary search inside the last step.
Ends in both lists cut the tokens into groups. The ranks found give, for every token
of the shorter list, the range of tokens of the other that overlap it: from the rank
after the end before it (one further where that end is common) to the rank of its own.
All tokens of a block of texts take each step together, and every STRIDE-th token
goes first, so that the others start next to their place.

Counts of overlapping id pairs over the corpus are a table of at most (ids of A) x
(ids of B) rows, whatever the number of texts. Texts look their own pairs up in
slices of that table of at most ``SLICE`` rows, one broadcast after the other.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.arrays import blocks, offsets_of
from turnledger.session import stored

#: Folder of the vocabulary files, on the driver; tasks get their contents.
TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
STRIDE = 16
#: Rows of the table of pair counts that are broadcast at once (24 bytes each).
SLICE = 2_000_000
TEXT_BYTES = 500_000

# fixed values: how byte-level vocabularies split text before merging
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# fixed values: bytes that byte-level vocabularies write as the character of the same number; others follow from 256 on
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


class ByteLevel:
    """A byte-level BPE vocabulary from its JSON file; special tokens are not part of it."""

    def __init__(self, content: bytes):
        import tiktoken

        other = [b for b in range(256) if b not in set(PLAIN)]
        byte_of = {chr(b): b for b in PLAIN} | {chr(256 + k): b for k, b in enumerate(other)}
        file = json.loads(content)
        special = {x["content"] for x in file["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): k for token, k in file["model"]["vocab"].items() if token not in special}
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, k in ranks.items():
            self.bytes[k] = token
        self._encoding = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._encoding.encode_ordinary(" " + x) for x in texts]


class Pieces:
    """A piece vocabulary with byte fallback from its model file; it puts a blank before the text itself."""

    def __init__(self, content: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.size = len(self._model)
        pieces = self._model.id_to_piece(list(range(self.size)))
        self.bytes = [bytes([int(p[3:5], 16)]) if self._model.is_byte(k) else b"" if self._model.is_control(k) or self._model.is_unknown(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


def gallop(needles: np.ndarray, hay: np.ndarray, start: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """How many of the ascending ``hay`` are below each of the ascending ``needles``, which is at least ``start`` (ascending)."""
    low = start.copy()
    if len(needles) > stride:
        coarse = gallop(needles[::stride], hay, start[::stride], stride)
        low = np.maximum(low, np.repeat(coarse, stride)[: len(needles)])
    last = len(hay)
    high = low.copy()
    going, step = np.flatnonzero(low < last), 1
    while len(going):  # exponential: hay[low - 1] stays below the needle
        at = np.minimum(low[going] + step - 1, last - 1)
        below = hay[at] < needles[going]
        high[going] = np.where(below, last, at)
        going, at = going[below], at[below]
        low[going] = at + 1
        going = going[low[going] < last]
        step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):  # binary between the last two steps
        mid = (low[open_] + high[open_]) >> 1
        below = hay[mid] < needles[open_]
        low[open_[below]] = mid[below] + 1
        high[open_[~below]] = mid[~below]
        open_ = open_[low[open_] < high[open_]]
    return low


@dataclass
class Aligned:
    """Texts of a block, tokens laid end to end; the arrays of token ranges are per token of A."""

    a: np.ndarray  # ids
    b: np.ndarray
    a_ends: np.ndarray  # where each text's tokens begin, and the end
    b_ends: np.ndarray
    group_a: np.ndarray  # tokens of A up to the end of each group
    group_b: np.ndarray
    groups: np.ndarray  # where each text's groups begin, and the end
    left: np.ndarray  # the links: a token of A and a token of B
    right: np.ndarray


def _side(short: np.ndarray, short_ends: np.ndarray, long: np.ndarray, long_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank of each short end in the long list, whether it is common, first overlapping token of the long list)."""
    rank = gallop(short, long, np.repeat(long_ends[:-1], np.diff(short_ends)))
    common = long[np.minimum(rank, len(long) - 1)] == short
    first = np.empty_like(rank)
    first[1:] = rank[:-1] + common[:-1]  # a text's last end is common, so the next text's first token begins at its own first
    first[:1] = 0
    return rank, common, first


def align(a: list[list[int]], b: list[list[int]], a_sizes: np.ndarray, b_sizes: np.ndarray) -> Aligned:
    """Groups and links of texts whose two tokenizations cover the same bytes; a text without tokens has none."""
    counts = [np.array([len(x) for x in side], np.int64) for side in (a, b)]
    ids = [np.fromiter((k for x in side for k in x), np.int64, int(n.sum())) for side, n in zip((a, b), counts)]
    ends = [offsets_of(n) for n in counts]
    at = [np.cumsum(size[k]) for size, k in zip((a_sizes, b_sizes), ids)]  # ascending over the whole block
    a_short = counts[0] <= counts[1]
    out: dict[str, list[np.ndarray]] = {"a": [], "b": [], "left": [], "right": []}
    for flag, (x, y), (p, q) in ((True, (0, 1), ("left", "right")), (False, (1, 0), ("right", "left"))):
        chosen = np.flatnonzero((a_short == flag) & (counts[x] > 0))
        if not len(chosen):
            continue
        mask = np.zeros(len(counts[0]), bool)
        mask[chosen] = True
        pick = [np.flatnonzero(np.repeat(mask, counts[s])) for s in (x, y)]
        own = [offsets_of(counts[s][chosen]) for s in (x, y)]
        rank, common, first = _side(at[x][pick[0]], own[0], at[y][pick[1]], own[1])
        where = np.flatnonzero(common)
        out["a" if x == 0 else "b"].append(pick[0][where] + 1)
        out["b" if x == 0 else "a"].append(pick[1][rank[where]] + 1)
        n = rank - first + 1
        token = np.repeat(np.arange(len(rank)), n)
        other = np.repeat(first - offsets_of(n)[:-1], n) + np.arange(int(n.sum()))
        out[p].append(pick[0][token])
        out[q].append(pick[1][other])
    flat = {k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in out.items()}
    group_a, group_b = np.sort(flat["a"]), np.sort(flat["b"])
    return Aligned(*ids, *ends, group_a, group_b, np.searchsorted(group_a, ends[0], side="right"), flat["left"], flat["right"])


class Aligner:
    """Both tokenizers, and what depends on them."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.shift = (self.b.size - 1).bit_length()
        seps = (b",", b"|", b";")
        self.written = [str(k).encode() + s for k in range(max(self.a.size, self.b.size)) for s in seps]

    def of(self, texts: list[str | None]) -> Aligned:
        """Null and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens."""
        full = [x or "" for x in texts]
        a, b = self.a.encode(full), self.b.encode(full)
        for k, text in enumerate(full):
            whole = b" " + text.encode("utf-8", "surrogatepass")
            if not text or any(b"".join([t.bytes[i] for i in x[k]]) != whole for t, x in ((self.a, a), (self.b, b))):
                a[k], b[k] = [], []
        return align(a, b, self.a_sizes, self.b_sizes)

    def digests(self, x: Aligned) -> list[str]:
        """Per text the SHA-256 of its groups as a1,a2|b1;a3|b2,b3; '' for a text without tokens."""
        codes = np.zeros(len(x.a) + len(x.b), np.int64)
        na, nb = (np.diff(np.concatenate([[0], g])) for g in (x.group_a, x.group_b))
        place_a = np.arange(len(x.a)) + np.repeat(np.concatenate([[0], x.group_b])[:-1].astype(np.int64), na)
        place_b = np.arange(len(x.b)) + np.repeat(x.group_a, nb)
        sep_a, sep_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
        sep_a[x.group_a - 1], sep_b[x.group_b - 1] = 1, 2
        codes[place_a], codes[place_b] = x.a * 3 + sep_a, x.b * 3 + sep_b
        table, out = self.written, []
        for p, q in zip((x.a_ends + x.b_ends)[:-1].tolist(), (x.a_ends + x.b_ends)[1:].tolist()):
            out.append(hashlib.sha256(b"".join([table[k] for k in codes[p:q].tolist()])[:-1]).hexdigest() if q > p else "")
        return out


def _aligner(box) -> Aligner:
    return Aligner(*cloudpickle.loads(box.value))


def _box(docs: DataFrame, tokenizers: str, files: tuple[str, str]):
    return docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(tuple((Path(tokenizers) / f).read_bytes() for f in files)))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def alignments(docs: DataFrame, tokenizers: str = TOKENIZERS, files: tuple[str, str] = (A_FILE, B_FILE)) -> DataFrame:
    """One row per row of ``docs``: (doc_id, a, b, group_a, group_b), the token ids and how many tokens of A and of B stand up to the end of each group.

    Null and empty texts, and texts that one of the tokenizers does not give back
    byte for byte, have empty lists; repeated rows repeat their result; an empty
    table gives an empty one; other columns are not read.
    """
    box, kind = _box(docs, tokenizers, files), docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _aligner(box)
        lists = lambda ends, flat, less: pa.array([(flat[p:q] - m).tolist() for p, q, m in zip(ends[:-1], ends[1:], less)], pa.list_(pa.int32()))
        for batch in batches:
            for part in blocks(batch, "text", TEXT_BYTES):
                x = both.of(part.column("text").to_pylist())
                zero = np.zeros(part.num_rows, np.int64)
                columns = [part.column("doc_id"), lists(x.a_ends, x.a, zero), lists(x.b_ends, x.b, zero), lists(x.groups, x.group_a, x.a_ends[:-1]), lists(x.groups, x.group_b, x.b_ends[:-1])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a", "b", "group_a", "group_b"])

    return _rows(docs).mapInArrow(run, f"doc_id {kind}, a array<int>, b array<int>, group_a array<int>, group_b array<int>")


def _pairs(docs: DataFrame, box) -> tuple[DataFrame, int]:
    """Per text its counts, the digest of its groups, its distinct linked id pairs (a << shift | b) and how many links hold each."""
    both = _aligner(box)
    shift, kind = both.shift, docs.schema["doc_id"].dataType.simpleString()
    wide = both.a.size << shift > 1 << 31
    number = pa.int64() if wide else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _aligner(box)
        for batch in batches:
            for part in blocks(batch, "text", TEXT_BYTES):
                x = both.of(part.column("text").to_pylist())
                rows = np.searchsorted(x.a_ends, x.left, side="right") - 1
                bits = (both.a.size << shift).bit_length()
                each = np.sort((rows << bits) | (x.a[x.left] << shift) | x.b[x.right])
                new = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]])) if len(each) else np.empty(0, np.int64)
                keys, times = each[new], np.diff(np.append(new, len(each)))
                ends = np.searchsorted(keys >> bits, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = lambda flat, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))  # noqa: B023, E731
                links = np.diff(x.a_ends) + np.diff(x.b_ends) - np.diff(x.groups)
                columns = [part.column("doc_id"), *(pa.array(v) for v in (np.diff(x.a_ends), np.diff(x.b_ends), np.diff(x.groups), links)), pa.array(both.digests(x), pa.string()), lists(keys & ((1 << bits) - 1), number), lists(times, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    whole = "bigint" if wide else "int"
    return _rows(docs).mapInArrow(run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<{whole}>, times array<int>"), shift


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links per pair of each batch of texts."""
    for batch in batches:
        pairs = batch.column("pairs").flatten().to_numpy()
        order = np.argsort(pairs, kind="stable")
        pairs, times = pairs[order], batch.column("times").flatten().to_numpy()[order]
        new = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.empty(0, np.int64)
        total = np.add.reduceat(times.astype(np.int64), new) if len(new) else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[new].astype(np.int64)), pa.array(total)], names=["pair", "links"])


def pair_counts(pairs: DataFrame, shift: int) -> DataFrame:
    """(pair, links, best): links of each id pair over all texts; best where no other A id has more links with the same B id."""
    links = stored(pairs.select("pairs", "times").mapInArrow(_tally, "pair bigint, links bigint").groupBy("pair").agg(F.sum("links").alias("links")), "pair-links")
    b = F.col("pair").bitwiseAND((1 << shift) - 1).alias("b")
    most = links.groupBy(b).agg(F.max("links").alias("most"))
    return links.withColumn("b", b).join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def report(docs: DataFrame, tokenizers: str = TOKENIZERS, files: tuple[str, str] = (A_FILE, B_FILE), slice_rows: int = SLICE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best are links whose count over the corpus is the highest of their B id, ties
    included; count_sum sums the counts of all links. Texts without tokens (null,
    empty, or not given back byte for byte) have zeros and ''; repeated rows count
    each time; an empty table gives an empty one; other columns are not read.
    """
    made, shift = _pairs(docs, _box(docs, tokenizers, files))
    made = stored(made, "token-pairs")
    counts = stored(pair_counts(made, shift), "pair-counts")
    n = -(-counts.count() // slice_rows)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "n_best", "count_sum"]
    out = made.withColumn("n_best", F.lit(0).cast("bigint")).withColumn("count_sum", F.lit(0).cast("bigint"))
    for k in range(n):
        part = counts.where(F.pmod("pair", F.lit(n)) == k).toArrow().combine_chunks()
        part = part.take(pc.sort_indices(part.column("pair")))
        table = out.sparkSession.sparkContext.broadcast(tuple(part.column(c).to_numpy() for c in ("pair", "links", "best")))

        def look(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            known, links, best = table.value
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    batch = whole.slice(at, 1000)
                    pairs, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
                    where = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                    times = np.where(known[where] == pairs, times, 0).astype(np.int64)
                    ends = offsets_of(pc.list_value_length(batch.column("pairs")).to_numpy())
                    for c, values in (("n_best", times * best[where]), ("count_sum", times * links[where])):
                        upto = np.concatenate([[0], np.cumsum(values)])
                        batch = batch.set_column(batch.schema.get_field_index(c), c, pa.array(batch.column(c).to_numpy() + upto[ends[1:]] - upto[ends[:-1]]))
                    yield batch

        out = out.select(*names).mapInArrow(look, out.select(*names).schema)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
