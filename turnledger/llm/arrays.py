"""Helpers for Arrow batches inside tasks: blocks of bounded bytes, words as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1_000_000

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``size`` bytes; a longer text is a block of its own."""
    if not batch.num_rows:
        return
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + size, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def split_words(text: pa.Array, lower: bool = True, pattern: str | None = None) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one flat array, and the offsets of each text in it.

    Without a pattern words lie between ASCII white space; a pattern names what
    separates them. A null text has no words. Lower-casing touches A-Z only.
    """
    text = pc.fill_null(text, "")
    if lower:
        text = pc.ascii_lower(text)
    parts = pc.split_pattern_regex(text, pattern) if pattern else pc.ascii_split_whitespace(text)
    flat = parts.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    ends = offsets_of(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    return flat.filter(pa.array(real)), offsets_of(real)[ends]


def hash_strings(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string; each distinct one is hashed once."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    of_each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return of_each[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)


def shingle_sets(text: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, with offsets.

    A shingle is ``words`` consecutive lower-cased words; a text with fewer
    words gives its whole sequence as one, a text without words gives none.
    """
    flat, ends = split_words(text)
    hashes = hash_strings(flat)
    rolled = np.zeros(len(hashes), np.uint64)
    for k in range(words):
        moved = np.zeros(len(hashes), np.uint64)
        moved[: len(hashes) - k] = hashes[k:]
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + moved + np.uint64(k + 1))
    sets = []
    for begin, end in zip(ends[:-1], ends[1:]):
        n = end - begin
        if n >= words:
            own = np.sort(rolled[begin : end - words + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n:
            sets.append(np.array([xxhash.xxh3_64_intdigest(hashes[begin:end].tobytes(), seed=int(n))], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), offsets_of([len(s) for s in sets])
