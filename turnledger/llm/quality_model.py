"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Features are counts of hashed n-grams of a text's tokens (words and runs of
ASCII punctuation): lower-cased words, pairs of neighbours, and the same for the
tokens' shapes (case class, or the punctuation itself). A pair of equal words
counts as one feature, "repeat", whatever the word. Counts become sqrt(count /
all), so every text is a unit vector.

Training (McMahan et al. 2013) runs in ``SHARDS`` tasks over a bounded sample of
labelled rows; the shards' weights are averaged (parameter mixing). The model has
2^BITS weights at most, whatever the data. Scoring is one pass over the texts:
the sparse dot product of each text with the broadcast weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.arrays import blocks, mix, offsets_of

BITS = 18
#: Labelled rows that training reads at most (in expectation; chosen by a hash of the id).
MAX_ROWS = 20_000
SHARDS, EPOCHS = 8, 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.3, 0.3

_TOKENS = r"([!-/:-@\[-`{-~]+)"
_REPEAT = np.uint64(7)


def _shape(token: str) -> str:
    if not any(c.isalnum() for c in token):
        return token[:8]
    if token.isupper() and len(token) > 1:
        return "AA"
    return "Aa" if token[:1].isupper() else "a0" if any(c.isdigit() for c in token) else "aa"


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, values, offsets): the sparse unit vector of each text, flat."""
    spaced = pc.replace_substring_regex(pc.fill_null(text, ""), _TOKENS, r" \1 ")
    parts = pc.ascii_split_whitespace(spaced)
    flat = parts.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    ends = offsets_of(real)[offsets_of(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    names = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy(zero_copy_only=False)
    word = np.fromiter((xxhash.xxh3_64_intdigest(t.lower()) for t in names), np.uint64, len(names))[at]
    shape = np.fromiter((xxhash.xxh3_64_intdigest(_shape(t), seed=1) for t in names), np.uint64, len(names))[at]
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    inner = owner[1:] == owner[:-1]
    pair = mix(word[:-1] * np.uint64(3) + mix(word[1:]))
    pair[word[:-1] == word[1:]] = _REPEAT
    shape_pair = mix(shape[:-1] * np.uint64(5) + mix(shape[1:]))
    hashed = np.concatenate([word, shape, pair[inner], shape_pair[inner]])
    of = np.concatenate([owner, owner, owner[1:][inner], owner[1:][inner]])
    slot = (mix(hashed) >> np.uint64(64 - BITS)).astype(np.int64)
    cell, count = np.unique(of * (1 << BITS) + slot, return_counts=True)
    doc, slot = cell >> BITS, (cell & ((1 << BITS) - 1)).astype(np.int32)
    sums = np.bincount(doc, count, minlength=len(ends) - 1)
    return slot, np.sqrt(count / sums[doc]).astype(np.float32), offsets_of(np.bincount(doc, minlength=len(ends) - 1))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes of FTRL-proximal steps over (slots, values, label); the last weight is the intercept."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at=slice(None)) -> np.ndarray:
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for slots, values, label in rows:
            at, x = np.append(slots, 1 << BITS), np.append(values, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights()


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray:
    """The model of (doc_id, text) and (doc_id, quality), from rows outside the held-out fold only.

    Documents labelled both ways are left out; null labels, and labels without a
    document, do not count. Without any labelled text all weights are 0.
    """
    known = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    known = known.where("lo = hi").select("doc_id", F.col("lo").cast("double").alias("label"))
    share = min(1.0, max_rows / max(1, known.count()))
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    sample = known.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)))
    # at most about max_rows ids: safe to broadcast, so the texts stay where they are read
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(order.alias("turn"), "label", F.col("text").cast("string").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                slot, value, ends = features(block.column("text"))
                ends = pa.array(ends, pa.int32())
                columns = [block.column("turn"), block.column("label"), pa.ListArray.from_arrays(ends, pa.array(slot)), pa.ListArray.from_arrays(ends, pa.array(value))]
                yield pa.RecordBatch.from_arrays(columns, names=["turn", "label", "slots", "vals"])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["turn", "label"], kind="stable")
        w = ftrl(list(zip(part["slots"], part["vals"], part["label"])))
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": np.append(at, -1), "weight": np.append(w[at], 1.0)}).assign(shard=int(part["shard"].iloc[0]))  # slot -1 counts the shards

    rows = picked.mapInArrow(vectors, "turn bigint, label double, slots array<int>, vals array<float>")
    shard = F.pmod(F.xxhash64("turn"), F.lit(SHARDS)).cast("int")
    fitted = rows.withColumn("shard", shard).groupBy("shard").applyInPandas(fit, "slot bigint, weight double, shard int")
    # summed in the order of the shards, so that every run gives the same weights
    total = F.aggregate(F.sort_array(F.collect_list(F.struct("shard", "weight"))), F.lit(0.0), lambda acc, x: acc + x["weight"])
    sums = dict(map(tuple, fitted.groupBy("slot").agg(total).collect()))  # 2^BITS + 2 rows at most
    shards = sums.pop(-1, 1.0)
    model = np.zeros((1 << BITS) + 1, np.float32)
    model[list(sums)] = np.array(list(sums.values())) / shards
    return model


def probabilities(text: pa.Array, model: np.ndarray) -> np.ndarray:
    """Sparse dot products of the texts with the weights, as probabilities of label 1."""
    slot, value, ends = features(text)
    dots = np.zeros(len(ends) - 1)
    some = np.flatnonzero(np.diff(ends))
    if len(some):  # each text is summed by itself, so its score does not depend on its neighbours
        dots[some] = np.add.reduceat(model[slot].astype(np.float64) * value, ends[some])
    return 1 / (1 + np.exp(-np.clip(dots + model[-1], -30, 30)))


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """(doc_id, score) for every row: the probability of label 1 from the whole text; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(probabilities(block.column("text"), shared.value))], names=["doc_id", "score"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, score, predicted), predicted 1 from ``cut`` on.

    Only text is an input of a score. An empty or null text gets the score of the
    intercept, a null doc_id is never held out, repeated rows get equal scores.
    """
    scored = score(docs, train(docs, labels, max_rows))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject; scored next to the text, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                yield block.filter(pa.array(probabilities(block.column("text"), shared.value) >= cut))

    return docs.mapInArrow(run, docs.schema)
