"""Ranked lexical search by the Best Position Algorithm over impact lists.

For each query term a list holds the documents with the term by falling impact, the
integer the term adds to a document's score. A query reads its lists from the top.
Each document met is looked up in all lists at once (direct access), which gives its
score and marks its places in them. The best position of a list is the end of the
places seen without a gap; an unseen document stands behind it in every list, so it
scores at most the sum of the impacts there. That bound falls faster than one over
the places read last (Akbarinia, Pacitti and Valduriez 2007). Reading stops once it
is strictly below the score of the k-th document, so that equal scores are all met
and the smaller id wins.

Texts are cut into terms once, next to the scan; what is kept per document is its
length and the query terms in it. Lists are built per task over blocks of at most
``BLOCK`` postings, all queries run on a block, and a task hands on k documents a
query. Queries come in blocks of at most ``QUERY_CHARS`` characters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.llm.arrays import blocks, offsets_of
from turnledger.session import stored

K = 10
#: Postings of the lists in a task.
BLOCK = 1_500_000
#: Characters of the queries whose terms are looked for in one pass over the texts.
QUERY_CHARS = 4_000_000
TEXT_BYTES = 1_000_000
#: First rows read of each list; doubled from one round to the next.
READ = 16

#: Bytes of terms: letters (A-Z lower-cased), digits and all of a character beyond ASCII.
_TERM = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _TERM[_b] = _b
for _b in range(65, 91):
    _TERM[_b] = _b + 32


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in one flat array, and the offsets of each text in it."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    folded = pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(_TERM[raw]))
    parts = pc.ascii_split_whitespace(folded)
    flat = parts.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    of_text = offsets_of(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    return flat.filter(pa.array(real)), offsets_of(real)[of_text]


class Postings:
    """Impact lists of some documents: for each term, places in the order of falling impact."""

    def __init__(self, ids: np.ndarray, begin: np.ndarray, code: np.ndarray, impact: np.ndarray, terms: int):
        order = np.lexsort((-impact, code))
        self.ids, self.begin, self.code, self.impact = ids, begin, code, impact  # by document
        self.first = np.searchsorted(code[order], np.arange(terms + 1))  # of each list, in place order
        self.doc = np.repeat(np.arange(len(ids)), np.diff(begin))[order]
        self.falling = impact[order]
        self.place = np.empty(len(code), np.int64)
        self.place[order] = np.arange(len(code))

    def search(self, terms: np.ndarray, k: int, floor: int = 0, read: int = READ) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings read one after another) of the k best by score, then id, above 0; ``floor`` is a score that k others have already."""
        terms = terms[self.first[terms] < self.first[terms + 1]]
        begin, end = self.first[terms], self.first[terms + 1]
        wanted = np.zeros(len(self.first), bool)
        wanted[terms] = True
        seen, known = np.zeros(len(self.code) + 1, bool), np.zeros(len(self.ids), bool)
        best = begin.copy()  # first place of each list not seen without a gap
        docs, scores, at, touched = np.empty(0, np.int64), np.empty(0, np.int64), begin.copy(), 0
        while (at < end).any():
            upto = np.minimum(at + read, end)
            touched += int((upto - at).sum())
            fresh = np.unique(np.concatenate([self.doc[a:z] for a, z in zip(at.tolist(), upto.tolist())]))
            fresh = fresh[~known[fresh]]
            known[fresh] = True
            if len(fresh):  # direct access: all terms of the documents met
                n = np.diff(self.begin)[fresh]
                flat = np.repeat(self.begin[fresh] - offsets_of(n)[:-1], n) + np.arange(int(n.sum()))
                owner = np.repeat(np.arange(len(fresh)), n)
                mine = wanted[self.code[flat]]
                flat, owner = flat[mine], owner[mine]
                seen[self.place[flat]] = True
                total = np.bincount(owner, self.impact[flat], len(fresh)).astype(np.int64)  # below 2^53, so exact
                docs, scores = np.concatenate([docs, fresh]), np.concatenate([scores, total])
                top = np.lexsort((self.ids[docs], -scores))[:k]
                docs, scores = docs[top], scores[top]
            at, read = upto, 2 * read
            bound = 0
            for i, (a, z) in enumerate(zip(best.tolist(), end.tolist())):
                gap = int(np.argmin(seen[a : z + 1])) if z > a and not seen[a:z].all() else z - a
                best[i] = a + gap
                bound += int(self.falling[a + gap]) if a + gap < z else 0
            if bound < max(floor, int(scores[-1]) if len(scores) == k else 0):
                break
        real = scores > 0
        return docs[real], scores[real], touched


def _found(vocabulary: pa.Array, kind: str):
    """Per text with terms: how many, and the numbers and counts of the vocabulary's terms in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", TEXT_BYTES):
                flat, ends = terms_of(part.column("text"))
                code = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                hit = np.flatnonzero(code >= 0)
                each = np.sort((np.searchsorted(ends, hit, side="right") - 1) * (len(vocabulary) + 1) + code[hit])
                new = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]])) if len(each) else np.empty(0, np.int64)
                of = np.searchsorted(each[new] // (len(vocabulary) + 1), np.arange(part.num_rows + 1)).astype(np.int32)
                lists = lambda flat: pa.ListArray.from_arrays(pa.array(of), pa.array(flat.astype(np.int32)))  # noqa: B023, E731
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends)), lists(each[new] % (len(vocabulary) + 1)), lists(np.diff(np.append(new, len(each))))], names=["doc_id", "n", "codes", "counts"])
                yield out.filter(pa.array(np.diff(ends) > 0))

    return run


def _holding(size: int):
    """Documents per term of each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df = np.bincount(batch.column("codes").flatten().to_numpy(), minlength=size)
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["code", "df"])

    return run


def _run(weights: np.ndarray, documents: int, length: int, queries: list[np.ndarray], k: int, size: int):
    """The k best documents of each query among those of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)  # rank of a null id, id, score

        def settle(parts: list[pa.RecordBatch]) -> None:
            ids = pa.concat_arrays([p.column("doc_id").cast(pa.int64()) for p in parts])
            absent = ids.is_null().to_numpy(zero_copy_only=False)
            # rows in the order of ids, nulls last: a row's number decides between equal scores
            ids = pc.fill_null(ids, 0).to_numpy()
            n = np.concatenate([p.column("n").to_numpy() for p in parts])
            code, tf = (np.concatenate([p.column(c).flatten().to_numpy() for p in parts]).astype(np.int64) for c in ("codes", "counts"))
            begin = offsets_of(np.concatenate([pc.list_value_length(p.column("codes")).to_numpy() for p in parts]))
            m = 100 - 90 + (90 * n * documents) // max(length, 1)
            impact = weights[code] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(begin))))
            keep = impact > 0
            begin, code, impact = offsets_of(keep)[begin], code[keep], impact[keep]
            order = np.lexsort((ids, absent))
            number = np.empty(len(ids), np.int64)
            number[order] = np.arange(len(ids))
            lists = Postings(number, begin, code, impact, len(weights))
            for q, terms in enumerate(queries):
                held = best[q]
                docs, scores, _ = lists.search(terms, k, int(held[2][-1]) if len(held[2]) == k else 0)
                null, own, score = (np.concatenate(x) for x in zip(held, (absent[docs].astype(np.int64), ids[docs], scores)))
                top = np.lexsort((own, null, -score))[:k]
                best[q] = null[top], own[top], score[top]

        parts, postings = [], 0
        for batch in batches:
            per_row = pc.list_value_length(batch.column("codes")).to_numpy()
            at = 0
            while at < batch.num_rows:  # whole documents; a batch can hold more than a block
                room = np.cumsum(per_row[at:])
                end = at + max(1, int(np.searchsorted(room, size - postings, side="right")))
                parts.append(batch.slice(at, end - at))
                postings += int(room[end - at - 1])
                at = end
                if postings >= size or at < batch.num_rows:
                    settle(parts)
                    parts, postings = [], 0
        if parts:
            settle(parts)
        query = np.repeat(np.arange(len(queries)), [len(x[1]) for x in best])
        null, own, score = (np.concatenate([x[i] for x in best]) if best else np.empty(0, np.int64) for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(own, mask=null > 0), pa.array(score)], names=["query", "doc_id", "score"])

    return run


def _query_blocks(items: DataFrame, chars: int) -> Iterator[list[tuple]]:
    """[(item_id, [texts])] of all items with a text, in blocks of about ``chars`` characters; rows of one id are one item."""
    items = items.where("text is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct()
    n = -(-2 * (items.agg(F.sum(F.length("text"))).first()[0] or 0) // chars) or 1
    for k in range(n):
        part: dict = {}
        for item, text in (items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else items).collect():
            part.setdefault(item, []).append(text)
        yield list(part.items())


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK, query_chars: int = QUERY_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring rows of ``docs`` for each item, scores above 0 only.

    Equal scores rank by doc_id, null ids last; repeated rows of ``docs`` are
    documents of their own. Rows of ``items`` with one id are one item with the terms
    of all of them. Null texts have no terms; an item without terms, or whose terms
    no document holds, has no rows; empty tables give an empty result; other columns
    are not read. Counts of documents, terms and lengths cover the whole table.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    for part in _query_blocks(items, query_chars):
        flat, ends = terms_of(pa.array([t for _, texts in part for t in texts], pa.string()))
        vocabulary = pc.unique(flat)
        code = pc.index_in(flat, value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        of_item = ends[offsets_of([len(texts) for _, texts in part])]
        queries = [np.unique(code[a:z]) for a, z in zip(of_item[:-1], of_item[1:])]
        kind = docs.schema["doc_id"].dataType.simpleString()
        found = stored(rows.mapInArrow(_found(vocabulary, kind), f"doc_id {kind}, n bigint, codes array<int>, counts array<int>"), "query-terms")
        documents, length = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(max(len(vocabulary), 1), np.int64)
        for c, df in found.select("codes").mapInArrow(_holding(len(vocabulary)), "code bigint, df bigint").groupBy("code").agg(F.sum("df")).collect():
            weights[c] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        best = found.mapInArrow(_run(weights, documents, length, queries, k, block), "query bigint, doc_id bigint, score bigint").withColumn("some", F.pmod(F.spark_partition_id(), F.lit(64)))
        order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        for keys in (("query", "some"), ("query",)):  # in two steps, so that no task meets the documents of all tasks
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(part)], f"query bigint, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = best.join(names, "query").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out


def search_sql(k: int = K) -> str:
    """The same ranking on DuckDB over ``documents`` and ``benchmark``."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = f"unnest(regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""
with docs as (select row_number() over () as row, doc_id, text from documents),
words as (select row, doc_id, {terms} as term from docs),
sizes as (select row, count(*) as n from words group by row),
totals as (select count(*) as nn, cast(sum(n) as bigint) as ll from sizes),
tfs as (select row, doc_id, term, count(*) as tf from words group by all),
asked as (select distinct item_id, {terms} as term from benchmark),
dfs as (select term, count(*) as df from tfs where term in (select term from asked) group by term),
weights as (select term, cast(floor(1000 * ln((2.0 * nn + 2) / (2.0 * df + 1))) as bigint) as w from dfs, totals),
scored as (
  select item_id, row, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)))) as bigint) as score
  from asked join weights using (term) join tfs using (term) join sizes using (row), totals group by item_id, row, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from scored where score > 0)
select item_id, cast(place as integer) as rank, doc_id, score from ranked where place <= {k}"""
