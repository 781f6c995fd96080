"""Suffix arrays, ranked search, token alignment; the other operators on half surrogates, deep paths, short items, copies."""

import hashlib
import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from turnledger.llm import decontaminate, lexical_search, licenses, line_spread, mixing, quality_model, suffix_dedup, token_alignment, tool_calls, url_templates

DOC = "doc_id bigint, text string"
ODD = [(1, None), (2, ""), (3, " "), (4, "ab" * 700), (4, "ab" * 700), (5, "x" * 399), (None, "é" * 300), (6, "🙂 <|endoftext|> ▁ </s> \x00"), (7, "word " * 3000)]


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).select("doc_id", "text")


def with_clash(docs):
    return docs.selectExpr("*", "1 as t1", "'x' as key", "2 as score", "3 as item_id", "array(1) as spans")


# -- op11 ------------------------------------------------------------------------


def repeated(texts: list[bytes], length: int) -> list[list[bool]]:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [[seen[t[i : i + length]] > 1 for i in range(len(t) - length + 1)] for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=60), max_size=7), st.sampled_from([8, 12, 16, 24]), st.sampled_from([1, 2, 4, 8, 16]))
def test_repeated_starts_equal_plain_counts(texts, length, symbol):
    texts = [t.encode() for t in texts]
    assert [x.tolist() for x in suffix_dedup.repeated_starts(texts, length, symbol)] == repeated(texts, length)


@given(st.binary(max_size=200), st.integers(0, 180), st.integers(0, 60))
def test_range_minima(data, low, more):
    values = np.frombuffer(data, np.uint8)
    if low < len(values):
        high = min(low + more, len(values) - 1)
        assert suffix_dedup.RangeMinima(values).of(np.array([low]), np.array([high]))[0] == values[low : high + 1].min()


def test_prefixes_are_those_of_the_suffix_array(tmp_path):
    rng = random.Random(5)
    docs = [[rng.randint(1, 3) for _ in range(rng.randint(1, 30))] for _ in range(6)]
    flat, ends = np.array([s for d in docs for s in d]), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    work = suffix_dedup.Collection(str(tmp_path))
    suffixes, prefixes = work.build(flat, ends[:-1], ends[1:] - 1, 1)
    work.close()
    tail = lambda at: tuple(flat[at : ends[np.searchsorted(ends, at, side="right")]])
    rows = [tail(at) if at != 2**32 - 1 else () for at in suffixes.tolist()]
    assert rows == sorted(rows) and Counter(rows)[()] == len(docs) and len(rows) == len(flat) + len(docs)
    common = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    assert prefixes[1:].tolist() == [common(x, y) for x, y in zip(rows, rows[1:])]


@pytest.mark.parametrize("group", [512, 1])
def test_repeats_equal_brute_force(spark, sample, group):
    docs = sample.union(spark.createDataFrame(ODD, DOC))
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = []
    for (doc, data), flags in zip(rows, repeated([t for _, t in rows], 400)):
        gone = np.zeros(len(data) + 1, bool)
        for i in np.flatnonzero(flags):
            gone[i : i + 400] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        want.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])).hexdigest()))
    got = [tuple(r)[:5] for r in suffix_dedup.repeats(with_clash(docs), group=group).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[2] == 1400 for w in want) == 2 and suffix_dedup.repeats(docs.limit(0)).count() == 0


# -- op12 ------------------------------------------------------------------------


def ranked(docs, items, k=10):
    terms = lambda t: "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")).split(" ")
    bags = [(d, Counter(x for x in terms(t) if x)) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scores = []
        for d, bag in bags:
            m = 100 - 90 + (90 * sum(bag.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 8 * m)) for w in {x for x in terms(text) if x} if w in bag)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [40, lexical_search.BLOCK])
def test_search_equals_scores_of_all_documents(spark, sample, block):
    docs = sample.union(spark.createDataFrame([*ODD, (8, "The same, tie"), (9, "tie the SAME"), (10, "É1 é1 x_y")], DOC))
    items = spark.createDataFrame([(1, "the tie of same"), (2, None), (3, "!!"), (4, "é1 É1 nothing-else x"), (5, " ".join(sample.first().text.split()[:40])), (5, "tie"), (6, "ab")], "item_id bigint, text string")
    want = ranked([tuple(r) for r in docs.collect()], [(1, "the tie of same"), (4, "é1 É1 nothing-else x"), (5, " ".join(sample.first().text.split()[:40]) + " tie"), (6, "ab")])
    got = lexical_search.search(with_clash(docs), items, block=block, query_chars=60 if block == 40 else 10**6)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == want
    assert lexical_search.search(docs.limit(0), items).count() == 0 and lexical_search.search(docs, items.limit(0)).count() == 0


def test_search_stops_before_the_end_of_its_lists():
    rng = np.random.default_rng(1)
    n, terms = 4000, 6
    code = np.tile(np.arange(terms), n)
    impact = rng.integers(1, 50, n * terms)
    impact[: 20 * terms] += 1000
    lists = lexical_search.Postings(np.arange(n), np.arange(n + 1) * terms, code, impact, terms)
    docs, scores, touched = lists.search(np.arange(terms), 10)
    total = impact.reshape(n, terms).sum(axis=1)
    order = np.lexsort((np.arange(n), -total))[:10]
    assert docs.tolist() == order.tolist() and scores.tolist() == total[order].tolist() and touched < n


# -- op13 ------------------------------------------------------------------------


@given(st.lists(st.integers(0, 500), max_size=60), st.lists(st.integers(0, 500), max_size=200), st.integers(2, 9))
def test_gallop_finds_lower_bounds(needles, hay, stride):
    needles, hay = np.array(sorted(needles), np.int64), np.array(sorted(set(hay)), np.int64)
    assert token_alignment.gallop(needles, hay, np.zeros(len(needles), np.int64), stride).tolist() == np.searchsorted(hay, needles).tolist()


def test_alignment_equals_token_by_token(spark, sample):
    from pathlib import Path

    import sentencepiece
    from tokenizers import Tokenizer

    folder = Path(token_alignment.TOKENIZERS)
    first = Tokenizer.from_file(str(folder / token_alignment.A_FILE))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=str(folder / token_alignment.B_FILE))
    both = token_alignment.Aligner(*((folder / f).read_bytes() for f in (token_alignment.A_FILE, token_alignment.B_FILE)))
    docs = sample.union(spark.createDataFrame([*ODD, (8, "a  b  漢字 Ⅷ ﬁ"), (9, "▁")], DOC))
    counts, told = Counter(), []
    for doc, text in (tuple(r) for r in docs.collect()):
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        parts = [[t.bytes[i] for i in ids] for t, ids in ((both.a, a), (both.b, b))]
        if any(b"".join(p) != b" " + (text or "").encode() for p in parts):
            a, b = [], []
        i = j = x = y = 0
        groups, links, mine = [], [], ([], [])
        while a and i < len(a):
            if not mine[0]:
                mine = ([a[i]], [b[j]])
                x, y = x + len(parts[0][i]), y + len(parts[1][j])
            links.append((a[i], b[j]))
            if x == y:
                groups.append(mine)
                mine, i, j = ([], []), i + 1, j + 1
            elif x < y:
                i += 1
                mine[0].append(a[i])
                x += len(parts[0][i])
            else:
                j += 1
                mine[1].append(b[j])
                y += len(parts[1][j])
        counts.update(links)
        told.append((doc, a, b, groups, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = []
    for doc, a, b, groups, links in told:
        line = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        want.append((doc, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(line.encode()).hexdigest() if a else ""))
    got = token_alignment.report(with_clash(docs), slice_rows=500)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    shown = {(r.doc_id, len(r.a)): r for r in token_alignment.alignments(docs.where("doc_id = 8")).collect()}
    _, a, b, groups, _ = next(x for x in told if x[0] == 8)
    row = shown[8, len(a)]
    assert row.a == a and row.b == b and row.group_a == np.cumsum([len(g[0]) for g in groups]).tolist() and row.group_b == np.cumsum([len(g[1]) for g in groups]).tolist()
    assert token_alignment.report(docs.limit(0)).count() == 0


# -- the others ------------------------------------------------------------------


def test_tool_arguments_stay_json(spark):
    deep = "[" * 900 + "]" * 900
    raw = ['{"text":"\\ud83d"}', '"\\ud83d"', '{"text":NaN}', '{"text":1e400}', '{"text":' + deep + "}", '{"\\udc00":1}', '{"text":"\\ud83d\\ude00"}']
    rows = [(1, k, "assistant", '{"tool_calls":[{"id":"c%d","name":"count","arguments":%s}]}' % (k, a)) for k, a in enumerate(raw)]
    rows += [(2, k, "assistant", json.dumps({"tool_calls": [{"id": f"s{k}", "name": "count", "arguments": a}]})) for k, a in enumerate(raw)]
    rows += [(3, 0, "user", '{"content":"hi"}'), (3, 1, "assistant", '{"tool_calls":[]}'), (3, 2, None, None)]
    got = {(r.conv_id, r.id): r for r in tool_calls.link(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    for r in got.values():
        json.loads(r.json, parse_constant=lambda word: pytest.fail(word))
    assert all((2, f"s{k}") in got for k in range(len(raw))) and not any(c == 3 for c, _ in got)
    assert got[2, "s0"].problem is None and "\\ud83d" in got[2, "s0"].json
    assert got[2, "s2"].problem == "not JSON" and got[2, "s3"].problem == "number out of range" and got[2, "s6"].problem is None


def test_copies_are_one_site_and_short_documents_lose_their_boilerplate(spark):
    line, menu = "This line stands on every site of the corpus and says nothing.", "Menu"
    copy = "\n".join(f"Line {k} of a text that was copied to all sites." for k in range(12))
    rows = [(k, f"s{k}", f"{line}\nOwn {k}.\n{menu}") for k in range(8)] + [(100 + k, f"s{k}", copy) for k in range(9)]
    edited = [(200 + k, f"s{k}", copy.replace(f"Line {k} ", f"Row {k} ")) for k in range(9)]
    docs = spark.createDataFrame(rows + edited, "doc_id bigint, source string, text string")
    got = {r.doc_id: r.text for r in line_spread.remove_spread_lines(docs).collect()}
    assert all(got[k] == f"Own {k}." for k in range(8))
    assert all(got[i] == t for i, _, t in rows[8:] + edited)


def test_knapsack_covers_long_texts():
    assert mixing.fit_budget(np.array([200_000, 150_000]), np.array([1, 1]), 300_000).tolist() == [1, 0]
    assert (np.array([140_001, 90_002]) * mixing.fit_budget(np.array([140_001, 90_002]), np.array([2, 3]), 320_005)).sum() == 140_001 + 2 * 90_002


def test_scores_do_not_depend_on_neighbours(spark, sample):
    texts = [r.text for r in sample.collect()] + ["", None]
    model = np.random.default_rng(2).normal(size=(1 << quality_model.BITS) + 1).astype(np.float32)
    forth, back = quality_model.probabilities(pa.array(texts, pa.string()), model), quality_model.probabilities(pa.array(texts[::-1], pa.string()), model)
    assert forth.tolist() == back[::-1].tolist() == [quality_model.probabilities(pa.array([t], pa.string()), model)[0] for t in texts]


def test_quotations_and_short_items_are_found():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, text(40)) for k in range(20)] + [(100 + n, text(9)[:n].strip()) for n in range(8, 21)]
    index, clean = decontaminate.Pieces(items), [text(200) for _ in range(40)]
    for k, item in items[:20]:
        for length in (80, 100, 140):
            at = rng.randrange(len(item) - length)
            quoted = list(item[at : at + length])
            for edits in (0, 3):
                for _ in range(edits):
                    quoted[rng.randrange(length)] = "z"
                assert k in {x[1] for x in index.find(pa.array([f"{clean[k]} {''.join(quoted)} {clean[k + 1]}"]))}
    for k, item in items[20:]:
        edited = item if len(item) < 13 else item[:5] + "z" + item[6:]
        assert k in {x[1] for x in index.find(pa.array([f"{clean[0]}, {edited.upper()}! {clean[1]}"]))}


def test_every_window_is_aligned_with_every_text():
    """The whole filter against the plain rule: some window of an item within its edits anywhere in a text."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("abcde ", k=n))
    items = [(1, text(90)), (2, text(72)), (3, text(40)), (4, text(14))]
    texts = [text(150) for _ in range(6)]
    for _, item in items:
        for edits in (0, 3, 6, 9):
            part = list(item[: rng.randint(max(8, len(item) - 20), len(item))] if len(item) > 72 else item)
            for _ in range(edits):
                part[rng.randrange(len(part))] = rng.choice("abcdez")
            texts.append(text(30) + "".join(part) + text(30))
    fold = lambda t: " ".join(t.split())
    want = set()
    for d, t in enumerate(texts):
        for item, body in items:
            body, t_ = fold(body), fold(t)
            m = min(len(body), decontaminate.PIECE)
            if any(decontaminate.edits_within(body[s : s + m].encode(), t_.encode(), int(decontaminate.RATE * m)) is not None for s in range(len(body) - m + 1)):
                want.add((d, item))
    got = {(x[0], x[1]) for x in decontaminate.Pieces(items).find(pa.array(texts))}
    assert got <= want and len(got) >= 0.9 * len(want) and {1, 2, 3, 4} <= {item for _, item in got}


def test_labels_reach_other_hosts_and_deep_paths(spark):
    deep = "/".join(f"d{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    urls = [(k, f"http://bad{k % 5}.net/win/{k}", 1) for k in range(40)] + [(100 + k, f"http://good{k % 5}.org/news/{k}", 0) for k in range(40)]
    urls += [(200, "http://new.com/win/7", None), (201, "http://new.com/news/7", None), (202, f"http://new.com/{deep}/end", None), (203, f"http://new.com/{deep}/other", None), (204, None, None)]
    labels = spark.createDataFrame([(p, b) for p, _, b in urls if b is not None], "page_id bigint, bad int")
    got = {r.page_id: r for r in url_templates.judge(spark.createDataFrame([(p, u) for p, u, _ in urls], "page_id bigint, url string"), rules=(), labels=labels).collect()}
    assert got[200].verdict == "block" and got[201].verdict == "allow" and got[200].purity > 0.7 > 0.3 > got[201].purity
    assert got[202].template == f"/{deep}/end" and got[203].template == f"/{deep}/other" and got[204].host == ""


@pytest.mark.parametrize("notice, label", [
    ("SPDX-License-Identifier: MIT", "spdx-mit"), ("Licensed under Apache-2.0", "apache-short"), ("SPDX-License-Identifier: GPL-3.0-or-later", "spdx-gpl-3.0-or-later"),
    ("Redistributions in binary form must reproduce the above copyright notice", "bsd-binary"), ("distributed under GPL v2", "gpl-2.0-short"),
])
def test_notices_are_labelled(notice, label):
    index = licenses.Index()
    ids, ends = index.numbered(pa.array([f"plain words before {notice} and after", "plain words only"]))
    found = index.intersected(ids, ends)
    assert [d for d, _ in found] == [0] and label in licenses.templates_in(ids[: ends[1]], index, found[0][1])


def test_texts_of_the_suffix_array_come_in_small_batches(spark, monkeypatch):
    plain = suffix_dedup._marks

    def bounded(length, anchor):
        marks = plain(length, anchor)

        def run(batches):
            def seen():
                for batch in batches:
                    assert batch.num_rows <= 500
                    yield batch

            return marks(seen())

        return run

    monkeypatch.setattr(suffix_dedup, "_marks", bounded)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(0, 1200, 1, 1).selectExpr("id as doc_id", "repeat(sha2(string(id), 256), 7) as text")
    assert suffix_dedup.repeats(docs).count() == 1200
