"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnledger.llm import decontaminate, licenses, line_spread, mixing, near_dup, quality_model, quality_rules, secrets, tool_calls, url_templates

LONG = "word " * 60_000 + "token=abcdef0123456789 end."
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away again.", "s1"),
    (1, "the quick brown fox jumps over the lazy dog and runs away again.", "s1"),
    (2, None, "s1"), (3, "", None), (4, " \t\n ", "s2"), (5, LONG, "s2"), (None, "a text without an id.", None), (6, "The quick brown fox jumps over the lazy dog and runs away again.", "s3"),
]
CLASH = ["key", "n", "size", "_maybe", "word", "root", "turn", "label", "found", "n_words", "kept", "score", "_lines", "_k1", "h1", "a", "b", "target"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string")
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (2, 1), (5, 0), (5, 0), (None, 1), (9, None)], "doc_id bigint, quality int")


@pytest.fixture(scope="module")
def bench(spark):
    items = [(1, "Quick brown fox jumps over the lazy dog and runs"), (2, None), (None, "x" * 50), (3, ""), (4, "tiny")]
    return spark.createDataFrame(items, "item_id bigint, text string")


def per_document(labels):
    return {
        "secrets": secrets.report, "rules": quality_rules.report, "lines": line_spread.line_report, "licences": licenses.scan,
        "near": near_dup.near_duplicates, "mix": mixing.mix, "quality": lambda d: quality_model.classify(d, labels),
    }


@pytest.mark.parametrize("name", ["secrets", "rules", "lines", "licences", "near", "mix", "quality"])
def test_one_row_per_row(docs, nothing, labels, name):
    run = per_document(labels)[name]
    got = run(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    first, second = (r for r in got if r.doc_id == 1)
    assert name == "mix" or first == second
    assert run(nothing).collect() == []


def test_defined_results(docs, labels):
    near = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect()}
    assert near[6].component_id == 1 and not near[6].kept and near[1].kept
    assert near[2].n_shingles == near[3].n_shingles == near[4].n_shingles == 0 and near[2].kept and near[2].component_id == 2
    assert near[None].component_id is None and near[None].kept
    rules = {r.doc_id: r for r in quality_rules.report(docs).collect()}
    assert rules[2].base_failed and rules[2].n_words == 0 and rules[5].n_repeat_words >= 60_000 and not rules[5].kept
    found = {r.doc_id: r for r in secrets.report(docs).collect()}
    assert found[5].n_assign == 1 and found[5].spans.startswith("assign:300000:") and found[2].spans == ""
    scores = {r.doc_id: r.score for r in quality_model.classify(docs, labels).collect()}
    assert scores[2] == scores[3] and not any(r.held_out for r in quality_model.classify(docs, labels).where("doc_id is null").collect())
    untrained = quality_model.classify(docs, labels.limit(0)).select("score", "predicted").distinct().collect()
    assert [tuple(r) for r in untrained] == [(0.5, 1)]


def test_leaks(docs, nothing, bench):
    rows = decontaminate.leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 1), (1, 1), (6, 1)]
    text = ROWS[0][1]
    assert all(text[r["first"] : r["last"]] == "quick brown fox jumps over the lazy dog and runs" for r in rows)
    assert decontaminate.leaks(nothing, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaking(docs, bench).count() == len(ROWS) - 3
    assert decontaminate.drop_leaking(docs, bench).columns == docs.columns


def test_pipeline_stages(spark, docs, nothing, labels, bench, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, nothing):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, str(tmp_path))
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == frame.columns, name
            assert out.count() <= frame.count()


def test_urls_and_calls(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Net"), (5, "https://x.NET/a?b"), (6, "://org/fr/x#y"), (7, "http://h/" + "a/" * 5000), (7, "http://h/" + "a/" * 5000)]
    pages = spark.createDataFrame([(*u, 1, 2) for u in urls], "page_id bigint, url string, host int, n int")
    got = {r.page_id: r for r in url_templates.judge(pages).collect()}
    assert url_templates.judge(pages).count() == len(urls) and url_templates.judge(pages.limit(0)).count() == 0
    assert (got[1].host, got[1].path, got[1].rule) == ("", "", None) and got[3].host == ""
    assert (got[4].host, got[4].rule) == ("a.net", None) and (got[5].rule, got[5].verdict) == ("net/", "block")
    assert (got[6].rule, got[6].verdict, got[6].path) == ("org/fr/", "allow", "/fr/x")
    odd = [(1, 0, "assistant", None), (1, 1, "assistant", "{"), (None, 2, "tool", '{"tool_call_id":"a"}'), (1, 3, "tool", '{"tool_call_id":"a","content":"r"}'), (1, None, "user", "")]
    messages = spark.createDataFrame([(*m, 5) for m in odd], "conv_id bigint, turn bigint, role string, text string, id int")
    assert [(r.id, r.status, r.json) for r in tool_calls.link(messages).collect()] == [("a", "orphan", '{"id":"a","result":"r"}')]
    assert tool_calls.link(messages.limit(0)).count() == 0
