import json

import pytest
from pyspark.sql import functions as F

from turnledger.functions.money import usd
from turnledger.operators import attribution, entity, patterns, topk
from turnledger.plans import breakdown, panels, rollups, turns as turn_plan
from turnledger.sources import logs, reconcile
from turnledger.streaming import ingest


def test_ranking_breaks_ties_by_name_and_sums_the_tail(spark):
    df = spark.createDataFrame([("b", 5.0), ("a", 5.0), ("d", 1.0), ("c", 2.0)], "name string, v double")
    got = {r.name: (r.v, r.members) for r in topk.head_and_other(df, "name", "v", 2).collect()}
    assert got == {"a": (5.0, None), "b": (5.0, None), "other": (3.0, 2)}
    assert topk.head_and_other(df, "name", "v", 4).count() == 4


@pytest.mark.parametrize("n, rows", [(6, 6), (7, 6)])
def test_models_collapse_only_beyond_the_limit(spark, n, rows):
    df = spark.range(n).select(F.col("id").cast("string").alias("model"), F.col("id").alias("v"), F.col("id").alias("o"))
    got = topk.keep_if_few(df, "model", "v", "o").collect()
    assert len(got) == rows and sum(r.v for r in got) == n * (n - 1) / 2


def test_nested_directories_roll_up_to_the_shortest(spark):
    rows = [("1", "/d/p"), ("2", "/d/p/b"), ("3", "/d/p/b/c"), ("4", "/d/pq"), ("5", None), ("6", "/e/x/y")]
    got = {r.session_id: r.project for r in entity.canonical_cwd(spark.createDataFrame(rows, "session_id string, cwd string")).collect()}
    assert got == {"1": "/d/p", "2": "/d/p", "3": "/d/p", "4": "/d/pq", "5": "(unknown)", "6": "/e/x/y"}


def test_labels_grow_until_unique(spark):
    cwds = ["/a/m/x", "/b/m/x", "/c/y", "/q/x"]
    got = {r.cwd: r.label for r in entity.labels(spark.createDataFrame([(c,) for c in cwds], "cwd string")).collect()}
    assert got == {"/a/m/x": "a/m/x", "/b/m/x": "b/m/x", "/q/x": "q/x", "/c/y": "y"}


def test_strict_report_fails_on_an_assumption(turns_of):
    assert turn_plan.assert_no_assumptions(turns_of([{}])).count() == 1
    with pytest.raises(Exception, match="strict"):
        turn_plan.assert_no_assumptions(turns_of([{"model": "gemini-1"}])).collect()


def test_reconcile_against_a_totals_file(spark, tmp_path, turns_of):
    turns = turns_of([{"output_tokens": 400_000}])  # 10 USD
    path = tmp_path / "t.json"
    path.write_text(json.dumps([{"cost": 4.0}, {"cost": 0, "totalCost": 6.1}]))
    row = reconcile.compare(turns, reconcile.read_totals(spark, str(path))).first()
    assert row.status == "OK" and row.theirs == pytest.approx(10.1)
    path.write_text(json.dumps({"totalCost": 20.0}))
    assert reconcile.compare(turns, reconcile.read_totals(spark, str(path))).first().status == "FAIL"


def test_split_roots():
    assert logs.split_roots("/a:/b,s3a://c/d") == ["/a", "/b", "s3a://c/d"]


def test_patterns_on_hand_made_sessions(turns_of):
    rows = [{"ts": "2024-01-01 00:00:00", "cache_creation_tokens": 10}, {"ts": "2024-01-01 01:00:00", "cache_creation_tokens": 90, "input_tokens": 10}]
    rows += [{"session_id": "p", "ts": f"2024-01-01 02:{n:02d}:00", "cache_read_tokens": 950_000} for n in range(20)]
    rows += [{"session_id": "x", "is_sidechain": n == 1, "output_tokens": 10, "ts": f"2024-01-01 03:00:0{n}"} for n in range(2)]
    hits = {(r.session_id, r.kind): r for r in patterns.detect_patterns(patterns.numbered(turns_of(rows))).collect()}
    assert set(hits) == {("s", "idle_expiry"), ("p", "context_ceiling_plateau"), ("x", "sidechain_explosion")}
    assert hits[("s", "idle_expiry")].headline == "Prompt cache expired during a 1.0h idle gap before turn 1."
    assert (hits[("p", "context_ceiling_plateau")].n_turns, hits[("p", "context_ceiling_plateau")].severity) == (20, "amber")
    assert hits[("x", "sidechain_explosion")].reason == "$0.00 of $0.00 billed was sidechain."


def test_both_split_modes_keep_the_total(spark, turns_of):
    rows = turns_of([{"input_tokens": 100, "output_tokens": 50, "cache_read_tokens": 1000, "line": n} for n in range(4)])
    pool = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    blocks = spark.createDataFrame(
        [("f", n, 0, "tool_use", ["Read", "Bash"][n % 2], str(n), None, 10 + n) for n in range(4)],
        "file string, line bigint, pos bigint, kind string, name string, block_id string, tool_use_id string, nbytes bigint",
    )
    per_tool, rest = attribution.attribute(rows.withColumn("pool", pool), blocks)
    total = rows.agg(F.sum(usd(F.col("cost_units")))).first()[0]
    for mode in (breakdown.PRORATA, breakdown.EXCLUDE_READS):
        assert breakdown.tool_breakdown(rows, per_tool, rest, mode).agg(F.sum("cost_usd")).first()[0] == pytest.approx(total)


def test_late_rows_go_aside(turns_of):
    on_time, late = ingest.split_late(turns_of([{"ts": "2024-01-01"}, {"ts": "2024-01-03"}]), "2024-01-02")
    assert (on_time.count(), late.count()) == (1, 1)


def test_only_one_side_may_compare(turns_of, spark):
    with pytest.raises(ValueError):
        panels.timeline(turns_of([{}]), spark.createDataFrame([], "session_id string, project string"), "cost", "day", "2024-01-01", "2024-01-01", "compare", "compare")


def test_dominant_model_tie_goes_to_the_first_seen(turns_of):
    rows = turns_of([{"model": "b"}, {"model": "a"}, {"model": "a"}, {"model": "b"}])
    assert rollups.dominant_model(rows, ["session_id"]).first().model == "b"
