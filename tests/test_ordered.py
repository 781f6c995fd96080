import random

import pytest
from pyspark.sql import functions as F

from turnledger.operators import attribution, ordered, patterns


def test_scan_matches_a_plain_loop_across_chunks(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, rng.randint(0, 9)])) for k in "abc" for i in range(50) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint").withColumn("chunk", F.floor(F.col("i") / 4))
    got = {
        (r.k, r.i): (r.s, r.m, r.l)
        for r in ordered.scan(df, ["k"], ["i"], "chunk", {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}).collect()
    }
    for key in "abc":
        seen = []
        for k, i, v in rows:
            if k != key:
                continue
            known = [x for x in seen if x is not None]
            assert got[(k, i)] == (sum(known), max(known, default=None), known[-1] if known else None)
            seen.append(v)


def test_hot_key_is_split_over_chunks(spark):
    """One key with every row: no window partition may hold more than one chunk."""
    key = F.when(F.col("id") >= 0, "hot")
    df = spark.range(1000).select(key.alias("k"), F.col("id").alias("i")).withColumn("chunk", F.floor(F.col("i") / 100))
    plan = ordered.with_position(df, ["k"], ["i"], "chunk", "pos")._jdf.queryExecution().executedPlan().toString()
    big = [line for line in plan.splitlines() if "Window [" in line and "i#" in line.split("specifiedwindowframe")[0]]
    assert big and all("chunk" in line for line in big)
    assert ordered.with_position(df, ["k"], ["i"], "chunk", "pos").filter("pos <> i").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_disjoint_choice_matches_greedy(spark, seed):
    rng = random.Random(seed)
    reach, spans = 5, []
    for key in ("a", "b"):
        for first in range(120):
            if rng.random() < 0.5:
                spans.append((key, first, first + rng.randint(0, reach)))
    df = spark.createDataFrame(spans, "session_id string, first bigint, last bigint")
    got = {(r.session_id, r.first) for r in ordered.pick_disjoint(df, ["session_id"], reach, size=8, fanout=2).collect()}
    want = set()
    for key in ("a", "b"):
        free = 0
        for k, first, last in spans:
            if k == key and first >= free:
                want.add((k, first))
                free = last + 1
    assert got == want


def epochs_by_loop(pools):
    """Line numbers that start a new epoch, read one line at a time."""
    peak, resets = 0, []
    for line, pool in pools:
        if pool is None:
            continue
        if peak > 0 and pool < 0.2 * peak:
            resets.append(line)
            peak = pool
        else:
            peak = max(peak, pool)
    return resets


@pytest.mark.parametrize("seed, size, fanout", [(0, 4, 2), (1, 3, 3), (2, 7, 2), (3, 1000, 4)])
def test_compaction_epochs_match_a_plain_loop(spark, seed, size, fanout):
    rng = random.Random(seed)
    rows = []
    for f in range(12):
        scale = rng.choice([5, 60, 1000])
        for line in range(1, rng.randint(2, 90)):
            rows.append((f"f{f}", line, None if rng.random() < 0.3 else int(scale * rng.random() ** rng.choice([1, 3, 6]))))
    df = spark.createDataFrame(rows, "file string, line bigint, pool bigint")
    epochs = attribution.compaction_epochs(df, size, fanout)
    got = {(r.file, line) for r in epochs.collect() for line in r.resets}
    want = {(f, line) for f in {r[0] for r in rows} for line in epochs_by_loop([(ln, p) for g, ln, p in rows if g == f])}
    assert got == want
    placed = attribution.with_epoch(df, epochs, size)
    assert placed.count() == len(rows)
    for r in placed.collect():
        assert r.epoch == sum(1 for f, line in want if f == r.file and line <= r.line)


def cycles_by_loop(ctx):
    found, i = [], 0
    while i < len(ctx):
        low = next((j for j in range(i + 1, min(i + 6, len(ctx))) if ctx[j] <= (1 - 0.8) * ctx[i]), None) if ctx[i] else None
        back = next((k for k in range(low + 1, min(low + 6, len(ctx))) if ctx[k] >= 0.8 * ctx[i]), None) if low is not None else None
        if back is None:
            i += 1
        else:
            found.append((i, low, back))
            i = back + 1
    return found


def storms_by_loop(turns):
    found, i = [], 0
    while i + 10 <= len(turns):
        uses, errors = sum(u for u, _ in turns[i : i + 10]), sum(e for _, e in turns[i : i + 10])
        if uses and errors / uses > 0.2:
            found.append(i)
            i += 10
        else:
            i += 1
    return found


def test_detectors_match_plain_loops(spark):
    rng = random.Random(5)
    rows = []
    for s in range(4):
        for i in range(150):
            ctx = rng.choice([0, 10, 100, 1000, 900, 5])
            uses = rng.randint(0, 3)
            rows.append((f"s{s}", i, ctx, uses, rng.randint(0, uses) if rng.random() < 0.4 else 0))
    df = spark.createDataFrame(rows, "session_id string, turn_idx bigint, ctx bigint, tool_use_count bigint, tool_error_count bigint")
    cycles = {(r.session_id, r.first, r.low, r.last) for r in patterns.reinflation_cycles(df, size=16).collect()}
    storms = {(r.session_id, r.first_turn) for r in patterns.tool_error_storm(df, size=16).collect()}
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s]
        assert {c[1:] for c in cycles if c[0] == s} == set(cycles_by_loop([r[2] for r in own]))
        assert {i for k, i in storms if k == s} == set(storms_by_loop([(r[3], r[4]) for r in own]))
