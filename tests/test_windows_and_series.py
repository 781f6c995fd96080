import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnledger.operators import series, windows5h


def windows_by_loop(turns):
    """(start, turns) of each window, read in time order."""
    out = []
    for ts, interrupted in sorted(turns):
        if not interrupted and (not out or ts >= out[-1][0] + timedelta(hours=5)):
            out.append([ts.replace(minute=0, second=0, microsecond=0), 0])
        if out and out[-1][0] <= ts < out[-1][0] + timedelta(hours=5):
            out[-1][1] += 1
    return [tuple(w) for w in out]


def test_windows_open_late_and_at_exactly_five_hours(turns_of):
    at = lambda *hours: turns_of([{"ts": f"2024-01-01 {h}"} for h in hours])
    count = lambda df: windows5h.anchored_windows(df, ["session_id"]).count()
    assert count(at("10:15:00", "12:15:00", "16:15:00")) == 2
    assert count(at("10:15:00", "14:59:59")) == 1
    assert count(at("10:15:00", "15:00:00")) == 2
    assert windows5h.anchored_windows(at("10:15:00"), ["session_id"]).first().window_start == datetime(2024, 1, 1, 10)


@pytest.mark.parametrize("seed", range(3))
def test_windows_match_a_plain_loop(turns_of, seed):
    rng = random.Random(seed)
    rows, start = [], datetime(2024, 1, 1)
    for key in ("a", "b"):
        for _ in range(60):
            ts = start + timedelta(minutes=rng.randint(0, 60 * 60))
            rows.append({"session_id": key, "ts": str(ts), "is_interrupted": rng.random() < 0.4, "input_tokens": 1})
    got = {(r.session_id, r.window_start, r.turns) for r in windows5h.anchored_windows(turns_of(rows), ["session_id"]).collect()}
    want = set()
    for key in ("a", "b"):
        # equal timestamps are ordered by line
        own = [(datetime.fromisoformat(r["ts"]), n, r["is_interrupted"]) for n, r in enumerate(rows) if r["session_id"] == key]
        want |= {(key, *w) for w in windows_by_loop([(ts + timedelta(microseconds=n), i) for ts, n, i in own])}
    assert got == want


def test_projection(turns_of):
    turns = turns_of([{"ts": "2024-01-01 10:10:00", "output_tokens": 400_000}, {"ts": "2024-01-01 11:30:00", "output_tokens": 400_000}])
    row = windows5h.burn_projection(turns, "2024-01-01 12:00:00", 60).first()
    assert (row.cost_usd, row.recent_cost, row.recent_turns) == (20.0, 10.0, 1)
    assert row.projected_cost == pytest.approx(20 + 10 * 3) and not row.over_reference
    assert windows5h.burn_projection(turns, "2024-01-01 16:00:00", 60).count() == 0


def test_daily_fill_and_totals(turns_of):
    rows = turns_of([{"ts": "2024-01-02 01:00:00", "input_tokens": 10}, {"ts": "2024-01-04 23:59:59", "is_interrupted": True, "input_tokens": 9}])
    days = {str(r.date): r for r in series.daily(rows, "2024-01-01", "2024-01-04").collect()}
    assert list(sorted(days)) == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"]
    assert (days["2024-01-02"].input_tokens, days["2024-01-04"].turns, days["2024-01-04"].interrupted_turns, days["2024-01-04"].input_tokens) == (10, 1, 1, 0)
    assert series.hourly(rows, "2024-01-02", fill=True).count() == 24


@pytest.mark.parametrize("n, label, value", [(2, "cold", None), (3, "3d", 2.0), (6, "3d", 5.0), (9, "7d", 6.0)])
def test_baseline(spark, n, label, value):
    rows = spark.range(1, n + 1).select(F.expr("date_add(date'2024-01-01', cast(id as int))").alias("date"), F.col("id").cast("double").alias("m"))
    row = series.baselines(rows, ["m"], "2024-02-01").first()
    assert (row.baseline_label, row.baseline) == (label, value)
