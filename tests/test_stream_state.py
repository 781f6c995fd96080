"""Saved state between batches: parts merged by age, open windows, tallies of files, appends that were cut off."""

import datetime as dt
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from turnledger import session
from turnledger.operators import attribution
from turnledger.plans import breakdown, turns as turn_plan
from turnledger.sources import history
from turnledger.streaming import ingest, projection, tallies
from turnledger.streaming.parts import Parts

DAY = dt.datetime(2024, 1, 5)


def turn(n, hour=0, minute=0, session="s", file="f", interrupted=False, model="claude-opus-4-7", key=None):
    return (file, n, DAY + dt.timedelta(hours=hour, minutes=minute), key or f"k{n}", session, model, 1000, 10, 0, 0, 0, interrupted, False, {"Read": 1}, "u")


TURN = """file string, line long, ts timestamp, dedup_key string, session_id string, model string, input_tokens long, output_tokens long,
  cache_read_tokens long, cache_creation_tokens long, cache_creation_1h_tokens long, is_interrupted boolean, is_sidechain boolean, tool_names map<string,long>, uuid string"""


def turns_of(spark, rows):
    raw = spark.createDataFrame(rows, TURN).withColumns({c: F.lit(None).cast(t) for c, t in {"stop_reason": "string", "attribution_skill": "string", "skill_names": "map<string,bigint>"}.items()})
    return turn_plan.build_turns(raw.withColumns({"tool_use_count": F.lit(1).cast("bigint"), "tool_error_count": F.lit(0).cast("bigint")}))


def test_parts_stand_in_one_folder_per_bit(spark, tmp_path):
    parts = Parts(spark, str(tmp_path), "k string, n long", by="k", fold=lambda df: df.groupBy("k").agg(F.sum("n").alias("n")))
    want = {}
    for batch in range(5):
        assert parts.count() == batch
        rows = [(f"k{i}", batch + 1) for i in range(batch, batch + 3)]
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        for _ in range(1 + (batch == 3)):  # a batch that runs again
            parts.add(spark.createDataFrame(rows, "k string, n long"), batch)
    assert {r.k: r.n for r in parts.read().collect()} == want
    assert Parts.places(7) == [(2, 3), (1, 5), (0, 6)] and Parts.places(8) == [(3, 7)]
    some = parts.read(near=spark.createDataFrame([("k3",)], "k string"))
    assert "PartitionFilters: [isnotnull(bucket" in some._jdf.queryExecution().toString()
    assert {r.k: r.n for r in some.collect()}["k3"] == want["k3"]
    assert parts.read(before=2).groupBy().agg(F.sum("n")).first()[0] == 3 * 1 + 3 * 2


def test_a_prepared_batch_is_not_seen(spark, tmp_path):
    parts = Parts(spark, str(tmp_path), "n long")
    parts.prepare(spark.createDataFrame([(1,)], "n long"), 0)
    assert parts.count() == 0 and parts.read().count() == 0 and parts.prepared(0).count() == 1
    parts.finish(0)
    assert parts.count() == 1 and parts.read().count() == 1


def place(minute, line=1):
    return (DAY + dt.timedelta(minutes=minute), "f", line)


@pytest.mark.parametrize("minutes, now, start", [
    ({0: 1, 120: 1, 359: 1}, 360, 300),  # the third turn is past the first window's five hours
    ({0: 1, 299: 1}, 300, 0),
    ({0: 1}, 301, None),
    ({61: 1}, 62, 60),  # floored to the hour
    ({}, 10, None),
])
def test_open_window(minutes, now, start):
    base = int(dt.datetime(2024, 1, 5, tzinfo=dt.UTC).timestamp()) // 60
    found = projection.open_window({base + m: (n, 10**10, 5, place(m), []) for m, n in minutes.items()}, base + now, 60)
    assert (found and found["start"] - base) == start


def test_interrupted_turns_count_after_the_opening_one():
    base = int(dt.datetime(2024, 1, 5, tzinfo=dt.UTC).timestamp()) // 60
    minutes = {base: (0, 0, 0, None, [place(0)]), base + 5: (1, 2 * 10**10, 5, place(5, 3), [place(5, 2), place(5, 4)]), base + 9: (0, 0, 0, None, [place(9)])}
    found = projection.open_window(minutes, base + 10, 60)
    assert found["recent_turns"] == 3 and found["recent_cost"] == 2.0 and found["projected_cost"] == pytest.approx(2 + 2 * 290 / 60)


def test_state_processor_needs_no_installed_package(tmp_path):
    (tmp_path / "pickled").write_bytes(cloudpickle.dumps(projection.OpenWindow(20)))
    code = """import pickle, sys
processor = pickle.load(open("pickled", "rb"))
assert not any(m.startswith("turnledger") for m in sys.modules)
opened = processor.handleInputRows.__globals__["open_window"]
assert opened({0: (1, 10**10, 5, (0, "f", 1), [])}, 1, 60)["start"] == 0"""
    outside = [p for p in sys.path if p and not (tmp_path.parent / p / "turnledger").exists()]
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": ":".join(outside)}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


def test_quiet_keys_are_cleared(spark, tmp_path):
    def land(rows, n):
        ingest.append_updates(f"{tmp_path}/minutes")(projection.minute_parts(turns_of(spark, rows), "session_id"), n)
        projection.run(spark, f"{tmp_path}/minutes", str(tmp_path / "out"), 60)

    land([turn(1, 0, session="quiet"), turn(2, 1, session="busy")], 0)
    land([turn(3, 30, session="busy")], 1)
    land([turn(4, 31, session="quiet"), turn(5, 31, 1, session="busy")], 2)
    rows = {(r.key, r.batch): r for r in projection.projections(spark, str(tmp_path / "out")).collect()}
    assert rows["busy", 2].window_start == DAY + dt.timedelta(hours=30) and rows["busy", 2].recent_turns == 1
    assert rows["quiet", 2].window_start == DAY + dt.timedelta(hours=31) and set(rows) == {("quiet", 0), ("busy", 0), ("busy", 1), ("quiet", 2), ("busy", 2)}


def test_a_minute_that_comes_in_two_batches(spark, tmp_path):
    for n, rows in enumerate([[turn(1, 0, 10), turn(2, 0, 9, interrupted=True)], [turn(3, 0, 10), turn(4, 0, 9)]]):
        ingest.append_updates(f"{tmp_path}/minutes")(projection.minute_parts(turns_of(spark, rows), "session_id"), n)
        projection.run(spark, f"{tmp_path}/minutes", str(tmp_path / "out"), 60)
    last = projection.projections(spark, str(tmp_path / "out")).filter("batch = 1").first()
    assert (last.as_of, last.window_start, last.recent_turns) == (DAY + dt.timedelta(minutes=11), DAY, 3)


def test_an_append_compares_keys_without_the_turns(spark, tmp_path, monkeypatch):
    written = {}

    def stored(df, name):
        written.setdefault(name, []).append(df)
        return session.stored(df, name)

    monkeypatch.setattr(history, "stored", stored)
    store = history.History(spark, str(tmp_path / "history"))
    rows = turns_of(spark, [turn(1), turn(2), turn(3)])
    for n, some in enumerate([rows.filter("line < 3"), rows.filter("line < 3"), rows.unionByName(rows.filter("line = 3"))]):
        store.append(some, flush=n)
    assert sorted(r.line for r in store.turns().collect()) == [1, 2, 3]
    assert all(set(df.columns) <= {"turn_key", "session_id", "date", "added", "row_id"} for df in written["fresh"])


BLOCKS = "file string, line long, pos long, kind string, name string, block_id string, tool_use_id string, nbytes long"
LINES = "file string, line long, pool long, input_tokens long, output_tokens long, input_units long, output_units long, cache_read_units long, cache_creation_units long"


def log_of(spark):
    lines, blocks = [], []
    for line in range(1, 41):
        pool = None if line % 3 == 0 else (5 if line in (14, 29) else 100 + line)
        lines.append(("f", line, pool, pool, 7, 1000 * line, 50, 0, 0) if pool else ("f", line, None, 0, 0, 0, 0, 0, 0))
        blocks.append(("f", line, 0, "text", None, None, None, 10 + line))
        if line % 4 == 1:
            blocks.append(("f", line, 1, "tool_use", ("Read", "Bash")[line % 8 > 3], f"c{line % 5}", None, 20 + line))
        if line % 4 == 3:
            blocks.append(("f", line, 1, "tool_result", None, None, f"c{(line - 2) % 5 if line % 7 else 9}", 30 + line))
    return spark.createDataFrame(lines, LINES), spark.createDataFrame(blocks, BLOCKS)


@pytest.mark.parametrize("cuts", [(0, 40), (0, 1, 13, 14, 40)])
def test_split_in_batches_equals_split_of_the_file(spark, tmp_path, cuts):
    lines, blocks = log_of(spark)
    rows = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    want = [rows(df) for df in attribution.attribute(lines, blocks)]
    states, got = tallies.states(spark, str(tmp_path)), [[], []]
    for n, (low, high) in enumerate(zip(cuts, cuts[1:])):
        new = (F.col("line") > low) & (F.col("line") <= high)
        for k, df in enumerate(tallies.split_batch(states, lines.filter(new), blocks.filter(new), n)):
            got[k] += rows(df)
    assert [sorted(x, key=str) for x in got] == want


def test_streamed_history_has_tool_costs(spark, tmp_path):
    lines, blocks = log_of(spark)
    store = history.History(spark, str(tmp_path / "h"))
    turns = turns_of(spark, [turn(n) for n in range(1, 41) if n % 3])
    states = tallies.states(spark, f"{store.root}/tallies")
    for n, new in enumerate((F.col("line") <= 20, F.col("line") > 20)):
        per_tool, rest = tallies.split_batch(states, lines.filter(new), blocks.filter(new), n)
        store.append(history.with_slices(turns.filter(new), per_tool, rest))
    stored = breakdown.tool_breakdown(store.turns(), *store.split())
    direct = breakdown.tool_breakdown(turns, *attribution.attribute(lines, blocks))
    assert sorted(map(str, stored.select("name", F.round("cost_usd", 9)).collect())) == sorted(map(str, direct.select("name", F.round("cost_usd", 9)).collect()))


def lines_in(store):
    return sorted(r.line for r in store.turns().select("line").collect())


@pytest.mark.parametrize("stop", ["_write_turns", "_finish", "named"])
def test_append_that_was_cut_off(spark, tmp_path, monkeypatch, stop):
    store = history.History(spark, str(tmp_path))
    store.append(turns_of(spark, [turn(1), turn(2)]))

    class Stop(Exception):
        pass

    def fail(*_a, **_k):
        raise Stop

    sessions = None
    with monkeypatch.context() as patch:
        if stop == "named":
            sessions = spark.createDataFrame([("s", "f", "/p", False)], "session_id string, source_file string, cwd string, is_sidechain boolean").withColumn("cwd", F.assert_true(F.lit(False)).cast("string"))
        else:
            patch.setattr(history.History, stop, staticmethod(fail))
        with pytest.raises(Exception):  # noqa: B017
            store.append(turns_of(spark, [turn(2), turn(3), turn(4)]), sessions)
    again = history.History(spark, str(tmp_path))
    again.append(turns_of(spark, [turn(2), turn(3), turn(4), turn(5)]))
    again.append(turns_of(spark, [turn(5)]))
    assert lines_in(again) == [1, 2, 3, 4, 5]


def test_deleted_turns_stay_away_until_they_come_again(spark, tmp_path):
    store = history.History(spark, str(tmp_path))
    store.append(turns_of(spark, [turn(1, session="a"), turn(2, session="b"), turn(3, 30, session="a")]))
    assert store.forget(session_ids=["a"]) == (1, 2)
    assert store.forget(session_ids=["a"]) == (0, 0) and lines_in(store) == [2]
    store.append(turns_of(spark, [turn(3, 30, session="a"), turn(2, session="b")]))
    assert lines_in(store) == [2, 3] and [r.line for r in store.session("a").collect()] == [3]
    store.compact()
    assert lines_in(store) == [2, 3] and store.turns_path.endswith("turns-1")
    assert store.forget(older_than="2024-01-06") == (1, 1) and lines_in(store) == [3]


def test_session_reads_its_days_only(spark, tmp_path):
    store = history.History(spark, str(tmp_path))
    store.append(turns_of(spark, [turn(n, 24 * (n % 3), session=f"s{n % 3}") for n in range(9)]))
    plan = store.session("s1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "2024-01-06" in plan and "2024-01-05" not in plan.split("PartitionFilters")[1].split("]")[0]
    assert [r.line for r in store.session("s1").collect()] == [1, 4, 7]
