import json

import pytest
from pyspark.sql import functions as F

from turnledger.functions.money import usd
from turnledger.operators import attribution
from turnledger.plans import rollups
from turnledger.sources import logs
from turnledger.sources.history import History, decode_tool_costs, encode_tool_costs, merge_tiers
from turnledger.streaming import ingest


def reply(n, content=(), usage=(1000, 200, 500, 100), **extra):
    message = {"id": f"m{n}", "model": "claude-opus-4-7", "content": list(content) if not isinstance(content, str) else content, **extra.pop("message", {})}
    if usage:
        names = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
        message["usage"] = dict(zip(names, usage))
    return {"type": "assistant", "timestamp": f"2024-01-01T00:00:{n:02d}Z", "sessionId": "s1", "requestId": f"r{n}", "message": message, **extra}


def write(folder, name, rows):
    path = folder / "projects" / "p" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\n".join(r if isinstance(r, bytes) else (r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)).encode() for r in rows) + b"\n")
    return path


def test_parse_rules(spark, tmp_path):
    write(tmp_path, "s1.jsonl", [
        {"type": "user", "sessionId": "s1", "cwd": "C:\\w\\p", "message": {"content": "hi"}},
        "", "not json", "[1, 2]", {"kind": "no type"}, {"type": ""},
        reply(1), reply(1, usage=(2000, 300, 1000, 0)),  # same key: the last one stays
        reply(2, usage=None),  # interrupted
        reply(3, message={"id": None}),  # no key: passes through
        reply(4, message={"model": "gemini-3-flash"}),
        reply(5, message={"model": "<synthetic>"}),
        b'{"type": "system", "version": "1.2", "cwd": "/bad\xff"}',
        reply(6, isSidechain=True, attributionSkill="other"),
    ])
    write(tmp_path, "subagents/agent.jsonl", [{**reply(7), "sessionId": None, "timestamp": "nonsense"}])
    rows, turns, sessions = logs.load(spark, logs.split_roots(str(tmp_path)))
    got = {r.uuid or r.line: r for r in turns.withColumn("usd", usd(F.col("cost_units"))).collect() if "agent" not in r.file}
    assert sorted(r.line for r in got.values()) == [8, 9, 10, 11, 14]
    assert got[8].input_tokens == 2000 and got[9].is_interrupted and got[9].usd == 0
    assert got[10].dedup_key is None and "DEDUP_PASSTHROUGH" in got[10].tags and got[11].tags == ["GEMINI_UNPRICED"]
    assert got[14].is_sidechain and got[14].attribution_skill is None
    agent = turns.filter("file like '%agent.jsonl'").first()
    assert agent.is_sidechain and agent.session_id == "agent" and agent.ts.timestamp() == 0
    assert sessions.filter("session_id = 's1'").first().cwd == "C:/w/p"
    assert logs.log_versions(rows).first().version == "1.2"
    assert rows.filter("type = 'system'").first().cwd == "/bad\ufffd"
    counts = logs.rejected(logs.read_lines(spark, logs.log_folders([str(tmp_path)]))).filter("file like '%s1.jsonl'").first()
    assert (counts.lines, counts.blank_lines, counts.bad_lines) == (14, 1, 4)


def test_line_numbers_across_splits(spark, tmp_path):
    write(tmp_path, "big.jsonl", [{"type": "user", "uuid": str(n), "pad": "x" * (n % 97)} for n in range(1, 3001)])
    write(tmp_path, "small.jsonl", [{"type": "user", "uuid": str(n)} for n in range(1, 8)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = logs.read_lines(spark, logs.log_folders([str(tmp_path)]))
        assert lines.select("file", "split").distinct().count() > 10
        numbered = logs.with_line_numbers(logs.events(lines), lines)
        assert numbered.count() == 3007 and numbered.filter("cast(line as string) <> uuid").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def block(kind, **fields):
    return {"type": kind, **fields}


def test_cost_split_of_a_small_log(spark, tmp_path):
    """Three replies: the first makes a Read call, the second a Bash call, each followed by its result."""
    read, bash = block("tool_use", id="a", name="Read", input={"path": "/é"}), block("tool_use", id="b", name="Bash", input={})
    res_a, res_b = block("tool_result", tool_use_id="a", content="x"), block("tool_result", tool_use_id="b", content="yy", is_error=True)
    rows = [
        {"type": "user", "sessionId": "s", "message": {"content": "hello"}},
        reply(1, [block("text", text="ok"), read], usage=(200, 40, 0, 0)),
        {"type": "user", "sessionId": "s", "message": {"content": [res_a]}},
        reply(2, [bash], usage=(320, 50, 0, 0)),
        {"type": "user", "sessionId": "s", "message": {"content": [res_b]}},
        reply(3, "done", usage=(150, 20, 0, 0)),
    ]
    write(tmp_path, "s.jsonl", rows)
    events, turns, _sessions = logs.load(spark, [str(tmp_path)])
    blocks = logs.content_blocks(events)
    size = lambda b: len(json.dumps(b, separators=(",", ":"), ensure_ascii=False).encode())
    hello, ok, done = (size(block("text", text=t)) for t in ("hello", "ok", "done"))
    sizes = [r.nbytes for r in blocks.orderBy("line", "pos").collect()]
    assert sizes == [hello, ok, size(read), size(res_a), size(bash), size(res_b), done]
    per_tool, rest = attribution.attribute(logs.attribution_lines(events), blocks)
    got = {(r.line, r.tool): r.tool_usd for r in per_tool.collect()}
    r1, r2 = size(read) + size(res_a), size(bash) + size(res_b)
    in2, in3 = hello + ok + r1, hello + ok + r1 + r2
    assert got[(2, "Read")] == pytest.approx(0.001 * size(read) / (ok + size(read)))
    assert got[(4, "Read")] == pytest.approx(0.0016 * r1 / in2) and got[(4, "Bash")] == pytest.approx(0.00125)
    assert got[(6, "Read")] == pytest.approx(0.00075 * r1 / in3) and got[(6, "Bash")] == pytest.approx(0.00075 * r2 / in3)
    total = turns.agg(F.sum("cost_units")).first()[0] / 1e10
    assert sum(got.values()) + rest.agg(F.sum("rest_usd")).first()[0] == pytest.approx(total)
    calls = {(r.tool): r.calls for r in rollups.tool_calls(turns, []).collect()}
    assert calls == {"Read": 1, "Bash": 1}
    back = {(r.line, r.tool): r.tool_usd for r in decode_tool_costs(encode_tool_costs(per_tool)).collect()}
    assert back == got


def test_changed_files_and_fingerprint(spark, tmp_path):
    first = write(tmp_path, "a.jsonl", [reply(1)])
    folders = logs.log_folders([str(tmp_path)])
    marks = spark.createDataFrame(logs.listing(spark, folders).collect(), "file string, size bigint, mtime timestamp")
    before = logs.fingerprint(logs.listing(spark, folders)).first()
    assert logs.read_changed(spark, folders, marks).count() == 0
    write(tmp_path, "b.jsonl", [reply(2), reply(3)])
    assert logs.read_changed(spark, folders, marks).count() == 2
    assert logs.fingerprint(logs.listing(spark, folders)).first() != before
    assert first.exists()


def test_history_round_trip(spark, tmp_path, turns_of):
    store = History(spark, str(tmp_path / "h"))
    assert store.turns().count() == 0 and store.sessions().count() == 0
    rows = turns_of([{"session_id": s, "ts": f"2024-01-0{d} 10:00:00", "line": n} for n, (s, d) in enumerate([("a", 1), ("a", 2), ("b", 2), ("c", 3)])])
    named = spark.createDataFrame([("a", "fa", "/p", False), ("b", None, None, True)], "session_id string, source_file string, cwd string, is_sidechain boolean")
    store.append(rows, named, flush=0)
    store.append(rows, named.withColumn("cwd", F.lit(None).cast("string")), flush=1)
    assert store.turns().count() == 4
    kept = {r.session_id: r for r in store.sessions().collect()}
    assert kept["a"].cwd == "/p" and kept["a"].turns == 2 and kept["b"].is_sidechain and kept["c"].cwd is None
    assert store.query_turns(since="2024-01-02", until="2024-01-02").count() == 2 and store.query_turns(project="/p").count() == 2
    plan = store.query_turns(since="2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert merge_tiers(store.hot(1, "2024-01-03 12:00:00")[0], store.turns()).count() == 4
    assert store.forget(older_than="2024-01-02 00:00:00") == (0, 1)
    assert store.forget(session_ids=["b"]) == (1, 1)
    assert store.forget(cwd="/p") == (1, 1)
    assert [r.session_id for r in store.turns().collect()] == ["c"]
    assert store.forget(everything=True) == (1, 1) and store.turns().count() == 0
    with pytest.raises(ValueError):
        store.forget()


def test_stream_appends_once_and_applies_deletions(spark, tmp_path):
    landing, root = tmp_path / "landing", tmp_path / "h"
    store = History(spark, str(root))
    write(landing, "one.jsonl", [reply(1), reply(1, usage=(7, 0, 0, 0)), reply(2)])
    each = ingest.into_history(store, f"{root}/requests")
    run = lambda: ingest.run_available(logs.stream_lines(spark, str(landing)), f"{root}/checkpoint", each)
    run()
    assert {r.turn_key: r.input_tokens for r in store.turns().collect()} == {"m1:r1": 7, "m2:r2": 1000}
    write(landing, "two.jsonl", [reply(2, usage=(9, 0, 0, 0)), {**reply(3), "sessionId": "s2"}])
    run()
    assert {r.turn_key: r.input_tokens for r in store.turns().collect()} == {"m1:r1": 7, "m2:r2": 1000, "m3:r3": 1000}
    (root / "requests").mkdir()
    (root / "requests" / "r.json").write_text(json.dumps({"session_id": "s1"}))
    write(landing, "three.jsonl", [{**reply(4), "sessionId": "s2"}])
    run()
    assert {r.turn_key for r in store.turns().collect()} == {"m3:r3", "m4:r4"}


def test_a_filter_on_parsed_fields_does_not_parse_the_line_again(spark):
    lines = spark.range(3).selectExpr("'f' as file", "id as line", """'{"type": "system", "version": "' || id || '"}' as value""")
    rows = logs.log_versions(logs.events(lines))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert rows.count() == 3
