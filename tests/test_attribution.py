import random

import pytest

from turnledger.operators import attribution


def split_by_loop(lines, blocks):
    """The cost split of one file, read one line at a time."""
    out, names, held, plain, peak = {}, {}, {}, 0, 0
    for line in lines:
        own = [b for b in blocks if b["line"] == line["line"]]
        pool = line["pool"]
        if pool is not None:
            if peak > 0 and pool < 0.2 * peak:
                names, held, plain, peak = {}, {}, 0, pool
            else:
                peak = max(peak, pool)
            total_in, total_out = sum(held.values()) + plain, sum(b["nbytes"] for b in own)
            for tool in {*held, *(b["name"] for b in own if b["kind"] == "tool_use" and b["name"])}:
                made = sum(b["nbytes"] for b in own if b["kind"] == "tool_use" and b["name"] == tool)
                share_in = held.get(tool, 0) / total_in if total_in else 0.0
                share_out = made / total_out if total_out else 0.0
                out[(line["line"], tool)] = pool * share_in, line["output_tokens"] * share_out
        for b in own:
            if b["kind"] == "tool_use" and b["name"] and b["block_id"]:
                names[b["block_id"]] = b["name"]
                held[b["name"]] = held.get(b["name"], 0) + b["nbytes"]
            elif b["kind"] == "tool_result":
                owner = names.pop(b["tool_use_id"], "__unknown__") if b["tool_use_id"] else "__unknown__"
                held[owner] = held.get(owner, 0) + b["nbytes"]
            else:
                plain += b["nbytes"]
    return out


@pytest.mark.parametrize("seed, size, fanout", [(0, 5, 2), (1, 8192, 1024)])
def test_split_matches_a_plain_loop(spark, seed, size, fanout):
    rng = random.Random(seed)
    lines, blocks = [], []
    for f in ("a", "b", "c"):
        for line in range(1, 60):
            pool = int(1000 * rng.random() ** 3) if rng.random() < 0.6 else None
            lines.append({"file": f, "line": line, "pool": pool, "output_tokens": rng.randint(0, 50) if pool is not None else None})
            for pos in range(rng.randint(0, 3)):
                kind = rng.choice(["text", "tool_use", "tool_result"])
                blocks.append(
                    {
                        "file": f, "line": line, "pos": pos, "kind": kind,
                        "name": rng.choice(["Read", "Bash", "Grep", None]) if kind == "tool_use" else None,
                        "block_id": rng.choice(["1", "2", "3", None]) if kind == "tool_use" else None,
                        "tool_use_id": rng.choice(["1", "2", "3", "4", None]) if kind == "tool_result" else None,
                        "nbytes": rng.randint(1, 40),
                    }
                )
    units = {c: 10 for c in ("input_units", "output_units", "cache_read_units", "cache_creation_units")}
    line_schema = "file string, line bigint, pool bigint, output_tokens bigint, " + ", ".join(f"{c} bigint" for c in units)
    line_rows = [(r["file"], r["line"], r["pool"], r["output_tokens"], *units.values()) for r in lines]
    block_schema = "file string, line bigint, pos bigint, kind string, name string, block_id string, tool_use_id string, nbytes bigint"
    per_tool, rest = attribution.attribute(
        spark.createDataFrame(line_rows, line_schema), spark.createDataFrame([tuple(b.values()) for b in blocks], block_schema), size, fanout
    )
    got = {(r.file, r.line, r.tool): (r.tool_input_tokens, r.tool_output_tokens) for r in per_tool.collect()}
    want = {}
    for f in ("a", "b", "c"):
        own = split_by_loop([r for r in lines if r["file"] == f], [b for b in blocks if b["file"] == f])
        want.update({(f, line, tool): value for (line, tool), value in own.items()})
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value)
    # Tools and remainder together give back every token.
    for r in rest.collect():
        tools = [v for k, v in got.items() if k[:2] == (r.file, r.line)]
        line = next(x for x in lines if (x["file"], x["line"]) == (r.file, r.line))
        assert r.rest_input_tokens + sum(v[0] for v in tools) == pytest.approx(line["pool"])
        assert r.rest_output_tokens + sum(v[1] for v in tools) == pytest.approx(line["output_tokens"])


def test_split_of_whole_files_shuffles_the_content_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(attribution, "stored", lambda df, name: written.append((name, df)) or df)
    lines = spark.range(20).selectExpr("'f' as file", "id as line", "id as pool", "1L as output_tokens", *(f"1L as {c}_units" for c in ("input", "output", "cache_read", "cache_creation")))
    blocks = spark.range(20).selectExpr("'f' as file", "id as line", "0L as pos", "'tool_use' as kind", "'Read' as name", "string(id) as block_id", "string(null) as tool_use_id", "5L as nbytes")
    attribution.attribute(lines, blocks)
    assert [name for name, _ in written] == ["usage", "split"]  # no content with owners in between
    plan = written[-1][1]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 2  # the pools of each file, and its content
