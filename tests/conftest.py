import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from turnledger.session import local_session

    session = local_session("4", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def turns_of(spark):
    """Priced turns from short dicts; missing columns get plain defaults."""
    from pyspark.sql import functions as F

    from turnledger.plans.turns import price_turns

    schema = """file string, line bigint, ts string, dedup_key string, uuid string, session_id string, model string, input_tokens bigint,
      output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint, cache_creation_1h_tokens bigint, is_interrupted boolean,
      is_sidechain boolean, tool_use_count bigint, tool_error_count bigint, stop_reason string, attribution_skill string, cwd string"""
    defaults = {
        "file": "f", "session_id": "s", "model": "claude-opus-4-7", "input_tokens": 0, "output_tokens": 0, "cache_read_tokens": 0,
        "cache_creation_tokens": 0, "cache_creation_1h_tokens": 0, "is_interrupted": False, "is_sidechain": False, "tool_use_count": 0,
        "tool_error_count": 0,
    }
    names = [part.split()[0] for part in schema.split(",")]

    def build(rows):
        full = []
        for n, row in enumerate(rows):
            given = {**defaults, "line": n, "dedup_key": f"m{n}:r", "ts": f"2024-01-01 00:{n // 60:02d}:{n % 60:02d}", **row}
            full.append(tuple(given.get(c) for c in names))
        df = spark.createDataFrame(full, schema).withColumn("ts", F.col("ts").cast("timestamp"))
        df = df.withColumn("tool_names", F.lit(None).cast("map<string,bigint>")).withColumn("skill_names", F.lit(None).cast("map<string,bigint>"))
        return price_turns(df)

    return build
