"""Registered queries of the operators and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm import decontaminate, lexical_search, licenses, line_spread, mixing, near_dup, quality_model, quality_rules, secrets, suffix_dedup, token_alignment, tool_calls, url_templates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_secret_scan", secrets.report_sql())
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(table(spark, folder, "documents"))


@query("op2_url_templates")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return url_templates.judge(table(spark, folder, "pages"))


@query("op3_quality_rules", quality_rules.report_sql())
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.report(table(spark, folder, "documents"))


@query("op6_license_scan")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op7_minhash_near_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"), words=2, percent=80)


@query("op4_line_site_spread", line_spread.report_sql())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return line_spread.line_report(table(spark, folder, "documents"))


@query("op5_benchmark_leaks")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def tool_messages(conversations: DataFrame) -> DataFrame:
    """The conversations as agent logs: every assistant turn calls a tool, user turns answer the turn before; first user turns are messages without a call."""
    kind, seven = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7))
    name = lambda n: F.concat(F.lit("t"), n.cast("string"))
    after = F.when(seven == 0, F.array(name(F.col("turn") + 2))).when(seven == 2, F.array().cast("array<string>")).otherwise(F.array(name(F.col("turn") - 2)))
    arguments = F.struct(
        F.when((kind == 0) & (F.pmod("conv_id", F.lit(6)) != 0), F.col("text")).alias("query"),
        F.when(kind == 0, F.col("turn")).alias("limit"),
        F.when(kind == 1, F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))).alias("path"),
        F.when((kind == 1) | ((kind == 2) & (F.pmod("conv_id", F.lit(5)) == 0)), F.octet_length("text").cast("bigint")).alias("lines"),
        F.when(kind >= 2, F.col("text")).alias("text"),
    )
    call = F.struct(name(F.col("turn")).alias("id"), F.when(kind == 0, "search").when(kind == 1, "read").when(kind == 2, "count").otherwise("note").alias("name"), arguments.alias("arguments"), after.alias("after"))
    calls = conversations.where(F.col("role") == "assistant").select("conv_id", "turn", "role", F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    result = F.to_json(F.struct(name(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")))
    asked = F.when(F.col("turn") > 0, result).otherwise(F.to_json(F.struct(F.col("text").alias("content"))))
    others = conversations.where("role is null or role <> 'assistant'")
    return calls.unionByName(others.select("conv_id", "turn", F.when((F.col("role") == "user") & (F.col("turn") > 0), "tool").otherwise(F.col("role")).alias("role"), asked.alias("text")))


OP8_SQL = """
with calls as (
  select conv_id, turn, (conv_id + turn) % 4 as kind, (conv_id + turn) % 7 as seven, min(text) as text, count(*) as copies
  from conversations where role = 'assistant' group by all),
results as (
  select conv_id, turn - 1 as turn, min(text) as content, count(*) as answers from conversations where role = 'user' and turn > 0 group by all),
keyed as (
  select c.*, case when n.turn is null then c.turn else n.turn end as moment, n.turn is not null as late
  from calls c left join calls n on c.seven = 0 and n.conv_id = c.conv_id and n.turn = c.turn + 2),
placed as (select *, row_number() over (partition by conv_id order by moment, late, turn) as position from keyed),
told as (
  select conv_id, turn, position, copies,
    case when kind = 0 and conv_id % 6 = 0 then 'missing query' when kind = 2 and conv_id % 5 = 0 then 'unexpected lines' end as problem,
    case kind when 0 then 'search' when 1 then 'read' when 2 then 'count' else 'note' end as name,
    case kind when 0 then '{"limit":' || turn || case when conv_id % 6 = 0 then '' else ',"query":' || to_json(text) end
      when 1 then '{"lines":' || strlen(text) || ',"path":"conv/' || conv_id || '"'
      else case when kind = 2 and conv_id % 5 = 0 then '{"lines":' || strlen(text) || ',"text":' else '{"text":' end || to_json(text) end || '}' as arguments
  from placed)
select coalesce(t.conv_id, r.conv_id) as conv_id, 't' || coalesce(t.turn, r.turn) as id, position,
  case when t.turn is null then 'orphan' when r.turn is null then 'unanswered' else 'linked' end as status,
  problem, coalesce(copies, answers) as copies,
  case when t.turn is null then '{"id":"t' || r.turn || '","result":' || to_json(content) || '}'
    else '{"arguments":' || arguments || ',"id":"t' || t.turn || '","name":"' || name || '","result":' || coalesce(to_json(content), 'null')
      || ',"valid":' || case when problem is null then 'true' else 'false' end || '}' end as json
from told t full join results r on t.conv_id = r.conv_id and t.turn = r.turn"""


@query("op8_tool_calls", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return tool_calls.link(tool_messages(table(spark, folder, "conversations")))


@query("op9_source_mix")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op10_quality_classifier")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_suffix_dedup")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, folder, "documents")).drop("spans")


@query("op12_lexical_search", lexical_search.search_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_token_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.report(table(spark, folder, "documents"))
