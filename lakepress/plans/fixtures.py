"""Inputs that queries derive from the test tables, in DataFrames and in the same SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepress.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def log_blocks(spark: SparkSession, sf_dir: str, stamped: bool = True) -> DataFrame:
    """(block_id, text): log text of at most 5,000 events, one block for each 32nd of the users and 5,000 event ids."""
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    full = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), level, F.lit(" "), "event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(" value="), F.floor("value").cast("string"))
    line = full if stamped else F.concat(level, F.lit(" "), F.when(F.col("value") < 50, "low").otherwise("high"))
    keyed = e.select((F.floor(F.col("event_id") / 5000) * 32 + F.col("user_id") % 32).cast("long").alias("block_id"), "event_id", line.alias("line"))
    rows = keyed.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "line"))).alias("x"))
    return rows.select("block_id", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("text"))


def log_blocks_sql(stamped: bool = True) -> str:
    level = "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END"
    full = f"strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || {level} || ' ' || event_type || ' user=' || CAST(user_id AS VARCHAR) || ' value=' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)"
    line = full if stamped else f"{level} || ' ' || CASE WHEN value < 50 THEN 'low' ELSE 'high' END"
    return f"SELECT CAST(floor(event_id / 5000) * 32 + user_id % 32 AS BIGINT) AS block_id, string_agg({line}, chr(10) ORDER BY event_id) AS text FROM events GROUP BY 1"


def paragraph_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block_id, text): documents of a language, 50 ids at a time, joined by blank lines."""
    d = table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("-"), F.floor(F.col("doc_id") / 50).cast("string")).alias("block_id"), "doc_id", "text")
    rows = d.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("x"))
    return rows.select("block_id", F.array_join(F.transform("x", lambda s: s["text"]), "\n\n").alias("text"))


PARAGRAPH_DOCS_SQL = "SELECT lang || '-' || CAST(CAST(floor(doc_id / 50) AS BIGINT) AS VARCHAR) AS block_id, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY 1"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as blocks: user turns as they are, others as tool results."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("payload_id"), F.col("turn").cast("int").alias("message"), F.lit(0).alias("part"), "role", F.when(F.col("role") == "user", "user").otherwise("tool").alias("kind"), "text")


def session_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tool blocks of one payload for each language."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("payload_id"), F.col("doc_id").alias("message"), F.lit(0).alias("part"), F.lit("tool").alias("kind"), "text", F.lit(False).alias("is_newest_user"), F.lit(False).alias("is_current_turn"))


def requests(spark: SparkSession, sf_dir: str, api: str) -> DataFrame:
    """Conversations as requests of a dialect; every third turn of an assistant or system calls a tool, whose result follows in place."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    user, call = F.col("role") == "user", F.concat(F.lit("c"), F.col("turn").cast("string"))
    name = F.when(F.col("turn") % 2 == 0, "bash").otherwise("read")
    quoted = lambda x: F.to_json(F.struct(x.alias("v")))
    inner = lambda x: F.expr("substring({0}, 6, length({0}) - 6)".format("__q"))  # noqa: E731, ARG005
    c = c.withColumn("__q", quoted(F.coalesce("text", F.lit(""))))
    text = inner(None)
    if api == "anthropic-messages":
        plain = F.concat(F.lit('{"role":"user","content":'), text, F.lit("}"))
        tool = F.concat(F.lit('{"role":"assistant","content":[{"type":"tool_use","id":"'), call, F.lit('","name":"'), name, F.lit('","input":{}},{"type":"tool_result","tool_use_id":"'), call, F.lit('","content":'), text, F.lit("}]}"))
        field = "messages"
    elif api == "openai-completions":
        plain = F.concat(F.lit('{"role":"user","content":[{"type":"text","text":'), text, F.lit("}]}"))
        tool = F.concat(F.lit('{"role":"tool","tool_call_id":"'), call, F.lit('","tool_calls":[{"id":"'), call, F.lit('","function":{"name":"'), name, F.lit('"}}],"content":'), text, F.lit("}"))
        field = "messages"
    else:
        plain = F.concat(F.lit('{"type":"message","role":"user","content":[{"type":"input_text","text":'), text, F.lit("}]}"))
        tool = F.concat(F.lit('{"type":"function_call_output","call_id":"'), call, F.lit('","output":'), text, F.lit("}"))
        field = "input"
    rows = c.select("conv_id", F.struct("turn", F.when(user, plain).otherwise(tool).alias("m")).alias("s")).groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("x"))
    body = F.concat(F.lit(f'{{"model":"m","{field}":['), F.array_join(F.transform("x", lambda s: s["m"]), ","), F.lit("]}"))
    return rows.select(F.col("conv_id").alias("payload_id"), F.lit(api).alias("api"), body.alias("payload"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log: one row for each conversation."""
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("seq")).agg(F.sum(F.octet_length("text")).cast("long").alias("original_tokens"), F.max("turn").alias("__t"))
    hit = F.col("__t") % 2 == 0
    return c.select("seq", hit.alias("accepted"), "original_tokens", F.when(hit, F.floor(F.col("original_tokens") * 0.75)).otherwise(F.col("original_tokens")).cast("long").alias("compressed_tokens"), F.when(~hit, "no-block-changed").alias("fallback_reason"))


RUNS_SQL = """SELECT seq, t % 2 = 0 AS accepted, o AS original_tokens,
  CAST(CASE WHEN t % 2 = 0 THEN floor(o * 0.75) ELSE o END AS BIGINT) AS compressed_tokens, CASE WHEN t % 2 <> 0 THEN 'no-block-changed' END AS fallback_reason
  FROM (SELECT conv_id AS seq, CAST(sum(strlen(text)) AS BIGINT) AS o, max(turn) AS t FROM conversations GROUP BY 1)"""
