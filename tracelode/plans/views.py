"""The engine's tables as views over the driver's tables, once in Spark and once in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def items(s: SparkSession, d: str) -> DataFrame:
    c = s.read.parquet(f"{d}/conversations.parquet")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("session").alias("source"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("source_path"), F.col("turn").cast("int").alias("ordinal"),
        "role", "text", F.timestamp_seconds(F.lit(1704067200) + (F.col("conv_id") * 24 + F.col("turn")) * 3600).alias("timestamp"), F.concat_ws("-", "conv_id", "turn").alias("uuid"),
        F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("project"), F.lit("text").alias("content_type"),
    )


def docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.lit("ke").alias("source"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_path"), F.lit(0).alias("ordinal"), F.lit("document").alias("role"), "text", F.col("source").alias("project"), "lang")


def tool_events(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    error = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("source_path"), (F.row_number().over(order) - 1).alias("ordinal"), F.col("event_type").alias("tool_name"),
        F.concat(F.lit("k"), (F.col("k") % 10).cast("string")).alias("command_head"), F.when(F.col("event_type") == "view", F.lit(None).cast("boolean")).otherwise(error).alias("is_error"),
        F.when(error, F.col("k") % 5).alias("exit_code"), F.col("ts").cast("timestamp").alias("timestamp"), F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("project"),
        F.when(error, F.concat(F.lit("error: job exit code "), F.col("k").cast("string"), F.lit(" at /srv/u"), F.col("user_id").cast("string"))).alias("text"), F.col("event_id").cast("string").alias("item_uuid"),
    )


def tags(s: SparkSession, d: str) -> DataFrame:
    from ..operators import mining

    return mining.session_tags(items(s, d))


def chunks(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("conv/"), (F.col("vec_id") % 100).cast("string")).alias("source_id"), F.col("vec_id").alias("chunk_idx"), "embedding")


def annotations(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/labels.parquet").select(F.concat(F.lit("conv/"), F.col("doc_id").cast("string")).alias("source_path"), F.lit(0).alias("ordinal"), F.lit("correction").alias("kind"), F.col("quality").cast("string").alias("label"))


V_ITEMS = """v_items AS (SELECT conv_id * 1000 + turn AS id, 'session' AS source, 'conv/' || conv_id AS source_path, turn::INTEGER AS ordinal, role, text,
  TIMESTAMP '2024-01-01' + to_hours((conv_id * 24 + turn)::INTEGER) AS timestamp, conv_id || '-' || turn AS uuid, 'p' || conv_id % 3 AS project, 'text' AS content_type FROM conversations)"""
V_EVENTS = """v_events AS (SELECT 'user/' || user_id AS source_path, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS ordinal, event_type AS tool_name,
  'k' || k % 10 AS command_head, CASE WHEN event_type = 'view' THEN NULL ELSE event_type = 'error' END AS is_error, CASE WHEN event_type = 'error' THEN k % 5 END AS exit_code, ts AS timestamp,
  'p' || user_id % 5 AS project, CASE WHEN event_type = 'error' THEN 'error: job exit code ' || k || ' at /srv/u' || user_id END AS text, event_id::VARCHAR AS item_uuid
  FROM (SELECT *, (props::JSON ->> '$.k')::INTEGER AS k FROM events))"""
V_DOCS = "v_docs AS (SELECT doc_id AS id, 'doc/' || doc_id AS source_path, text, source AS project, lang FROM documents)"
V_CHUNKS = "v_chunks AS (SELECT 'conv/' || vec_id % 100 AS source_id, vec_id AS chunk_idx, embedding FROM embeddings)"


def tags_sql(of: str = "v_items") -> str:
    from ..functions.text import TAG_PATTERNS

    parts = " UNION ALL ".join(f"SELECT source_path, '{t}' AS tag FROM {of} WHERE regexp_matches(text, '{p}')" for t, p in TAG_PATTERNS.items())
    return f"v_tags AS (SELECT DISTINCT * FROM ({parts}))"
