"""The given tables as posts, messages, media, tenants and vectors (pure projections)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Conversations have no time: a turn is a minute after this moment.
CONVERSATION_START = "2025-01-01 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as posts; counters follow from the value."""
    whole = F.floor("value").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("post_id"),
        F.col("user_id").alias("channel_id"),
        F.col("event_type").alias("topic"),
        F.col("ts").cast("timestamp").alias("posted_at"),
        "value",
        "props",
        whole.alias("views"),
        F.floor(F.col("value") / 3).cast("long").alias("reactions"),
        F.floor(F.col("value") / 7).cast("long").alias("forwards"),
        F.floor(F.col("value") / 11).cast("long").alias("replies"),
    )


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as posts with text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post_id"), F.col("source").alias("channel_id"), F.col("text").alias("content"), "lang")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as group messages."""
    at = F.expr(f"timestamp_seconds(unix_seconds(timestamp'{CONVERSATION_START}') + turn * 60)")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group_id"), "turn", F.col("role").alias("username"), F.col("text").alias("content"), at.alias("posted_at"))


#: The same in DuckDB SQL, to begin oracle queries with.
POSTS_SQL = """posts AS (SELECT event_id AS post_id, user_id AS channel_id, event_type AS topic, ts AS posted_at, value, props,
    floor(value)::BIGINT AS views, floor(value / 3)::BIGINT AS reactions, floor(value / 7)::BIGINT AS forwards, floor(value / 11)::BIGINT AS replies FROM events)"""
MESSAGES_SQL = f"""messages AS (SELECT conv_id AS group_id, turn, role AS username, text AS content,
    TIMESTAMP '{CONVERSATION_START}' + to_minutes(turn) AS posted_at FROM conversations)"""
