"""The driver's tables as canonical events and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_sessions(spark: SparkSession, sf_dir: str, *, daily: bool = False) -> DataFrame:
    """The events table as session events: a session is a user or, with daily, a user's day.

    Errors are failed results, purchases good ones (every third says that tests passed), clicks are edits,
    views are reads, signups are assistant texts.
    """
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    user = F.col("user_id").cast("string")
    session = F.concat(user, F.lit("/"), F.date_format("ts", "yyyy-MM-dd")) if daily else user
    kind = F.when(F.col("event_type").isin("error", "purchase"), "tool_result").when(F.col("event_type") == "signup", "text").otherwise("tool_use")
    return e.select(
        session.alias("session_id"), F.struct("ts", "event_id").alias("ord"), "ts", kind.alias("kind"), (F.col("event_type") == "error").alias("is_error"), k.alias("k"),
        F.when(F.col("event_type") == "click", "Edit").when(F.col("event_type") == "view", "Read").alias("name"), F.concat(F.lit("f"), k % 10).alias("file_path"),
        F.when((F.col("event_type") == "purchase") & (k % 3 == 0), "tests passed").otherwise("").alias("text"), "value", "event_type", "user_id", "event_id",
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
