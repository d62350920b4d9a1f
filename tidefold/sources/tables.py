"""Parquet tables, and the event stream as (sample, t, x, y, p) with times in microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event types as pixel columns, in natural order (fixed values).
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """sample, event_id, t (microseconds), x (event type 0..4), y (the number in props mod 8), p (value at or over 50), value.

    The column ts has no zone; reading it in UTC makes times independent of the session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    kinds = F.array(*[F.lit(k) for k in EVENT_TYPES])
    return table(spark, folder, "events").select(
        F.col("user_id").alias("sample"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        (F.array_position(kinds, F.col("event_type")) - 1).cast("int").alias("x"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 8).alias("y"),
        (F.coalesce("value", F.lit(0.0)) >= 50).cast("int").alias("p"),
        "value",
    )


#: The same in DuckDB SQL, with i counting from 1 within a sample.
EVENTS_SQL = """ev AS (SELECT user_id AS sample, event_id, epoch_us(ts) AS t,
  (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::INT AS x,
  regexp_extract(props, '([0-9]+)', 1)::INT % 8 AS y, (coalesce(value, 0) >= 50)::INT AS p, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"""
