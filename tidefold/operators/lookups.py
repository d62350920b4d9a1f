"""Joins of the data pipeline: intervals, membership, dictionaries, file lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import HOT_ROWS, ranged


def interval_join(events: DataFrame, intervals: DataFrame, key: str, t: str, start: str, end: str, width: int | None = None) -> DataFrame:
    """Events with start <= t < end of an interval of the same key.

    With ``width``, time is cut into slots of that size and an interval is listed in each slot it touches, so a key with very many events
    is spread over its slots and each slot meets only its own intervals."""
    i = intervals.withColumnRenamed(key, "__key")
    match = (F.col(key) == F.col("__key")) & (F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))
    if width is None:
        return events.join(i, match).drop("__key")
    slot = lambda c: F.floor(F.col(c) / F.lit(width)).cast("bigint")
    i = i.where(F.col(end) > F.col(start)).withColumn("__slot", F.explode(F.sequence(slot(start), F.floor((F.col(end) - 1) / F.lit(width)).cast("bigint"))))
    e = events.withColumn("__at", slot(t))
    return e.join(i, match & (F.col("__at") == F.col("__slot"))).drop("__key", "__slot", "__at")


def number_within(df: DataFrame, by: list[str], order: list[str], name: str = "k", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds a row's place in its group, from 0. A group of more than hot_rows rows is numbered in ranges of its order."""
    rows = ranged(df, by, order, hot_rows)
    if not rows.parted:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return rows.running({name: F.lit(1)}).columns({name: F.col(name) - 1}).plain()


def membership(all_rows: DataFrame, valid: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """The training rows: those in neither list."""
    return all_rows.join(valid.select(key).distinct(), key, "left_anti").join(test.select(key).distinct(), key, "left_anti")


def dictionary(df: DataFrame, entries: DataFrame, key: str, name: str) -> DataFrame:
    """Adds a dictionary's value for key; null if absent. Spark broadcasts the dictionary when its size allows."""
    return df.join(entries.select(F.col("key").alias(key), F.col("value").alias(name)), key, "left")
