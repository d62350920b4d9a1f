"""Training and firing metrics, layer alignment, calibration of scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def firing_by_batch(spikes: DataFrame, by: list[str], spike: str = "spike") -> DataFrame:
    return spikes.groupBy(*by).agg(F.avg(spike).alias("rate"))


def node_statistics(rates: DataFrame, node: list[str]) -> DataFrame:
    """mean and population deviation over batches of each node."""
    return rates.groupBy(*node).agg(F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("std"))


def overall(nodes: DataFrame) -> DataFrame:
    """The unweighted mean of node means, and what is silent in percent."""
    return nodes.agg(F.avg("mean").alias("firing"), ((1 - F.avg("mean")) * 100).alias("silent_pct"))


def weighted_rate(spikes: DataFrame, by: list[str], spike: str = "spike") -> DataFrame:
    return spikes.groupBy(*by).agg((F.sum(spike) / F.count(spike)).alias("rate"))


def silent_share(spikes: DataFrame, neuron: list[str], spike: str = "spike") -> DataFrame:
    """The share of neurons that never fired."""
    return spikes.groupBy(*neuron).agg(F.max(spike).alias("m")).agg(F.avg(1 - F.col("m")).alias("silent"))


def perplexity(losses: DataFrame, by: list[str], loss: str = "loss") -> DataFrame:
    return losses.groupBy(*by).agg(F.avg(loss).alias("avg_loss"), F.exp(F.avg(loss)).alias("ppl"))


def running_mean(losses: DataFrame, key: str, order: str, loss: str = "loss", last: int | None = None) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding if last is None else 1 - last, 0)
    return losses.withColumn("running", F.avg(loss).over(w))


def top_k_accuracy(scores: DataFrame, label: str, ks: tuple[int, ...] = (1, 5), row: str = "row") -> DataFrame:
    """acc<k>: the share of rows whose label is among the k largest logits (the first item first on ties)."""
    ranked = scores.withColumn("__r", F.row_number().over(Window.partitionBy(row).orderBy(F.desc("logit"), "item"))).where(F.col("item") == F.col(label))
    return ranked.agg(*[F.avg((F.col("__r") <= k).cast("int")).alias(f"acc{k}") for k in ks])


def best_epoch(log: DataFrame, loss: str = "loss", epoch: str = "epoch") -> DataFrame:
    return log.agg(F.min(F.struct(loss, epoch)).alias("b")).select(F.col(f"b.{epoch}").alias("epoch"), F.col(f"b.{loss}").alias("loss"))


def last_write(log: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Of rows that repeat a key (a rewound log), the one furthest down."""
    rest = [c for c in log.columns if c not in (*keys, line)]
    return log.groupBy(*keys).agg(F.max(F.struct(line, *rest)).alias("b")).select(*keys, *[F.col(f"b.{c}") for c in (line, *rest)])


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n of each class and 1 / n, normalised to sum 1. One row a class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("weight", (1 / F.col("n")) / F.sum(1 / F.col("n")).over(Window.partitionBy()))


def activation_scale(df: DataFrame, by: list[str], value: str, mode: str = "max", q: float = 0.99) -> DataFrame:
    """A batch's scale: its largest value, a linear percentile, or a fraction q of the largest."""
    of = {"max": F.max(value), "percentile": F.percentile(F.col(value), F.lit(q)), "fraction": F.max(value) * F.lit(q)}[mode]
    return df.groupBy(*by).agg(of.alias("scale"))


def relative_position(df: DataFrame, index: str) -> DataFrame:
    """i / (n - 1) of a layer table (0 for a single layer)."""
    n = F.count("*").over(Window.partitionBy())
    return df.withColumn("n", n).withColumn("rel", F.col(index) / F.greatest(F.col("n") - 1, F.lit(1))).drop("n")


def align(small: DataFrame, large: DataFrame, n_small: int, n_large: int, index: str = "layer") -> DataFrame:
    """Rows of the larger layer table with the small table's layer at the nearest relative position (half to even); missing layers are null."""
    longest = max(n_small, n_large)
    near = lambda n: F.least(F.bround(F.col("i") / F.lit(float(max(longest - 1, 1))) * (n - 1)).cast("int"), F.lit(n - 1))
    base = small.sparkSession.range(longest).select(F.col("id").cast("int").alias("i"))
    keyed = base.select("i", near(n_small).alias("a"), near(n_large).alias("b"))
    pre = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    joined = keyed.join(pre(small, "a"), F.col("a") == F.col(f"a_{index}"), "left").join(pre(large, "b"), F.col("b") == F.col(f"b_{index}"), "left")
    return joined.drop("a", "b")


def relative_difference(a: Column, b: Column) -> Column:
    return (a - b) / b * 100
