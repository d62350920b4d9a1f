"""Decoding filters over logits in long form (row, item, logit): softmax, nucleus rules, penalties, greedy choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def softmax(logits: DataFrame, row: str = "row", temperature: float = 1.0) -> DataFrame:
    """Adds p: shifted by the row's largest logit."""
    w = Window.partitionBy(row)
    scaled = logits.withColumn("__l", F.col("logit") / F.lit(float(temperature)))
    return scaled.withColumn("__e", F.exp(F.col("__l") - F.max("__l").over(w))).withColumn("p", F.col("__e") / F.sum("__e").over(w)).drop("__l", "__e")


def _running(dist: DataFrame, row: str) -> DataFrame:
    w = Window.partitionBy(row).orderBy(F.desc("p"), "item").rowsBetween(Window.unboundedPreceding, 0)
    return dist.withColumn("__c", F.sum("p").over(w))


def nucleus(dist: DataFrame, top_p: float, row: str = "row") -> DataFrame:
    """Keeps items, by falling p, while what came before is at most top_p; renormalises p."""
    kept = _running(dist, row).where(F.col("__c") - F.col("p") <= top_p).drop("__c")
    return kept.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(row)))


def nucleus_cutoff(dist: DataFrame, top_p: float, temperature: float = 1.0, row: str = "row") -> DataFrame:
    """Keeps p at or over the first one at which the running sum passes top_p (ties stay; if none passes, only the largest); then p^(1/temperature), not renormalised."""
    run = _running(dist, row)
    w = Window.partitionBy(row)
    cut = F.coalesce(F.max(F.when(F.col("__c") > top_p, F.col("p"))).over(w), F.max("p").over(w))
    kept = run.withColumn("__cut", cut).where(F.col("p") >= F.col("__cut")).drop("__c", "__cut")
    return kept if temperature == 1.0 else kept.withColumn("p", F.pow("p", F.lit(1.0 / temperature)))


def repetition_penalty(logits: DataFrame, seen: DataFrame, penalty: float, row: str = "row") -> DataFrame:
    """Logits of items seen in the row's context: divided by the penalty if positive, else multiplied."""
    marks = seen.select(row, "item").distinct().withColumn("__seen", F.lit(True))
    new = F.when(F.col("__seen"), F.when(F.col("logit") > 0, F.col("logit") / F.lit(penalty)).otherwise(F.col("logit") * F.lit(penalty))).otherwise(F.col("logit"))
    return logits.join(marks, [row, "item"], "left").withColumn("logit", new).drop("__seen")


def mute(logits: DataFrame, item: int = 0, floor: float = -999999999.0) -> DataFrame:
    return logits.withColumn("logit", F.when(F.col("item") == item, F.lit(floor)).otherwise(F.col("logit")))


def greedy(logits: DataFrame, row: str = "row") -> DataFrame:
    """The item of the largest logit, the first on ties."""
    best = logits.groupBy(row).agg(F.max(F.struct("logit", (-F.col("item")).alias("m"))).alias("b"))
    return best.select(row, (-F.col("b.m")).alias("item"))


def cross_entropy(logits: DataFrame, target: str, row: str = "row") -> DataFrame:
    """loss of each row: log of the summed exponentials, less the target's logit."""
    top = logits.withColumn("__m", F.max("logit").over(Window.partitionBy(row)))
    sums = top.groupBy(row).agg(F.max("__m").alias("m"), F.sum(F.exp(F.col("logit") - F.col("__m"))).alias("z"), F.max(F.when(F.col("item") == F.col(target), F.col("logit"))).alias("t"))
    return sums.select(row, (F.ln("z") + F.col("m") - F.col("t")).alias("loss"))
