"""Event streams to frames: the three windowing rules, event histograms, temporal deletion, spike clusters."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import HOT_ROWS, largest, ranged
from ..functions.ordered import scan
from .anchored import anchored_in_ranges
from .lookups import number_within
from .sampling import cut_at, ranked, uniform, up_to


def equal_count(events: DataFrame, frames: int, key: str = "sample", order: tuple[str, ...] = ("t", "event_id"), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Frame i holds events [i * d, (i + 1) * d) with d = N // frames; the last also holds the remainder. With N < frames all are in the last.

    The first column of the order is a number. A sample of more than hot_rows events is ranked in parts."""
    place = F.when(F.col("__n") < frames, F.lit(frames - 1)).otherwise(F.least(F.expr(f"(__k - 1) div greatest(__n div {frames}, 1)"), F.lit(frames - 1)))
    return ranked(events, key, order, hot_rows).withColumn("frame", place.cast("int")).drop("__k", "__n")


def equal_time(events: DataFrame, frames: int, key: str = "sample", t: str = "t") -> DataFrame:
    """Frame i holds t0 + [i * dt, (i + 1) * dt) with dt = (last - first) // frames; the last runs to the end. A span under ``frames`` is all in the last.

    First and last times are aggregated before they are shuffled and joined to the events: a sample's events need not meet in one task."""
    spans = events.groupBy(F.col(key).alias("__key")).agg(F.min(t).alias("__a"), F.expr(f"(max({t}) - min({t})) div {frames}").alias("__d"))
    out = events.join(spans, F.col(key).eqNullSafe(F.col("__key")))
    place = F.least(F.expr(f"({t} - __a) div greatest(__d, 1)"), F.lit(frames - 1))
    return out.withColumn("frame", F.when(F.col("__d") == 0, F.lit(frames - 1)).otherwise(place).cast("int")).drop("__key", "__a", "__d")


def anchored(events: DataFrame, duration: int, key: str = "sample", order: tuple[str, ...] = ("t", "event_id"), t: str = "t", hot_rows: int = HOT_ROWS) -> DataFrame:
    """A frame opens at the first event without one and holds events up to and including ``duration`` later. A large sample is framed in ranges; t is the first of the order."""
    ranges = ranged(events, [key], order, hot_rows)
    if ranges.parted:
        return anchored_in_ranges(ranges, duration, t)

    def step(s, now):
        opened, k = s
        if opened is None or now - opened > duration:
            opened, k = now, k + 1
        return (opened, k), (k,)

    return scan(events, [key], list(order), [t], lambda: (None, -1), step, "frame int")


def histogram(framed: DataFrame, key: str = "sample") -> DataFrame:
    """Counts by sample, frame, polarity channel (p not 0 is channel 1), row and column: sparse frames."""
    return framed.groupBy(key, "frame", (F.col("p") != 0).cast("int").alias("channel"), "y", "x").agg(F.count("*").alias("n"))


def dense(counts: DataFrame, frames: int, key: str = "sample") -> DataFrame:
    """Events of each of the frames of a sample, with 0 for empty ones (an empty slot is no error here)."""
    full = counts.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame"))
    sums = counts.groupBy(key, "frame").agg(F.sum("n").alias("n"))
    return full.join(sums, [key, "frame"], "left").select(key, "frame", F.coalesce("n", F.lit(0)).alias("n"))


def custom(events: DataFrame, integrate: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "sample") -> DataFrame:
    """A caller's function from the events of one sample to its frames. A sample is one group in memory, as the caller's interface demands."""
    return events.groupBy(key).applyInPandas(integrate, schema)


def temporal_delete(events: DataFrame, remain: int, seed: int, key: str = "sample", order: tuple[str, ...] = ("t", "event_id"), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keeps ``remain`` positions of each sample, drawn without replacement, and numbers them in time order.

    In a sample of more than hot_rows events only the part of the draws where the last one kept lies is put in order."""
    draw = [uniform(seed, F.col("event_id")), F.col("event_id")]
    if largest(events, [key]) <= hot_rows:
        kept = events.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*draw))).where(F.col("__k") <= remain).drop("__k")
    else:
        cut = cut_at(events, key, draw, F.lit(remain))
        kept = events.join(cut, F.col(key).eqNullSafe(F.col("__g"))).where(up_to(draw)).drop("__g", "__cut")
    return number_within(kept, [key], list(order), "pos", hot_rows)


def first_spike(spikes: DataFrame, spike: str, key: str = "sample", order: tuple[str, ...] = ("t", "event_id"), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Marks the first spike of each sample: where the running sum of the running sum is 1. A large sample is summed in ranges."""
    rows = ranged(spikes, [key], order, hot_rows).running({"__s": F.col(spike)}).running({"__ss": F.col("__s")}).plain()
    return rows.withColumn("first", (F.col("__ss") == 1).cast("int")).drop("__s", "__ss")


def spike_clusters(spikes: DataFrame, spike: str, gap: int, key: str = "sample", t: str = "t", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Clusters of spikes whose neighbours are at most ``gap`` apart: key, cluster, first, last, n. A large sample is marked in ranges that know the last spike before them."""
    rows = ranged(spikes.where(F.col(spike) == 1), [key], [t], hot_rows).preceding(t, "__before")
    rows = rows.columns({"__new": F.coalesce((F.col(t) - F.col("__before") > gap).cast("int"), F.lit(0))})
    marked = rows.running({"cluster": F.col("__new")}).plain()
    return marked.groupBy(key, "cluster").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count("*").alias("n"))


def peak_outside_clusters(steps: DataFrame, clusters: DataFrame, v: str, theta: float, key: str = "sample", t: str = "t") -> DataFrame:
    """For each sample the step of the largest sub-threshold v that lies in no cluster (the first on ties), and the end of its smallest cluster."""
    # a step's cluster, if any, is the last one that began at or before it
    marks = clusters.select(key, F.col("first").alias(t), F.lit(None).cast("double").alias("__v"), F.col("last").alias("__last"))
    both = steps.select(key, t, F.col(v).cast("double").alias("__v"), F.lit(None).cast("bigint").alias("__last")).unionByName(marks)
    w = Window.partitionBy(key).orderBy(t, F.col("__v").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__end", F.last("__last", ignorenulls=True).over(w)).where(F.col("__v").isNotNull())
    free = seen.where((F.col("__v") < theta) & (F.col("__end").isNull() | (F.col(t) > F.col("__end"))))
    peak = free.groupBy(key).agg(F.max(F.struct(F.col("__v"), (-F.col(t)).alias("m"))).alias("b")).select(key, (-F.col("b.m")).alias("peak_t"), F.col("b.__v").alias("peak_v"))
    small = clusters.groupBy(key).agg(F.min(F.struct("n", "last")).alias("c")).select(key, F.col("c.last").alias("smallest_end"))
    return peak.join(small, key, "full")


def mask(frame: Column, length: Column) -> Column:
    return (frame < length).cast("int")
