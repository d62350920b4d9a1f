"""Anchored frames of samples that lie in many tasks: successor links and pointer doubling.

A frame opens at the first event more than ``duration`` after the last frame opened. From any event, the next opening is its successor: the first
later event of more than ``duration`` later, found by a merge of times with times. Within a range of a sample, doubling these links gives for every
event that could be the first opening there the last opening in the range and how many there are. A range is left with one of a few opening times;
each is a node, linked to where its frame ends: the first later range that reaches beyond it, and the opening time with which that one is left. The path
from the sample's first event through these links is found by doubling them too, in as many joins as the logarithm of the number of ranges.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import Ranges
from ..functions.ordered import scan
from ..functions.scratch import ship, stored


def openings(t: np.ndarray, duration: int) -> tuple[np.ndarray, np.ndarray]:
    """For each event of sorted times, if it opens a frame: the time of the last opening from there on, and the number of openings."""
    n = len(t)
    jump = np.searchsorted(t, t + duration, side="right")
    last, count = np.arange(n), np.ones(n, np.int64)
    on = np.flatnonzero(jump < n)
    while len(on):
        ahead = jump[on]
        count[on] += count[ahead]
        last[on] = last[ahead]
        jump[on] = jump[ahead]
        on = on[jump[on] < n]
    return t[last], count


def anchored_in_ranges(ranges: Ranges, duration: int, t: str) -> DataFrame:
    """ranges (parted, of one key) with frame. What reaches the driver is one row for each range of a sample that has several: at most two for each partition."""
    rows, (key,) = ranges.rows, ranges.keys
    spark = rows.sparkSession
    ship(spark)
    kind = rows.schema[key].dataType.simpleString()
    times = rows.select(F.col(key).alias("key"), F.col("__part").alias("part"), F.col(t).cast("bigint").alias("t"))
    spans = times.groupBy("key", "part").agg(F.max("t").alias("top"))
    several = spans.groupBy(F.col("key").alias("k")).count().where("count > 1").select("k")
    spans = spans.join(F.broadcast(several), F.col("key").eqNullSafe(F.col("k"))).orderBy("part").collect()
    if not spans:
        return _framed(rows, key, ranges.order, duration, t, None)
    of: dict = {}
    for r in spans:
        of.setdefault(r["key"], ([], []))
        of[r["key"]][0].append(r["part"]), of[r["key"]][1].append(r["top"])
    split = times.join(F.broadcast(several), F.col("key").eqNullSafe(F.col("k"))).drop("k")

    def left_with(group: pa.Table) -> pa.Table:
        """The opening times with which a range may be left (and the one where its first event opens a frame), and the range where each frame ends."""
        name, part = group.column("key")[0].as_py(), group.column("part")[0].as_py()
        last, count = openings(np.sort(group.column("t").to_numpy()), duration)
        o = np.unique(last)
        parts, tops = (np.array(x) for x in of[name])
        at = np.maximum(np.searchsorted(tops, o + duration, side="right"), np.searchsorted(parts, part) + 1)
        q = [int(parts[k]) if k < len(parts) else None for k in at.tolist()]
        m = len(o)
        return pa.table({"key": group.column("key").take(pa.array([0] * m)), "p": pa.array([part] * m, pa.int32()), "o": o, "q": pa.array(q, pa.int32()), "first_o": pa.array([int(last[0])] * m), "first_c": pa.array([int(count[0])] * m)})

    nodes = stored(split.groupBy("key", "part").applyInArrow(left_with, f"key {kind}, p int, o bigint, q int, first_o bigint, first_c bigint"), "nodes")

    def enter(events: pa.Table, at: pa.Table) -> pa.Table:
        """Where the frames that end in a range leave it."""
        if not at.num_rows or not events.num_rows:
            return at.slice(0, 0).append_column("o2", pa.array([], pa.int64())).append_column("c", pa.array([], pa.int64()))
        sorted_t = np.sort(events.column("t").to_numpy())
        last, count = openings(sorted_t, duration)
        e = np.searchsorted(sorted_t, at.column("o").to_numpy() + duration, side="right")
        return at.append_column("o2", pa.array(last[e])).append_column("c", pa.array(count[e]))

    links = nodes.where("q is not null").select("key", "p", "o", "q")
    links = split.groupBy("key", "part").cogroup(links.groupBy("key", "q")).applyInArrow(enter, f"key {kind}, p int, o bigint, q int, o2 bigint, c bigint")
    # from (p, o): leaves q with o2 after c openings; q was entered with o_in after c_in of them
    links = stored(links.select("key", "p", "o", "q", "o2", "c", F.col("o").alias("o_in"), F.lit(0).cast("bigint").alias("c_in")), "links")
    begins = spark.createDataFrame([(name, parts[0]) for name, (parts, _) in of.items()], f"b_key {kind}, b_part int")
    path = nodes.join(F.broadcast(begins), F.col("key").eqNullSafe(F.col("b_key")) & (F.col("p") == F.col("b_part")))
    path = path.groupBy("key", "p").agg(F.first("first_o").alias("o"), F.first("first_c").alias("n")).select("key", "p", "o", "n", F.lit(None).cast("bigint").alias("o_in"), F.lit(0).cast("bigint").alias("n_in"))
    path = stored(path, "path")
    for k in range(max(1, math.ceil(math.log2(max(len(parts) for parts, _ in of.values()))))):
        if k:
            a, b = links.alias("a"), links.alias("b")
            same = F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.q") == F.col("b.p")) & (F.col("a.o2") == F.col("b.o"))
            links = stored(a.join(b, same).select("a.key", "a.p", "a.o", "b.q", "b.o2", (F.col("a.c") + F.col("b.c")).alias("c"), "b.o_in", (F.col("a.c") + F.col("b.c_in")).alias("c_in")), "links")
        a, b = path.alias("a"), links.alias("b")
        on = F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.p") == F.col("b.p")) & (F.col("a.o") == F.col("b.o"))
        further = a.join(b, on).select("a.key", F.col("b.q").alias("p"), F.col("b.o2").alias("o"), (F.col("a.n") + F.col("b.c")).alias("n"), "b.o_in", (F.col("a.n") + F.col("b.c_in")).alias("n_in"))
        path = stored(path.unionByName(further), "path")
    found = {(r["key"], r["p"]): r for r in path.collect()}
    carried = []
    for name, (parts, _) in of.items():
        now, n = None, 0
        for part in parts:
            r = found.get((name, part))
            carried.append((name, part, r["o_in"], r["n_in"]) if r else (name, part, now, n))  # a range within the open frame opens none
            now, n = (r["o"], r["n"]) if r else (now, n)
    carry = spark.createDataFrame(carried, f"__ck {kind}, __cp int, __o bigint, __c bigint")
    return _framed(rows, key, ranges.order, duration, t, carry)


def _framed(rows: DataFrame, key: str, order: tuple[str, ...], duration: int, t: str, carry: DataFrame | None) -> DataFrame:
    """The frames of each range, with the frame that was open when it began."""
    if carry is None:
        joined = rows.withColumns({"__o": F.lit(None).cast("bigint"), "__c": F.lit(0).cast("bigint")})
    else:
        joined = rows.join(F.broadcast(carry), F.col(key).eqNullSafe(F.col("__ck")) & (F.col("__part") == F.col("__cp")), "left").drop("__ck", "__cp")

    def step(state, now, opened, count):
        if state is None:
            state = (opened, (count or 0) - 1)
        opened, k = state
        if opened is None or now - opened > duration:
            opened, k = now, k + 1
        return (opened, k), (k,)

    return scan(joined, [key, "__part"], list(order), [t, "__o", "__c"], lambda: None, step, "frame int").select(*[c for c in rows.columns if c != "__part"], "frame")
