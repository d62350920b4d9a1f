"""Associative scans: recurrences whose steps compose, in blocks, so that one key's rows may lie in many tasks.

A step is a summary (a tuple of numbers); combine() of two neighbouring runs' summaries is that of both together, and is associative. Within a
task the prefixes of a batch are found by doubling (log n vector operations, no step for each row), and batches are chained. Rows are
range-partitioned by key and order: a hot key spreads over as many tasks as it needs. Each partition then knows its prefixes but for what came
before it; one summary a partition is combined in order, and a join on the partition's number brings every row what its partition starts with.
The running sums below do the same with windows. Where no key is large, callers take the plain way: all rows of a key in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .ordered import changes
from .scratch import ship, stored

#: Rows of a key up to which it stays in one task.
HOT_ROWS = 1 << 20

Arrays = tuple[np.ndarray, ...]
Combine = Callable[[Arrays, Arrays], Arrays]


def largest(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key; counts are combined before they are shuffled."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _pieces(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefixes(summary: Arrays, fresh: np.ndarray, combine: Combine) -> Arrays:
    """Inclusive prefixes of each run of rows; fresh marks the first row of a run. Spans double: after step k a row holds the last 2^k rows of its run."""
    closed = fresh.copy()
    closed[:1] = True
    step = 1
    while step < len(fresh) and not closed.all():
        at = np.flatnonzero(~closed[step:]) + step
        merged = combine(tuple(s[at - step] for s in summary), tuple(s[at] for s in summary))
        summary = tuple(s.copy() for s in summary)
        for s, m in zip(summary, merged, strict=True):
            s[at] = m
        now = closed.copy()
        now[step:] |= closed[:-step]
        closed = now
        step *= 2
    return summary


def block_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], element: Callable[..., Arrays], combine: Combine, identity: tuple[float, ...], names: Sequence[str], before: bool = False) -> DataFrame:
    """df with the summary of each key's rows up to and including a row (before: up to the row before it) as double columns ``names``.

    element(*inputs) gives the summaries of single rows from arrays (a null is nan); identity is the summary of no row. The order must be total for the result
    to be determined. A null key is a key."""
    spark = df.sparkSession
    ship(spark)
    columns = df.columns
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    at_key, at_in = [df.columns.index(k) for k in keys], [df.columns.index(c) for c in inputs]
    number = lambda a: a.to_numpy(zero_copy_only=False).astype(np.float64)
    none = tuple(np.array([x]) for x in identity)

    def run(batches):
        last, total, first = None, none, True  # first: the partition's first key, which may have begun in another partition
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            key_columns = [b.column(k) for k in at_key]
            fresh = changes(key_columns)
            fresh[0] = last is None or [c[0].as_py() for c in key_columns] != last
            if fresh[0] and last is not None:
                first = False
            single = element(*[number(b.column(k)) for k in at_in])
            up_to = prefixes(single, fresh, combine)
            begins = np.flatnonzero(fresh)
            head = int(begins[0]) if len(begins) else b.num_rows  # rows of the key that the last batch ended with
            if head:
                chained = combine(tuple(np.repeat(t, head) for t in total), tuple(s[:head] for s in up_to))
                up_to = tuple(np.concatenate([c, s[head:]]) for c, s in zip(chained, up_to, strict=True))
            opened = np.zeros(b.num_rows, bool)
            if first:
                opened[: int(begins[1]) if fresh[0] and len(begins) > 1 else b.num_rows if fresh[0] else head] = True
                first = bool(opened[-1])
            shown = up_to
            if before:
                shown = tuple(np.concatenate([t, s[:-1]]) for t, s in zip(total, up_to, strict=True))
                shown = tuple(np.where(fresh, i, s) for i, s in zip(identity, shown, strict=True))
            total = tuple(s[-1:] for s in up_to)
            last = [c[b.num_rows - 1].as_py() for c in key_columns]
            made = [pa.array(s, pa.float64()) for s in shown]
            yield pa.RecordBatch.from_arrays([*b.columns, *made, pa.array(opened), pa.array(n + np.arange(b.num_rows))], names=[*columns, *names, "__open", "__n"])
            n += b.num_rows

    schema = f"{kinds}, {', '.join(f'`{c}` double' for c in names)}, __open boolean, __n bigint"
    ranged = df.repartitionByRange(_pieces(spark), *keys, *order).sortWithinPartitions(*keys, *order)
    rows = stored(ranged.mapInArrow(run, schema).withColumn("__part", F.spark_partition_id()), "scan")
    # one row a partition
    key = F.struct(*[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)])
    tail = F.max_by(F.struct(key.alias("key"), F.col("__open").alias("whole"), *[F.col(c).cast("double").alias(f"i{n}") for n, c in enumerate(inputs)], *[F.col(c).alias(f"s{n}") for n, c in enumerate(names)]), "__n")
    ends = rows.groupBy("__part").agg(tail.alias("tail"), F.min_by(key, "__n").alias("head")).orderBy("__part").collect()
    starts, came, at = [], none, None
    for r in ends:
        if r["head"] != at:
            came = none
        starts.append((r["__part"], *(float(x[0]) for x in came)))
        t = r["tail"]
        upto = tuple(np.array([t[f"s{n}"]]) for n in range(len(names)))
        if before:
            upto = combine(upto, element(*[np.array([np.nan if t[f"i{n}"] is None else t[f"i{n}"]]) for n in range(len(inputs))]))
        came = combine(came, upto) if t["whole"] else upto
        at = t["key"]
    carried = F.broadcast(spark.createDataFrame(starts, "__p int, " + ", ".join(f"__c{n} double" for n in range(len(names)))))  # one row a partition
    joined = rows.join(carried, F.col("__part") == F.col("__p"))

    def finish(batches):
        for b in batches:
            at = [b.schema.get_field_index(f"__c{n}") for n in range(len(names))]
            own = tuple(number(b.column(b.schema.get_field_index(c))) for c in names)
            opened = b.column(b.schema.get_field_index("__open")).to_numpy(zero_copy_only=False)
            whole = combine(tuple(number(b.column(k)) for k in at), own)
            made = [pa.array(np.where(opened, w, o), pa.float64()) for w, o in zip(whole, own, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], *made], names=[*columns, *names])

    return joined.mapInArrow(finish, f"{kinds}, {', '.join(f'`{c}` double' for c in names)}")


# affine recurrences: h = a h + b


def affine(left: Arrays, right: Arrays) -> Arrays:
    """Of summaries (a, b), one pair for each recurrence: first the left step, then the right one."""
    out: list[np.ndarray] = []
    for k in range(0, len(left), 2):
        out += [left[k] * right[k], left[k + 1] * right[k] + right[k + 1]]
    return tuple(out)


def affine_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], steps: Callable[..., Sequence[tuple[np.ndarray, np.ndarray]]], names: Sequence[str], start: Sequence[float]) -> DataFrame:
    """df with the recurrences h = a h + b as columns ``names``: steps(*inputs) gives (a, b) arrays for each, ``start`` the values before a key's first row. A null input counts as 0."""

    def element(*values):
        made = steps(*[np.nan_to_num(v) for v in values])
        return tuple(np.broadcast_to(np.asarray(x, float), values[0].shape).copy() for pair in made for x in pair)

    columns = [f"__{p}{k}" for k in range(len(names)) for p in "ab"]
    out = block_scan(df, keys, order, inputs, element, affine, (1.0, 0.0) * len(names), columns)
    return out.select(*df.columns, *[(F.col(f"__a{k}") * F.lit(float(s)) + F.col(f"__b{k}")).alias(c) for k, (c, s) in enumerate(zip(names, start, strict=True))])


# running sums and neighbours in ranges


@dataclass(frozen=True)
class Ranges:
    """Rows in the order of their keys. ``parted``: a column __part numbers ranges of the order, so that a key's rows need not meet; else each key is one range."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    parted: bool

    def _window(self):
        return Window.partitionBy(*self.keys, *["__part"] * self.parted).orderBy(*self.order)

    def _with(self, rows: DataFrame) -> Ranges:
        return Ranges(rows, self.keys, self.order, self.parted)

    def _carried(self, aggregates: dict[str, Column], carry: Callable[[str, WindowSpec], Column]) -> tuple[DataFrame, list[Column]]:
        """One row for each key and range with carry(column, ranges in order) of its aggregates, and the condition that joins it to rows."""
        own = [f"__k{n}" for n in range(len(self.keys))]
        parts = self.rows.groupBy(*[F.col(k).alias(o) for k, o in zip(self.keys, own, strict=True)], F.col("__part").alias("__p")).agg(*[a.alias(c) for c, a in aggregates.items()])
        parts = parts.select(*own, "__p", *[carry(c, Window.partitionBy(*own).orderBy("__p")).alias(c) for c in aggregates])
        return parts, [*[F.col(k).eqNullSafe(F.col(o)) for k, o in zip(self.keys, own, strict=True)], F.col("__part") == F.col("__p")]

    def columns(self, added: dict[str, Column]) -> Ranges:
        return self._with(self.rows.withColumns(added))

    def running(self, sums: dict[str, Column]) -> Ranges:
        """Running sums, the row included. A key's ranges are summed first; only those sums meet, one row a range."""
        upto = self._window().rowsBetween(Window.unboundedPreceding, 0)
        out = self.rows.withColumns({c: F.sum(s).over(upto) for c, s in sums.items()})
        if not self.parted:
            return self._with(out)
        parts, same = self._carried({f"__b_{c}": F.sum(s) for c, s in sums.items()}, lambda c, w: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        out = out.join(parts, same, "left").withColumns({c: F.col(c) + F.coalesce(f"__b_{c}", F.lit(0)) for c in sums})
        return self._with(out.select(*self.rows.columns, *[c for c in sums if c not in self.rows.columns]))

    def preceding(self, value: str, name: str) -> Ranges:
        """The ``value`` of the row before, null at a key's first row. The first row of a range gets the last value of the range before."""
        held = F.struct(F.col(value).alias("v"))
        out = self.rows.withColumn("__own", F.lag(held).over(self._window()))
        if not self.parted:
            return self._with(out.withColumn(name, F.col("__own.v")).drop("__own"))
        parts, same = self._carried({"__came": F.max_by(held, F.struct(*self.order))}, lambda c, w: F.lag(c).over(w))
        out = out.join(parts, same, "left").withColumn(name, F.coalesce("__own", "__came")["v"])
        return self._with(out.select(*self.rows.columns, name))

    def plain(self) -> DataFrame:
        return self.rows.drop("__part") if self.parted else self.rows


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int = HOT_ROWS) -> Ranges:
    """df by keys and order; where a key has more than hot_rows rows, in ranges, as a stored table, so that ranges stay what they are."""
    if largest(df, keys) <= hot_rows:
        return Ranges(df, tuple(keys), tuple(order), False)
    cut = df.repartitionByRange(_pieces(df.sparkSession), *keys, *order).withColumn("__part", F.spark_partition_id())
    return Ranges(stored(cut, "ranges"), tuple(keys), tuple(order), True)
