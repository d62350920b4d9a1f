"""Ordered scans: a state carried along the rows of a key in order, with memory for one state and one window of rows.

Rows are dealt by key and sorted within partitions; a key's rows pass through one task as a stream and are never collected.
A recurrence is sequential within a key, so keys are the unit of parallel work. In lockstep() the keys of a window are lanes of
numpy arrays, longest first: one vector operation takes step t of all keys that are long enough.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import ship

State, Row = Any, tuple
#: Rows of a window; fewer lanes than this are stepped row by row.
WINDOW, LANES = 1 << 16, 6
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "string": pa.string()}


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], start: Callable[[], State], step: Callable[..., tuple[State, Row]], outputs: str) -> DataFrame:
    """df with the columns of ``outputs`` (a DDL list) added: step(state, *inputs) -> (state, values) along each key.

    The order must be total for the result to be determined. Null inputs are passed on as None."""
    kinds = [f"`{c}` {t}" for c, t in df.dtypes]
    added = [x.strip().split(" ") for x in outputs.split(",")]
    names = [*df.columns, *(a[0] for a in added)]
    types = [_TYPES[a[1]] for a in added]
    at_key, at_in = [df.columns.index(k) for k in keys], [df.columns.index(c) for c in inputs]

    def run(batches):
        last, state = None, None
        for b in batches:
            key_rows = zip(*(b.column(k).to_pylist() for k in at_key), strict=True)
            out: list[Row] = []
            for key, *values in zip(key_rows, *(b.column(k).to_pylist() for k in at_in), strict=True):
                if last is None or key != last:
                    last, state = key, start()
                state, row = step(state, *values)
                out.append(row)
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=names)

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, ", ".join([*kinds, *(" ".join(a) for a in added)]))


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether a row's key differs from the row before; the first row is marked."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
        out[1:] |= codes[1:] != codes[:-1]
    return out


def _numbers(column: pa.Array, null: float) -> np.ndarray:
    """One number a row, or one row of numbers where the column holds lists of one length."""
    if pa.types.is_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(column), -1)
    return column.cast(pa.float64()).fill_null(null).to_numpy(zero_copy_only=False)


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind):
        return pa.array(list(values), kind)
    return pa.array(values.astype(kind.to_pandas_dtype()), kind)


def lockstep(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], start: Sequence[Any], many: Callable[..., tuple[tuple, tuple]], outputs: str, one: Callable[..., tuple[tuple, tuple]] | None = None, null: float = 0.0) -> DataFrame:
    """df with the columns of ``outputs`` (a DDL list) added: many(state, *inputs) -> (state, values) takes one step of many keys.

    state: a tuple of arrays with a lane for each key, from the numbers or vectors in ``start``; inputs: arrays of as many lanes, ``null`` for nulls; list inputs
    have one length. ``one`` is the same step for a single key on plain numbers, for windows of few keys; each key's arithmetic is sequential and the same in both.
    The order must be total for the result to be determined."""
    ship(df.sparkSession)
    columns = df.columns
    kinds = [f"`{c}` {t}" for c, t in df.dtypes]
    added = [x.strip().split(" ") for x in outputs.split(",")]
    names = [*columns, *(a[0] for a in added)]
    types = [_TYPES[a[1]] for a in added]
    at_key, at_in = [columns.index(k) for k in keys], [columns.index(c) for c in inputs]

    def advance(values: list[np.ndarray], begins: np.ndarray, rows: int, carried: tuple | None) -> tuple[list[np.ndarray], tuple]:
        """Outputs of all rows, and the state after the last; carried: the state that the first run of rows goes on from."""
        length = np.diff(np.append(begins, rows))
        rank = np.argsort(-length, kind="stable")
        begin, length = begins[rank], length[rank]
        state = tuple(np.repeat(np.asarray(s, float)[None], len(begin), axis=0) for s in start)
        if carried is not None:
            for s, c in zip(state, carried, strict=True):
                s[np.flatnonzero(begin == 0)] = c
        out: list[np.ndarray] | None = None
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # lanes longer than t
        for t, n in enumerate(active.tolist()):
            if one is not None and n < LANES:
                for lane in range(n):
                    cells = [v[begin[lane] + t : begin[lane] + length[lane]].tolist() for v in values]
                    now, made = tuple(s[lane].item() for s in state), []
                    for row in zip(*cells, strict=True):
                        now, values_out = one(now, *row)
                        made.append(values_out)
                    for s, c in zip(state, now, strict=True):
                        s[lane] = c
                    if out is None:
                        out = [np.zeros(rows) for _ in added]
                    for o, c in zip(out, zip(*made, strict=True), strict=True):
                        o[begin[lane] + t : begin[lane] + length[lane]] = c
                break
            at = begin[:n] + t
            after, made = many(tuple(s[:n] for s in state), *[v[at] for v in values])
            for s, a in zip(state, after, strict=True):
                s[:n] = a
            made = [np.broadcast_to(np.asarray(m, float), (n, *np.shape(m)[1:])) for m in made]
            if out is None:
                out = [np.zeros((rows, *m.shape[1:])) for m in made]
            for o, m in zip(out, made, strict=True):
                o[at] = m
        last = int(np.flatnonzero(begin == begins[-1])[0])
        return out, tuple(s[last].copy() for s in state)

    def run(batches):
        held: list[pa.RecordBatch] = []
        last, state = None, None

        def flush():
            nonlocal last, state
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            b = table.to_batches()[0]
            key = [b.column(k) for k in at_key]
            fresh = changes(key)
            goes_on = last is not None and [c[0].as_py() for c in key] == last
            out, state = advance([_numbers(b.column(k), null) for k in at_in], np.flatnonzero(fresh), b.num_rows, state if goes_on else None)
            last = [c[b.num_rows - 1].as_py() for c in key]
            return pa.RecordBatch.from_arrays([*b.columns, *(_column(o, t) for o, t in zip(out, types, strict=True))], names=names)

        rows = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= WINDOW:
                yield flush()
                rows = 0
        if held:
            yield flush()

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, ", ".join([*kinds, *(" ".join(a) for a in added)]))
