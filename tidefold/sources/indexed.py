"""Indexed token corpora (.bin of tokens, .idx of sizes and pointers) in parts: a corpus of any size is written and read by many tasks.

A corpus ``stem`` is one pair ``stem.bin``, ``stem.idx``, or pairs ``stem.part00000.bin``, .., each a whole corpus by itself. Items count on from part to part.
Only .idx files are read whole (12 bytes an item of one part); tokens are read in byte ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.blocks import HOT_ROWS, ranged
from ..functions.scratch import qualified, ship
from .binary import INDEX_TYPES, index_bytes, index_items
from .sinks import opened, write_files

#: Tokens of a part, and bytes that one row of a reading plan stands for.
PART_TOKENS, RUN_BYTES = 1 << 24, 16 << 20
_NAME = r"^(.*?)(?:\.part(\d+))?\.idx$"


def write_indexed(items: DataFrame, folder: str, stem: str = "stem", order: str = "item", tokens: str = "tokens", code: int = 8, part_tokens: int = PART_TOKENS, hot_rows: int = HOT_ROWS) -> None:
    """Arrays of tokens as corpora below a folder, one a stem, in ``order`` (distinct within a stem).

    Where a part begins follows from running sums of sizes, which are summed in ranges for large stems; a task holds one part, ``part_tokens`` and one item at
    most. Null arrays are empty items. A token that the element type does not hold, a null token or a null stem is an error, and nothing is written. No rows
    make an empty folder."""
    kind = np.dtype(INDEX_TYPES[code])
    if kind.kind == "f":
        raise ValueError("tokens are whole numbers")
    arrays = F.coalesce(F.col(tokens).cast("array<bigint>"), F.array().cast("array<bigint>"))
    rows = items.select(F.col(stem).alias("stem"), F.col(order).alias("at"), arrays.alias("tokens")).withColumn("n", F.size("tokens").cast("bigint"))
    placed = ranged(rows, ["stem"], ["at"], hot_rows).running({"upto": F.col("n")}).plain()
    parts = placed.select("stem", "at", "tokens", F.expr(f"(upto - n) div {part_tokens}").alias("part"))

    def run(key: tuple, group: pa.Table) -> pa.Table:
        if key[0].as_py() is None:
            raise ValueError("a corpus without a name")
        held = group.sort_by("at").column("tokens").combine_chunks()
        flat, sizes = held.flatten(), held.value_lengths().to_numpy()
        values = flat.to_numpy(zero_copy_only=False)
        own = values.astype(kind)
        if flat.null_count or not (own == values).all():
            raise ValueError(f"a token that {kind} does not hold")
        name = f"{key[0].as_py()}.part{key[1].as_py():05d}"
        return pa.table({"name": [f"{name}.bin", f"{name}.idx"], "content": pa.array([own.tobytes(), index_bytes(sizes, code)], pa.binary())})

    ship(items.sparkSession)
    write_files(parts.groupBy("stem", "part").applyInArrow(run, "name string, content binary"), folder)


def _indices(spark: SparkSession, path: str) -> DataFrame:
    """stem, bin, first (items of the stem before this part), idx. The items are counted from the heads of the .idx files: one row a part."""
    ship(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.idx")
    files = reader.load(qualified(spark, path)).select("path", F.col("content").alias("idx"))
    name = [F.regexp_extract("path", _NAME, k) for k in (1, 2)]
    # the number of items is eight bytes from the 19th, the lowest first; a file has far under 2 ** 31 of them, so four are read
    head = [F.conv(F.hex(F.substring("idx", k, 1)), 16, 10).cast("bigint") for k in (19, 20, 21, 22)]
    counted = files.select(name[0].alias("stem"), F.coalesce(name[1].try_cast("int"), F.lit(0)).alias("part"), F.col("path").alias("file"), sum(h * 256**k for k, h in enumerate(head)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("stem").orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counted.select("stem", "file", F.coalesce(before, F.lit(0)).alias("first"))
    return files.join(firsts, F.col("path") == F.col("file")).select("stem", F.regexp_replace("path", r"idx$", "bin").alias("bin"), "first", "idx")


def _read(system_path: str, begin: int, size: int) -> bytes:
    system, at = opened(system_path)
    with system.open_input_file(at) as f:
        data = f.read_at(size, begin)
    if len(data) < size:
        raise ValueError(f"{system_path} ends before byte {begin + size}")
    return data


def _values(data: bytes, kind: str) -> pa.Array:
    return pa.array(np.frombuffer(data, kind).astype(np.int64))


def read_indexed(spark: SparkSession, path: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """path (the stem), item, tokens (array of long) of all corpora below a folder, in ranges of about run_bytes that any task may read."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stem, file, first, idx in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kind, sizes, pointers, _ = index_items(idx)
                width = np.dtype(kind).itemsize
                ends = pointers + sizes * width
                if not len(sizes):
                    continue
                # a new run at a gap, and where run_bytes are full
                cut = np.diff(pointers // run_bytes, prepend=-1) != 0
                cut[1:] |= pointers[1:] != ends[:-1]
                cut[0] = True
                cuts = np.flatnonzero(cut).tolist()
                for a, z in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
                    yield pa.RecordBatch.from_pydict({"stem": [stem], "bin": [file], "kind": [kind], "item": [first + a], "begin": [int(pointers[a])], "sizes": pa.array([sizes[a:z]], pa.list_(pa.int64()))})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stem, file, kind, item, begin, sizes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = _read(file, begin, sum(sizes) * np.dtype(kind).itemsize)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([stem] * len(sizes)), pa.array(item + np.arange(len(sizes))), pa.ListArray.from_arrays(offsets, _values(data, kind))], names=["path", "item", "tokens"])

    runs = _indices(spark, path).mapInArrow(plan, "stem string, bin string, kind string, item bigint, begin bigint, sizes array<bigint>")
    return runs.repartition("bin", "begin").mapInArrow(fetch, "path string, item bigint, tokens array<bigint>")


def read_slices(spark: SparkSession, path: str, wanted: DataFrame, offset: int = 0, length: int | None = None) -> DataFrame:
    """path (the stem, with its scheme), item, tokens: of each wanted (path, item) the tokens from ``offset`` on, ``length`` of them at most. Only their bytes are read, in the order of the file.

    Items that do not exist give no row; an offset beyond an item gives no tokens; a wanted item that repeats comes once."""
    if offset < 0 or (length is not None and length < 0):
        raise ValueError("offset and length are not negative")

    def pointers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stem, file, first, idx in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kind, sizes, places, _ = index_items(idx)
                for a in range(0, len(sizes), 100_000):
                    s = slice(a, min(len(sizes), a + 100_000))
                    n = s.stop - a
                    yield pa.RecordBatch.from_pydict({"stem": [stem] * n, "bin": [file] * n, "kind": [kind] * n, "item": first + np.arange(a, s.stop), "begin": places[s], "size": sizes[s]})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in batches:
            for stem, file, kind, item, begin, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    if f:
                        f.close()
                    system, at = opened(file)
                    name, f = file, system.open_input_file(at)
                width = np.dtype(kind).itemsize
                n = max(0, size - offset) if length is None else min(length, max(0, size - offset))
                data = f.read_at(n * width, begin + offset * width)
                yield pa.RecordBatch.from_arrays([pa.array([stem]), pa.array([item], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), _values(data, kind))], names=["path", "item", "tokens"])
        if f:
            f.close()

    known = _indices(spark, path).mapInArrow(pointers, "stem string, bin string, kind string, item bigint, begin bigint, size bigint")
    asked = wanted.select(F.col("path").alias("stem"), F.col("item").cast("bigint").alias("item")).distinct()
    found = known.join(asked, ["stem", "item"], "left_semi").select("stem", "bin", "kind", "item", "begin", "size")
    # many tasks may read one file, each a stretch of it
    return found.repartitionByRange("bin", "begin").sortWithinPartitions("bin", "begin").mapInArrow(fetch, "path string, item bigint, tokens array<bigint>")
