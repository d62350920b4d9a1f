"""Token-id files: whole texts as ids, in ascending order of document id, in the range coder's format.

One file holds the ids of consecutive documents (at most about FILE_IDS), an index of their ids and
lengths with a checksum of its own, and the coded blocks. Files are rows (part, seq, start, n_ids, data)
of a stored table, so a lost executor's file is written again by Spark, and readers need no common disk;
export() writes them out as plain files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import sinks
from .bpe import encoder
from .rangecoder import decode, encode
from .runtime import ship, spread, stored

MAGIC = b"TOKFILE1"
FILE_IDS = 8 << 20


def pack_file(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One file of documents; ids are little-endian unsigned 32-bit integers."""
    index = b"".join(
        (
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array([len(x) // 4 for x in ids], "<i8").tobytes(),
        )
    )
    index = zlib.compress(index, 6)
    return MAGIC + np.array([len(doc_ids), len(index), zlib.crc32(index)], "<u4").tobytes() + index + encode(np.frombuffer(b"".join(ids), "<u4"))


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, all ids); ValueError if anything in it is damaged."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n, size, crc = np.frombuffer(data, "<u4", 3, 8).tolist()
    packed = data[20 : 20 + size]
    if zlib.crc32(packed) != crc:
        raise ValueError("the index is damaged")
    index = zlib.decompress(packed)
    null = np.frombuffer(index, np.uint8, n, 8 * n)
    docs = [None if z else d for d, z in zip(np.frombuffer(index, "<i8", n).tolist(), null.tolist(), strict=True)]
    return docs, np.frombuffer(index, "<i8", n, 9 * n), decode(data[20 + size :])


def write_files(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The files of all documents, as a stored table (part, seq, start, n_ids, data); parts ascend with document id, start counts ids within a part.

    Documents are dealt by ranges of their id. A null text is empty. Null ids come first; rows that repeat an id stand next to each other, ordered by their texts' hash."""
    spark = docs.sparkSession
    ship(spark)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        enc = encoder(path)
        part, seq, start, keys, ids, held = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([held], pa.int64()), pa.array([pack_file(keys, ids)], pa.binary())], names=["part", "seq", "start", "n_ids", "data"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = enc.encode(t or "") + end
                keys.append(d), ids.append(x)
                held += len(x) // 4
                if held >= FILE_IDS:
                    yield out()
                    seq, start, keys, ids, held = seq + 1, start + held, [], [], 0
        if keys:
            yield out()

    dealt = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(spread(spark), "id")
    ordered = dealt.sortWithinPartitions("id", F.xxhash64("text"))
    return stored(spark, ordered.mapInArrow(run, "part int, seq int, start bigint, n_ids bigint, data binary"), "tokens")


def read_files(files: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document from the files: id, start (ids of all documents before it), n_tokens, ids_crc32 (and the ids as binary)."""
    sums = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row a part
    before = dict(zip([p for p, _ in sums], np.cumsum([0, *(n for _, n in sums)]).tolist(), strict=False))

    def run(batches):
        for b in batches:
            for part, start, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                keys, lengths, ids = unpack_file(data.as_py())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                cut = [raw[4 * a : 4 * e] for a, e in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(keys, pa.int64()), pa.array(before[part] + start + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(map(bytes, cut), pa.binary()) for _ in range(with_ids)], names=[id_col, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return files.select("part", "start", "data").mapInArrow(run, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def export(files: DataFrame, folder: str) -> None:
    """Write each file as part-seq.tok into a folder of any file system: all of them or, where the job fails, none."""
    name = F.format_string("%06d-%06d.tok", "part", "seq")
    sinks.write_files(files.select(name.alias("name"), F.col("data").alias("content")), folder)


def token_files(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents' ids to files and reads them back: one row per document. An empty table gives an empty result; other columns are not read."""
    return read_files(write_files(docs, path, end_id, id_col, text_col), id_col)
