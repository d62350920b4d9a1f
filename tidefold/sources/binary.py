"""Binary inputs as DataFrames: event cameras, token arrays, indexed corpora, archives.

Files come through Spark's binaryFile source, one row a file, and are decoded in numpy an Arrow batch at a time.
Decoders take bytes and give columns, so they need no file system of their own.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import ship
from . import matlab
from .sinks import write_files

Events = dict[str, np.ndarray]
#: Events of an Arrow batch, bytes of a batch of encoded files, and Spark's splits of small files (some 32 files each) that one task decodes.
EVENT_ROWS, FILE_BYTES, TASK_SPLITS = 100_000, 4 << 20, 32


def _header_end(data: bytes) -> int:
    """The end of the leading lines that begin with #."""
    at = 0
    while data[at : at + 1] == b"#":
        stop = data.find(b"\n", at)
        if stop < 0:
            return len(data)
        line, at = data[at : stop + 1], stop + 1
        if line.startswith(b"#!END-HEADER"):
            break
    return at


def aedat3(data: bytes, header: bool = True) -> Events:
    """Polarity packets (type 1) of the 3.1 format; others are skipped. 28-byte packet headers, little-endian."""
    at, parts = _header_end(data) if header else 0, []
    while at + 28 <= len(data):
        kind = int.from_bytes(data[at : at + 2], "little")
        size, _, overflow, capacity = np.frombuffer(data, "<u4", 4, at + 4).astype(np.int64).tolist()
        at += 28
        body = np.frombuffer(data, np.uint8, min(capacity * size, len(data) - at), at)
        at += capacity * size
        if kind == 1 and size >= 8:
            rows = body[: len(body) // size * size].reshape(-1, size)[:, :8].copy().view("<u4").astype(np.int64)
            parts.append((rows[:, 0], rows[:, 1] | overflow << 31))
    address, t = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
    return {"t": t, "x": address >> 17 & 0x7FFF, "y": address >> 2 & 0x7FFF, "p": address >> 1 & 1}


def atis40(data: bytes) -> Events:
    """Five bytes an event: x, y, then polarity and 23 bits of time, big-endian."""
    r = np.frombuffer(data, np.uint8, len(data) // 5 * 5).reshape(-1, 5).astype(np.int64)
    return {"t": (r[:, 2] & 127) << 16 | r[:, 3] << 8 | r[:, 4], "x": r[:, 0], "y": r[:, 1], "p": r[:, 2] >> 7}


def aedat2(data: bytes, only_dvs: bool = False, swap: bool = True, header: bool = True) -> Events:
    """Big-endian address and time pairs of a 128 by 128 sensor; with swap, (x, y, p) become (127 - y, 127 - x, 1 - p)."""
    at = _header_end(data) if header else 0
    if (len(data) - at) % 8:
        raise ValueError("an odd number of words")
    pair = np.frombuffer(data, ">u4", offset=at).reshape(-1, 2).astype(np.int64)
    if only_dvs:
        pair = pair[pair[:, 0] >> 31 == 0]
    a, t = pair[:, 0], pair[:, 1]
    x, y, p = (a & 0xFE) >> 1, (a & 0x7F00) >> 8, a & 1
    return {"t": t, "x": 127 - y, "y": 127 - x, "p": 1 - p} if swap else {"t": t, "x": x, "y": y, "p": p}


#: Fields of the 64-bit event words (fixed values): time, x, y, polarity as (first bit, bits).
TD_FIELDS = {"t": (0, 32), "x": (32, 9), "y": (41, 8), "p": (49, 1)}


def atis_td(data: bytes, zero: bool = True, monotone: bool = True) -> Events:
    """64-bit events after a % text header and two bytes of type and size. ``monotone`` drops events that go back in time; ``zero`` starts time at 0."""
    at, header = 0, False
    while data[at : at + 1] == b"%":
        at, header = data.find(b"\n", at) + 1, True
    if header:
        if data[at + 1] != 8:
            raise ValueError("events must have 8 bytes")
        at += 2
    w = np.frombuffer(data, "<u8", (len(data) - at) // 8, at)
    e = {k: (w >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for k, (a, n) in TD_FIELDS.items()}
    if monotone and len(w):
        keep = e["t"] >= np.maximum.accumulate(e["t"])
        e = {k: v[keep] for k, v in e.items()}
    if zero and len(w):
        e["t"] = e["t"] - e["t"][0]
    return e


def _arrays(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data), allow_pickle=False).items())


def pos_neg_npz(data: bytes) -> Events:
    """Archives with pos and neg arrays of (x, y, t): stacked, tagged by polarity, ordered by time, x and y exchanged."""
    a = _arrays(data)
    pos, neg = a["pos"].reshape(-1, a["pos"].shape[-1]), a["neg"].reshape(-1, a["neg"].shape[-1])
    both = np.vstack([pos[:, :3], neg[:, :3]]).astype(np.int64)
    p = np.repeat([1, 0], [len(pos), len(neg)])
    order = np.argsort(both[:, 2], kind="stable")
    return {"t": both[order, 2], "x": both[order, 1], "y": both[order, 0], "p": p[order]}


def txyp_npz(data: bytes) -> Events:
    a = _arrays(data)
    return {k: a[k].astype(np.int64) for k in "txyp"}


def mat_events(data: bytes) -> Events:
    """MATLAB level-5 files with ts, x, y, pol."""
    m = matlab.read_arrays(data)
    return {k: m[n].ravel().astype(np.int64) for k, n in zip("txyp", ("ts", "x", "y", "pol"), strict=True)}


DECODERS: dict[str, Callable[[bytes], Events]] = {"aedat3": aedat3, "atis40": atis40, "aedat2": aedat2, "atis_td": atis_td, "pos_neg_npz": pos_neg_npz, "npz": txyp_npz, "mat": mat_events}


def _files(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    ship(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content")


def read_events(spark: SparkSession, path: str, kind: str, pattern: str | None = None) -> DataFrame:
    """path, event_id (order in the file), t, x, y, p of all event files below a folder."""
    decode = DECODERS[kind]

    def run(batches):
        held: list[tuple[str, int, Events]] = []
        rows = 0
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                e = decode(content.as_py())
                for a in range(0, len(e["t"]), EVENT_ROWS):
                    held.append((name, a, {k: v[a : a + EVENT_ROWS] for k, v in e.items()}))
                    rows += len(held[-1][2]["t"])
                    if rows >= EVENT_ROWS:
                        yield event_batch(held)
                        held.clear()
                        rows = 0
        if held:
            yield event_batch(held)

    files = _files(spark, path, pattern)
    tasks = -(-files.select("path").rdd.getNumPartitions() // TASK_SPLITS)
    few = files.coalesce(max(tasks, 4 * spark.sparkContext.defaultParallelism))  # never more than there are
    return few.mapInArrow(run, "path string, event_id bigint, t bigint, x int, y int, p int")


def event_batch(parts: list[tuple[str, int, Events]]) -> pa.RecordBatch:
    """One batch of the events of several files: (path, number of the first event, events)."""
    lengths = [len(e["t"]) for _, _, e in parts]
    paths = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(parts), dtype=np.int32), lengths)), pa.array([p for p, _, _ in parts])).dictionary_decode()
    number = np.concatenate([first + np.arange(n) for (_, first, _), n in zip(parts, lengths, strict=True)])
    t, x, y, p = (np.concatenate([e[k] for _, _, e in parts]) for k in "txyp")
    return pa.RecordBatch.from_arrays([paths, pa.array(number), pa.array(t), *(pa.array(v.astype(np.int32)) for v in (x, y, p))], names=["path", "event_id", "t", "x", "y", "p"])


def read_frames(spark: SparkSession, path: str, pattern: str = "*.npz") -> DataFrame:
    """path, frame, channel, y, x, n: the non-zero cells of the frames arrays of archives."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                f = _arrays(content.as_py())["frames"]
                at = np.nonzero(f)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at[0])), *(pa.array(a.astype(np.int32)) for a in at), pa.array(f[at].astype(np.float64))], names=["path", "frame", "channel", "y", "x", "n"])

    return _files(spark, path, pattern).mapInArrow(run, "path string, frame int, channel int, y int, x int, n double")


def read_npy(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """path, pos, token of flat token arrays."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                a = np.load(io.BytesIO(content.as_py()), allow_pickle=False).ravel()
                for k in range(0, len(a), 1 << 20):
                    part = a[k : k + (1 << 20)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(k, k + len(part))), pa.array(part.astype(np.int32))], names=["path", "pos", "token"])

    return _files(spark, path, pattern).mapInArrow(run, "path string, pos bigint, token int")


#: Element types of the indexed format, by code (fixed values).
INDEX_TYPES = {1: "<u1", 2: "<i1", 3: "<i2", 4: "<i4", 5: "<i8", 6: "<f8", 7: "<f8", 8: "<u2"}
INDEX_MAGIC = b"MMIDIDX\x00\x00"


def index_items(index: bytes) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(element type, sizes, byte pointers, document borders) of an .idx file."""
    if index[:9] != INDEX_MAGIC or int.from_bytes(index[9:17], "little") != 1:
        raise ValueError("not an index of version 1")
    n, docs = np.frombuffer(index, "<u8", 2, 18).astype(np.int64).tolist()
    sizes = np.frombuffer(index, "<i4", n, 34).astype(np.int64)
    return INDEX_TYPES[index[17]], sizes, np.frombuffer(index, "<i8", n, 34 + 4 * n), np.frombuffer(index, "<i8", docs, 34 + 12 * n)


def index_bytes(sizes: np.ndarray, code: int = 8) -> bytes:
    """The .idx of items that lie one after the other, one document each."""
    n, width = len(sizes), np.dtype(INDEX_TYPES[code]).itemsize
    pointers = np.zeros(n, "<i8")
    np.cumsum(np.asarray(sizes, np.int64)[:-1] * width, out=pointers[1:])
    head = INDEX_MAGIC + (1).to_bytes(8, "little") + bytes([code]) + n.to_bytes(8, "little") + (n + 1).to_bytes(8, "little")
    return head + np.asarray(sizes, "<i4").tobytes() + pointers.tobytes() + np.arange(n + 1, dtype="<i8").tobytes()


def write_index(items: list[np.ndarray], code: int = 8) -> tuple[bytes, bytes]:
    """(.bin, .idx) of a list of token arrays, one document each."""
    return b"".join(np.asarray(i, INDEX_TYPES[code]).tobytes() for i in items), index_bytes(np.array([len(i) for i in items], np.int64), code)


def item_slice(tokens, offset: int = 0, length: int | None = None):
    """get(item, offset, length) as an expression."""
    col = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.slice(col, offset + 1, F.size(col) if length is None else F.lit(length))


def npz_bytes(compressed: bool = True, **arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    (np.savez_compressed if compressed else np.savez)(out, **arrays)
    return out.getvalue()


def extract(data: bytes) -> dict[str, bytes]:
    """The members of a zip archive."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n: z.read(n) for n in z.namelist() if not n.endswith("/")}


# the other way: bytes of event files


def _pairs(a: np.ndarray, b: np.ndarray, kind: str) -> bytes:
    return np.stack([a, b], 1).astype(kind).tobytes()


def to_aedat3(e: Events, capacity: int = 4096) -> bytes:
    """One polarity packet for each ``capacity`` events whose times share their upper bits."""
    parts, at = [b"#!AER-DAT3.1\r\n#!END-HEADER\r\n"], 0
    high = e["t"] >> 31
    while at < len(high):
        same = np.flatnonzero(high[at : at + capacity] != high[at])
        end = at + int(same[0]) if len(same) else min(len(high), at + capacity)
        word = e["x"][at:end] << 17 | e["y"][at:end] << 2 | e["p"][at:end] << 1 | 1
        n = end - at
        parts += [np.array([1, 0], "<u2").tobytes(), np.array([8, 4, high[at], n, n, n], "<u4").tobytes(), _pairs(word, e["t"][at:end] & 0x7FFFFFFF, "<u4")]
        at = end
    return b"".join(parts)


def to_atis40(e: Events) -> bytes:
    """Times have 23 bits; a longer one cannot be told and is an error."""
    t = e["t"]
    if len(t) and (t.min() < 0 or t.max() >> 23):
        raise ValueError("a time that 23 bits do not hold")
    return np.stack([e["x"], e["y"], e["p"] << 7 | t >> 16 & 127, t >> 8 & 255, t & 255], 1).astype(np.uint8).tobytes()


def to_aedat2(e: Events) -> bytes:
    """As aedat2() reads it without ``swap``."""
    return b"#!AER-DAT2.0\r\n" + _pairs(e["x"] << 1 | e["y"] << 8 | e["p"], e["t"], ">u4")


def to_atis_td(e: Events) -> bytes:
    words = sum(e[k].astype(np.uint64) << np.uint64(at) for k, (at, _) in TD_FIELDS.items())
    return b"% Data file\n" + bytes([0, 8]) + words.astype("<u8").tobytes()


def to_pos_neg_npz(e: Events) -> bytes:
    rows = np.stack([e["y"], e["x"], e["t"]], 1)
    return npz_bytes(pos=rows[e["p"] == 1], neg=rows[e["p"] == 0])


def to_mat(e: Events) -> bytes:
    return matlab.write_arrays({"ts": e["t"].astype(np.float64), "x": e["x"].astype(np.uint16), "y": e["y"].astype(np.uint16), "pol": e["p"].astype(np.uint8)})


ENCODERS: dict[str, Callable[[Events], bytes]] = {"aedat3": to_aedat3, "atis40": to_atis40, "aedat2": to_aedat2, "atis_td": to_atis_td, "pos_neg_npz": to_pos_neg_npz, "npz": lambda e: npz_bytes(**e), "mat": to_mat}


def encode_events(events: DataFrame, name: str, kind: str) -> DataFrame:
    """(name, content): the events (t, x, y, p) of each file name, in order of t and event_id, as bytes of a format. A file is one value in memory, as any reader of it needs."""
    encode = ENCODERS[kind]
    ship(events.sparkSession)

    def run(batches):
        name, parts, out, size = None, [], [], 0

        def done() -> int:
            """Encodes the file whose events are held."""
            e = {k: np.concatenate([p[k] for p in parts]) for k in "txyp"}
            out.append((name, encode(e)))
            parts.clear()
            return len(out[-1][1])

        def files() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.string()), pa.array([c for _, c in out], pa.binary())], names=["name", "content"])
            out.clear()
            return made

        for b in batches:
            if not b.num_rows:
                continue
            names = b.column(0)
            codes = names.dictionary_encode(null_encoding="encode").indices.to_numpy()
            columns = {k: b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c, k in enumerate("txyp", 1)}
            borders = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), b.num_rows]
            for a, e in pairwise(borders):
                here = names[a].as_py()
                if parts and here != name:
                    size += done()
                    if size >= FILE_BYTES:
                        yield files()
                        size = 0
                name = here
                parts.append({k: v[a:e] for k, v in columns.items()})
        if parts:
            done()
        if out:
            yield files()

    rows = events.select(F.col(name).alias("name"), "t", "x", "y", "p", "event_id").repartition("name").sortWithinPartitions("name", "t", "event_id")
    return rows.select("name", "t", "x", "y", "p").mapInArrow(run, "name string, content binary")


def write_npy(stream: DataFrame, folder: str, rows: int = 1 << 20, kind: str = "<u2") -> None:
    """stream(pos, token) as .npy files of ``rows`` tokens each, named by their place."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        tokens = group.sort_by("pos").column("token").to_numpy().astype(kind)
        out = io.BytesIO()
        np.save(out, tokens)
        return pa.table({"name": [f"{key[0].as_py():08d}.npy"], "content": pa.array([out.getvalue()], pa.binary())})

    write_files(stream.select(F.expr(f"pos div {rows}").alias("k"), "pos", "token").groupBy("k").applyInArrow(run, "name string, content binary"), folder)
