"""Event files as a Spark data source that plans byte ranges: a file larger than a task's memory is read by many tasks.

Small files and ranges share a task, which opens its files itself: planning and tasks grow with the bytes, not with the number of files or ranges.
Ranges end where records or packets end. Formats of equal records are cut by counting; packet headers of the 3.1 format are walked through, without their
bodies. A task reads its ranges' bytes only. The number of an event in its file is known from the plan, so ranges need not meet.
Files are opened through pyarrow's file systems: local and shared folders, object stores and HDFS by their address.
"""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scratch import ship
from .binary import EVENT_ROWS, aedat2, aedat3, atis40, event_batch
from .sinks import opened

SCHEMA = "path string, event_id bigint, t bigint, x int, y int, p int"
#: Bytes of a record, and whether the file begins with # lines (fixed values); 0: packets.
RECORDS = {"atis40": (5, False), "aedat2": (8, True), "aedat3": (0, True)}
PACKET_HEADER = 28
DECODE = {"atis40": atis40, "aedat2": lambda data: aedat2(data, header=False), "aedat3": lambda data: aedat3(data, header=False)}
#: Bytes of a range and of a task's ranges.
RANGE_BYTES = 64 << 20
#: Files or ranges of a task at most, and tasks that are planned at least where there are as many ranges.
TASK_PIECES, LEAST_TASKS = 1000, 16


@dataclass
class Range:
    """Bytes of a file from ``begin`` to ``end`` (None: all of it), whose first event has the number ``first``."""

    path: str
    begin: int
    end: int | None
    first: int


@dataclass
class Task(InputPartition):
    """Ranges that one task reads, one after the other."""

    ranges: list[Range]

    def __post_init__(self):
        super().__init__(len(self.ranges))


def header_end(f) -> int:
    """Where the lines that begin with # end."""
    at = 0
    while f.read_at(1, at) == b"#":
        while True:
            part = f.read_at(4096, at)
            cut = part.find(b"\n")
            if cut >= 0:
                at += cut + 1
                break
            if not part:
                return at
            at += len(part)
    return at


def ranges(f, kind: str, size: int, of: Range) -> Iterator[Range]:
    """The ranges of about ``size`` bytes of one open file, or of a range of it, in order."""
    record, has_header = RECORDS[kind]
    whole = of.end is None
    at, total = (header_end(f) if has_header else 0, f.size()) if whole else (of.begin, of.end)
    if record:
        if whole and kind == "aedat2" and (total - at) % record:
            raise ValueError("an odd number of words")
        step = max(1, size // record) * record
        end = at + (total - at) // record * record
        for begin in range(at, end, step):
            yield Range(of.path, begin, min(end, begin + step), of.first + (begin - at) // record)
        return
    begin, first, events = at, of.first, of.first
    while at + PACKET_HEADER <= total:
        head = f.read_at(PACKET_HEADER, at)
        packet, width, capacity = struct.unpack_from("<H", head)[0], struct.unpack_from("<I", head, 4)[0], struct.unpack_from("<I", head, 16)[0]
        body = min(capacity * width, max(0, total - at - PACKET_HEADER))
        if packet == 1 and width >= 8:
            events += body // width
        at += PACKET_HEADER + capacity * width
        if at - begin >= size or at + PACKET_HEADER > total:
            yield Range(of.path, begin, min(at, total), first)
            begin, first = at, events


def dealt(pieces: Iterator[tuple[Range, int]], share: int) -> list[Task]:
    """Neighbouring pieces, with their bytes, as tasks of about ``share`` bytes and at most TASK_PIECES pieces."""
    out: list[Task] = []
    held: list[Range] = []
    full = 0
    for piece, size in pieces:
        if held and (full + size > share or len(held) >= TASK_PIECES):
            out.append(Task(held))
            held, full = [], 0
        held.append(piece)
        full += size
    return out + [Task(held)] * bool(held)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"], options["kind"]
        self.pattern, self.size = options.get("pattern", "*"), int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.tasks = max(1, int(options.get("tasks", LEAST_TASKS)))
        if self.kind not in RECORDS:
            raise ValueError(f"no ranges for files of kind {self.kind}")

    def partitions(self) -> list[Task]:
        """Tasks by the sizes that the listing gives: only files larger than a task's share are opened here."""
        system, root = opened(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted(((x.path, x.size) for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, self.pattern)))
        share = max(self.size, min(RANGE_BYTES, -(-sum(size for _, size in files) // self.tasks)))

        def pieces() -> Iterator[tuple[Range, int]]:
            for path, size in files:
                file = Range(path, 0, None, 0)
                if size <= share:
                    yield file, size
                    continue
                with system.open_input_file(path) as f:
                    yield from ((r, r.end - r.begin) for r in ranges(f, self.kind, share, file))

        return dealt(pieces(), share) or [Task([])]

    def read(self, part: Task) -> Iterator[pa.RecordBatch]:
        """One range is held at a time; the events of small ones share a batch."""
        system, _ = opened(self.path)
        held: list[tuple[str, int, dict[str, np.ndarray]]] = []

        rows = 0
        for piece in part.ranges:
            with system.open_input_file(piece.path) as f:
                for r in ranges(f, self.kind, self.size, piece):
                    e = DECODE[self.kind](f.read_at(r.end - r.begin, r.begin))
                    for a in range(0, len(e["t"]), EVENT_ROWS):
                        held.append((r.path, r.first + a, {k: v[a : a + EVENT_ROWS] for k, v in e.items()}))
                        rows += len(held[-1][2]["t"])
                        if rows >= EVENT_ROWS:
                            yield event_batch(held)
                            held.clear()
                            rows = 0
        if held:
            yield event_batch(held)


class EventRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_ranges(spark: SparkSession, path: str, kind: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, event_id (order in the file), t, x, y, p of all event files below a folder (or of one file), read in byte ranges. Kinds: those in RECORDS."""
    ship(spark)
    spark.dataSource.register(EventRanges)
    tasks = max(LEAST_TASKS, 2 * spark.sparkContext.defaultParallelism)
    return spark.read.format("event_ranges").option("kind", kind).option("pattern", pattern).option("rangeBytes", range_bytes).option("tasks", tasks).load(path)
