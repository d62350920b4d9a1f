"""Files written by tasks and moved to their places by one commit: a Spark data source for rows (name, content).

A task writes below a hidden folder of its own attempt. Attempts that fail, run twice or lose their executor leave nothing but hidden files; Spark commits one
attempt of each partition, and only then do files get their names. Files go through pyarrow's file systems: shared folders, object stores and HDFS by their address.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.scratch import qualified, ship

#: Threads that move files when a job is committed, and files that a thread takes at once.
MOVES, MOVED = 16, 64
#: Times that a folder is cleared while tasks may still write to it.
CLEARS = 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it; a bare path is local."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else "file://" + path)


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.hidden = options["path"], f"_attempts-{uuid.uuid4().hex}"
        system, root = opened(self.path)
        system.create_dir(posixpath.join(root, self.hidden), recursive=True)
        with system.open_output_stream(self._running(root)):
            pass

    def _running(self, root: str) -> str:
        """A file that is there until the job ends: a task that outlives it writes no more, and clears what it wrote."""
        return posixpath.join(root, self.hidden, "running")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        attempt = posixpath.join(root, self.hidden, uuid.uuid4().hex)
        names = []
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"not a name below the folder: {name!r}")
                to = posixpath.join(attempt, name)
                system.create_dir(posixpath.dirname(to), recursive=True)
                with system.open_output_stream(to) as f:
                    f.write(content.as_buffer() if content.is_valid else b"")
                if system.get_file_info(self._running(root)).type == fs.FileType.NotFound:
                    self._clear(system, root)
                    raise RuntimeError("the job has ended")
                names.append(name)
        return Written(attempt, names)

    def commit(self, messages: list[Written | None]) -> None:
        """Moves the files of the attempts that count; names only come here, no contents."""
        system, root = opened(self.path)
        moves = [(posixpath.join(m.attempt, n), posixpath.join(root, n)) for m in messages if m for n in m.names]
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("two rows have the same name")
        for folder in {posixpath.dirname(to) for _, to in moves} | {root}:
            system.create_dir(folder, recursive=True)

        def move(some: list[tuple[str, str]]) -> None:
            for old in system.get_file_info([to for _, to in some]):
                if old.type != fs.FileType.NotFound:
                    system.delete_file(old.path)
            for pair in some:
                system.move(*pair)

        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(move, [moves[a : a + MOVED] for a in range(0, len(moves), MOVED)]))
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        at, running = posixpath.join(root, self.hidden), self._running(root)
        if system.get_file_info(running).type != fs.FileType.NotFound:
            system.delete_file(running)
        for left in range(CLEARS - 1, -1, -1):
            if system.get_file_info(at).type != fs.FileType.Directory:
                return
            try:
                system.delete_dir(at)
            except OSError:  # a task wrote, or cleared too, meanwhile
                if not left:
                    raise
                time.sleep(0.1)


class FileRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_rows"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("files are added to a folder; mode append only")
        return _Writer(self.options)


def write_files(files: DataFrame, folder: str) -> None:
    """Rows (name, content) as files below a folder: all of them or, where the tasks fail, none (a move that fails in the commit leaves those before it). A null content is an empty file; a file of the same name is
    replaced; names that repeat, or lead out of the folder, are an error. No rows make an empty folder."""
    spark = files.sparkSession
    ship(spark)
    spark.dataSource.register(FileRows)
    files.select("name", "content").write.format("file_rows").mode("append").option("path", qualified(spark, folder)).save()
