"""Files that come by a commit or not at all, and indexed corpora in parts, against plain Python."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.sources import binary, indexed, sinks


def _tree(folder):
    return {os.path.relpath(os.path.join(at, n), folder): open(os.path.join(at, n), "rb").read() for at, _, names in os.walk(folder) for n in names if not n.endswith(".crc")}


def test_files_are_committed(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.bin", b"1"), ("c.bin", b""), ("d.bin", None)], "name string, content binary")
    sinks.write_files(rows.repartition(3), str(tmp_path / "o"))
    assert _tree(tmp_path / "o") == {"a/b.bin": b"1", "c.bin": b"", "d.bin": b""}
    sinks.write_files(spark.createDataFrame([("c.bin", b"new", 1)], "name string, content binary, extra int"), f"file://{tmp_path}/o")
    assert _tree(tmp_path / "o")["c.bin"] == b"new" and len(_tree(tmp_path / "o")) == 3
    sinks.write_files(rows.where("false"), str(tmp_path / "none"))
    assert _tree(tmp_path / "none") == {}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "o")
    sinks.write_files(spark.createDataFrame([("old", b"0")], "name string, content binary"), folder)
    many = spark.range(0, 40, 1, 4)
    broken = F.when(F.col("id") == 39, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.concat(F.lit("f"), "id"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_files(many.select(broken.alias("name"), F.lit(b"x").alias("content")), folder)
    with pytest.raises(Exception, match="same name"):
        sinks.write_files(many.select(F.concat(F.lit("f"), F.col("id") % 7).alias("name"), F.lit(b"x").alias("content")), folder)
    for bad in ("../out", "/out", ""):
        with pytest.raises(Exception, match="not a name"):
            sinks.write_files(spark.createDataFrame([(bad, b"x")], "name string, content binary"), folder)
    assert _tree(folder) == {"old": b"0"} and os.listdir(folder) == ["old"]


def test_attempts_that_do_not_count(spark, tmp_path):
    """An attempt whose message never comes to the commit leaves no file."""
    import pyarrow as pa

    writer = sinks._Writer({"path": str(tmp_path)})
    batch = lambda n: pa.RecordBatch.from_pydict({"name": [n], "content": pa.array([n.encode()], pa.binary())})
    writer.write(iter([batch("lost"), batch("a")]))
    kept = writer.write(iter([batch("a")]))
    writer.commit([kept, None])
    assert _tree(tmp_path) == {"a": b"a"} and os.listdir(tmp_path) == ["a"]


def test_a_task_that_outlives_its_job_leaves_nothing(spark, tmp_path):
    import pyarrow as pa

    writer = sinks._Writer({"path": str(tmp_path)})

    def batches():
        for n in "abc":
            yield pa.RecordBatch.from_pydict({"name": [n], "content": pa.array([b"x"], pa.binary())})
            if n == "a":
                writer.abort([])

    with pytest.raises(RuntimeError, match="has ended"):
        writer.write(batches())
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("hot_rows", [1, 1000])
@pytest.mark.parametrize("code", [4, 8])
def test_corpora_in_parts(spark, tmp_path, hot_rows, code):
    rng = np.random.default_rng(2)
    sizes = [int(rng.integers(0, 9)) for _ in range(90)]
    sizes[5], sizes[40] = 100, 0
    items = [(k, "one" if k % 3 else "x.part7", rng.integers(0, 65536, n).tolist()) for k, n in enumerate(sizes)] + [(500, "one", None)]
    df = spark.createDataFrame(items, "item bigint, stem string, tokens array<int>").withColumn("upto", F.lit(0)).drop("upto")
    folder = str(tmp_path / "o")
    indexed.write_indexed(df, folder, code=code, part_tokens=32, hot_rows=hot_rows)
    names = sorted(_tree(folder))
    assert len(names) > 12 and sum(n.endswith(".idx") for n in names) == len(names) / 2
    want = {}
    for _, stem, tokens in items:
        want.setdefault(stem, []).append(tokens or [])
    # each part is a corpus by itself
    for n in names:
        if n.endswith(".idx"):
            kind, s, p, borders = binary.index_items((tmp_path / "o" / n).read_bytes())
            assert s.sum() * np.dtype(kind).itemsize == (tmp_path / "o" / n.replace(".idx", ".bin")).stat().st_size and len(borders) == len(s) + 1
    for run in (1, 20, 1 << 20):
        got = {(r["path"].rsplit("/", 1)[1], r["item"]): r["tokens"] for r in indexed.read_indexed(spark, folder, run).collect()}
        assert got == {(s, k): t for s, rows in want.items() for k, t in enumerate(rows)}
    stem = indexed.qualified(spark, folder) + "/"
    asked = spark.createDataFrame([(f"{stem}one", k) for k in (0, 0, 3, 60, 9999, -1)] + [(f"{stem}x.part7", 1), (f"{stem}no", 0), (None, None)], "path string, item bigint")
    for offset, length in ((0, None), (2, 3), (200, 1), (1, 0)):
        rows = indexed.read_slices(spark, folder, asked, offset, length).collect()
        got = {(r["path"].rsplit("/", 1)[1], r["item"]): r["tokens"] for r in rows}
        end = None if length is None else offset + length
        assert len(rows) == len(got) and got == {(s, k): want[s][k][offset:end] for s, k in (("one", 0), ("one", 3), ("one", 60), ("x.part7", 1)) if k < len(want[s])}


def test_corpora_by_hand(spark, tmp_path):
    """Items that share tokens or leave gaps, as pointers may say; a file that ends early; empty corpora."""
    sizes, pointers = np.array([2, 2, 1], "<i4"), np.array([2, 4, 0], "<i8")
    head = binary.INDEX_MAGIC + (1).to_bytes(8, "little") + bytes([8]) + (3).to_bytes(8, "little") + (1).to_bytes(8, "little")
    (tmp_path / "h.idx").write_bytes(head + sizes.tobytes() + pointers.tobytes() + np.zeros(1, "<i8").tobytes())
    (tmp_path / "h.bin").write_bytes(np.arange(4, dtype="<u2").tobytes())
    (tmp_path / "e.idx").write_bytes(binary.index_bytes(np.zeros(0, int)))
    (tmp_path / "e.bin").write_bytes(b"")
    for run in (1, 100):
        assert [r["tokens"] for r in indexed.read_indexed(spark, str(tmp_path), run).orderBy("item").collect()] == [[1, 2], [2, 3], [0]]
    (tmp_path / "h.bin").write_bytes(b"\0\0")
    with pytest.raises(Exception, match="ends before"):
        indexed.read_indexed(spark, str(tmp_path)).collect()
    empty = spark.createDataFrame([], "item bigint, stem string, tokens array<int>")
    indexed.write_indexed(empty, str(tmp_path / "n"))
    assert os.listdir(tmp_path / "n") == [] and indexed.read_indexed(spark, str(tmp_path / "n")).count() == 0
    for tokens, stem in (([65536], "a"), ([-1], "a"), ([None], "a"), ([1], None)):
        with pytest.raises(Exception, match="does not hold|without a name"):
            indexed.write_indexed(spark.createDataFrame([(0, stem, tokens)], empty.schema), str(tmp_path / "bad"))
    assert _tree(tmp_path / "bad") == {}


def test_times_that_do_not_fit():
    e = {k: np.array([1 << 23 if k == "t" else 0]) for k in "txyp"}
    with pytest.raises(ValueError, match="23 bits"):
        binary.to_atis40(e)
