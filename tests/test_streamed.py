"""Streamed datasets against a plain loop, and how few files they read."""

import pytest
from pyspark.sql import functions as F

from tidefold.sources import streamed


def _files(spark, folder, rows):
    for k, own in enumerate(rows):
        spark.createDataFrame(own, "id bigint, n int").coalesce(1).write.parquet(f"{folder}/w{k}")
        (part,) = (folder / f"w{k}").glob("*.parquet")
        part.rename(folder / f"part {k:02d}%20.parquet")
    return streamed.list_files(spark, str(folder))


def test_until_the_budget(spark, tmp_path):
    # no order column: rows come as they lie in files
    rows = [[(10 * f + (7 * k) % 10, (f + k) % 4) for k in range(10)] for f in range(9)]
    rows[2], rows[3] = [], [(30, None), (31, -5), (32, 2)]
    paths = _files(spark, tmp_path, rows)
    assert len(paths) == 9
    flat = [r for own in rows for r in own]
    total = sum(max(0, n or 0) for _, n in flat)
    for first in (1, 3):
        for budget in (0, 1, 14, 15, 16, 33, 40, total - 1, total, total + 5):
            want, start = {}, 0
            for i, n in flat:
                n = max(0, n or 0)
                if start < budget:
                    want[i] = min(n, budget - start)
                start += n
            got = streamed.take_until(spark, paths, F.col("n"), budget, ["id"], first=first)
            assert {r["id"]: r["n_kept"] for r in got.collect()} == want, budget
    assert {r["id"] for r in streamed.take_until(spark, paths, F.lit(1), 4, ["id"], F.col("n") > 1).collect()} == {i for i, n in [r for r in flat if (r[1] or 0) > 1][:4]}
    with pytest.raises(ValueError):
        streamed.take_until(spark, [], F.lit(1), 1, ["id"])


def test_files_after_the_budget_are_not_read(spark, tmp_path):
    paths = _files(spark, tmp_path, [[(k, 10)] for k in range(12)])
    for p in paths[3:]:  # a file that cannot be read shows a read
        (tmp_path / p.rsplit("/", 1)[1]).write_bytes(b"broken")
    out = streamed.take_until(spark, paths, F.col("n"), 25, ["id"])
    assert [(r["id"], r["n_kept"]) for r in out.orderBy("id").collect()] == [(0, 10), (1, 10), (2, 5)] and len(out.inputFiles()) == 3
