"""What the operators share: shipping this package to executors and shared scratch tables."""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_SCRATCH: list[tuple[SparkSession, str]] = []
_OWN_DIRS: dict[str, str] = {}

#: Rows and bytes in one Arrow batch; very long texts must not pile up in one Python worker.
ARROW_ROWS, ARROW_BYTES = "512", str(16 << 20)


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once for each application, and bound the Arrow batches.

    The bounds are settings of the session and stay: a lazy plan reads them only when it runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    if root.suffix != ".zip" and root.is_dir():
        files = sorted(p for p in root.rglob("*.py"))
        digest = hashlib.md5(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
        out = os.path.join(tempfile.mkdtemp(prefix="ship"), f"{root.name}_{digest}.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for p in files:
                z.write(p, str(Path(root.name) / p.relative_to(root)))
        spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, else (tests on one machine) an own temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="tidefold")
    return _OWN_DIRS[app]


def stored(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _SCRATCH.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what stored() wrote, when nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)
        _SCRATCH[:] = [x for x in _SCRATCH if x[1] != path]


def settled(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """make() stored; the scratch tables that it stored on the way are deleted, as nothing reads them any more."""
    before = {path for _, path in _SCRATCH}
    out = stored(spark, make(), tag)
    for path in [p for _, p in _SCRATCH if p not in before and p != out._stored_at]:
        _delete(spark, path)
        _SCRATCH[:] = [x for x in _SCRATCH if x[1] != path]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _SCRATCH:
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, path)
            except Exception:  # the JVM may be gone already
                return


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0


def spread(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
