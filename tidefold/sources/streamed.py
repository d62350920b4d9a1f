"""Parquet files as a streamed dataset: rows in the order of files and of rows within them, read only until a budget is met."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import qualified
from ..operators.corpus import running_offsets


def list_files(spark: SparkSession, folder: str, suffix: str = ".parquet") -> list[str]:
    """The files of one folder in the order of their names, from a listing only; hidden ones are left out. A path that is a file is a list of itself."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = [s.getPath() for s in path.getFileSystem(conf).listStatus(path) if s.isFile()]
    return sorted(p.toString() for p in found if p.getName().endswith(suffix) and p.getName()[0] not in "._")


def _key(spark: SparkSession, path: str) -> str:
    """A path as the reader's file metadata has it."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(qualified(spark, path)).toUri().toString()


def take_until(spark: SparkSession, paths: Sequence[str], size: Column, budget: int, columns: Sequence[str], where: Column | None = None, first: int = 1) -> DataFrame:
    """columns, n_kept of the rows, file after file as ``paths`` are ordered, until their sizes reach the budget; the last row is cut to fit.

    Sizes are summed by file, ``first`` files at a time and then twice as many each time: at most about twice the files that hold the budget are read, whatever
    the number of paths, and one number a file comes to the driver. The files before the last are kept whole; only the last one's rows are summed in order.
    A null size counts as 0; rows that ``where`` does not keep do not count. Too small a dataset gives all its rows, no paths or a budget of 0 none."""

    def read(some: Sequence[str]) -> DataFrame:
        rows = spark.read.schema(schema).parquet(*some)
        return rows if where is None else rows.where(where)

    if not paths:
        raise ValueError("no files, so no columns")
    schema = spark.read.parquet(paths[0]).schema
    n = F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0))
    whole: list[str] = []
    last, before, at = None, 0, 0
    while at < len(paths) and last is None and before < budget:
        some = list(paths[at : at + first])
        sums = {r["f"]: r["n"] for r in read(some).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.sum(n).alias("n")).collect()}  # one row a file
        places = {p: _key(spark, p) for p in some}
        if sums.keys() - set(places.values()):
            raise ValueError("paths must be files")
        for p in some:
            held = sums.get(places[p], 0)
            if before + held >= budget:
                last = p
                break
            whole.append(p)
            before += held
        at, first = at + len(some), 2 * first
    if last is None and not whole:
        return read(paths[:1]).select(*columns, n.alias("n_kept")).where("false")
    kept = [read(whole).select(*columns, n.alias("n_kept"))] if whole else []
    if last is not None:
        rows = read([last]).select(*columns, n.alias("__n"), F.col("_metadata.row_index").alias("__row"))
        cut = running_offsets(rows, "__row", "__n", "__start").where(F.col("__start") < budget - before)
        kept.append(cut.select(*columns, F.least("__n", F.lit(budget - before) - F.col("__start")).alias("n_kept")))
    return kept[0] if len(kept) == 1 else kept[0].unionByName(kept[1])
