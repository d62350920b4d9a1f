"""Text inputs and outputs: training logs, metric documents, interval tables, file lists, paths, audio arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODE = "struct<mean:double,std:double,tau:double,threshold:double>"
STATS_SCHEMA = f"checkpoint string, n_batches int, batch_size int, ctx_len int, overall_mean_firing_rate double, layers map<string,struct<lif1:{NODE},lif2:{NODE}>>"


def text_files(spark: SparkSession, paths: list[str], first: int | None = None) -> DataFrame:
    """The text column of parquet files in path order, of the first few files if asked."""
    return spark.read.parquet(*sorted(paths)[:first]).select("text")


def parse_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """epoch, split, loss, ppl, lr, at of a training log; lines with under four fields or an unreadable number are left out."""
    f = F.split(F.trim(F.col(value)), r"\s+")
    out = lines.where(F.size(f) >= 4).select(
        *[c for c in lines.columns if c != value],
        F.get(f, F.lit(0)).try_cast("int").alias("epoch"), F.get(f, F.lit(1)).alias("split"), F.get(f, F.lit(2)).try_cast("double").alias("loss"),
        F.get(f, F.lit(3)).try_cast("double").alias("ppl"), F.get(f, F.lit(4)).try_cast("double").alias("lr"), F.concat_ws(" ", F.get(f, F.lit(5)), F.get(f, F.lit(6))).alias("at"),
    )
    return out.where("epoch is not null and ppl is not null")


def log_line() -> Column:
    """One line of a log from its columns."""
    return F.format_string("%d %s %.6f %.4f %.8f %s", "epoch", "split", "loss", "ppl", "lr", "at")


def append_log(log: DataFrame, path: str) -> None:
    log.select(log_line().alias("value")).write.mode("append").text(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATS_SCHEMA).json(path, multiLine=True)


def layer_rows(stats: DataFrame) -> DataFrame:
    """layer (its key as a number), node, mean, std, tau, threshold: the map of layers in long form."""
    layers = stats.select(F.explode("layers").alias("k", "v")).select(F.col("k").cast("int").alias("layer"), F.explode(F.map_from_arrays(F.array(F.lit("lif1"), F.lit("lif2")), F.array("v.lif1", "v.lif2"))).alias("node", "s"))
    return layers.select("layer", "node", "s.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """A JSON document {"id": "symbol", ..} of a vocabulary(symbol, id): one row, bounded by the number of code points."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("id").cast("string"), "symbol"))))
    vocabulary.agg(F.to_json(entries).alias("value")).write.mode("overwrite").text(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "symbol")).select("symbol", F.col("id").cast("bigint").alias("id"))


def markdown(df: DataFrame, title: str, order: list[str]) -> DataFrame:
    """(line_no, line): a Markdown report of a table in ``order`` (distinct). Numbers must be strings by then; nulls are empty cells.

    The order is a window without a partition: a report is a small table."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |"))
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    lines = df.select((F.row_number().over(Window.orderBy(*order)) + len(head)).cast("int").alias("line_no"), row.alias("line"))
    return df.sparkSession.createDataFrame(list(enumerate(head, 1)), "line_no int, line string").unionByName(lines)


def write_markdown(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


def write_frames(df: DataFrame, path: str, by: tuple[str, ...] = ("split", "label"), codec: str = "zstd") -> None:
    """Partitioned parquet in place of a directory tree of archives."""
    df.write.mode("overwrite").partitionBy(*by).option("compression", codec).parquet(path)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="label bigint, t_start bigint, t_end bigint")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One relative path a line; blank lines are left out."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").alias("path"))


def parse_speech_path(path: Column) -> Column:
    """struct(label, speaker, utterance) of label/speaker_nohash_n.wav."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.struct(
        F.element_at(F.split(path, "/"), -2).alias("label"),
        F.regexp_extract(name, r"^(.*?)_nohash_", 1).alias("speaker"),
        F.regexp_extract(name, r"_nohash_(\d+)", 1).try_cast("int").alias("utterance"),
    )


def label_of(path: Column) -> Column:
    """The class is the name of the folder."""
    return F.element_at(F.split(path, "/"), -2)


def cut_silence(wave: Column, length: int, start: Column) -> Column:
    """A crop of ``length`` samples of a longer recording, from a place drawn as ``start`` in [0, 1)."""
    at = F.floor(start * (F.size(wave) - length + 1)).cast("int") + 1
    return F.when(F.size(wave) > length, F.slice(wave, at, length)).otherwise(wave)


def peak_normalise(wave: Column) -> Column:
    """Divided by the largest absolute value; silence stays as it is."""
    peak = F.array_max(F.transform(wave, lambda x: F.abs(x)))
    return F.element_at(F.transform(F.array(peak), lambda m: F.transform(wave, lambda x: F.when(m > 0, x / m).otherwise(x))), 1)
