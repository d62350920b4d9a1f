"""Directory datasets of event files: one reader for all, by a table of formats, and frames by a chosen rule as partitioned parquet."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import stored
from ..operators import frames
from ..operators.metrics import class_weights
from ..operators.sampling import stratified
from .binary import read_events
from .text import label_of, parse_speech_path, write_frames


Hook = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Layout:
    """A dataset's decoder, file pattern and sensor size (height, width)."""

    kind: str
    pattern: str
    height: int
    width: int


#: Published sensor sizes and formats (fixed values).
LAYOUTS = {
    "asl_dvs": Layout("mat", "*.mat", 180, 240),
    "cifar10_dvs": Layout("aedat2", "*.aedat", 128, 128),
    "dvs128_gesture": Layout("aedat3", "*.aedat", 128, 128),
    "es_imagenet": Layout("pos_neg_npz", "*.npz", 256, 256),
    "n_caltech101": Layout("atis40", "*.bin", 180, 240),
    "n_mnist": Layout("atis40", "*.bin", 34, 34),
    "nav_gesture": Layout("atis_td", "*.dat", 240, 304),
}


def load(spark: SparkSession, name: str, root: str, transform: Hook | None = None, target_transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """sample (the file), event_id, t, x, y, p, label (the file's folder) of all files of a dataset below root.

    transform is applied to the events of all samples (a DataFrame function, keyed by sample), target_transform to the label."""
    layout = LAYOUTS[name]
    events = read_events(spark, root, layout.kind, layout.pattern).withColumnRenamed("path", "sample").withColumn("label", label_of(F.col("sample")))
    events = transform(events) if transform else events
    return events.withColumn("label", target_transform(F.col("label"))) if target_transform else events


def split_samples(samples: DataFrame, ratio: float, seed: int | None = None) -> DataFrame:
    """samples(sample, label, number) with split: train for the first part of each label by number, or in a hashed order with a seed; test for the rest."""
    cut = stratified(samples, ratio, "label", "number", seed)
    return cut.withColumn("split", F.when(F.col("is_train") == 1, "train").otherwise("test")).drop("is_train")


def to_frames(events: DataFrame, rule: str, value: int) -> DataFrame:
    """Sparse frames with labels: rule is count or time (value frames a sample) or duration (value in time units)."""
    framed = {"count": frames.equal_count, "time": frames.equal_time, "duration": frames.anchored}[rule](events, value)
    return frames.histogram(framed).join(events.select("sample", "label").distinct(), "sample")


def build(spark: SparkSession, name: str, root: str, out: str, rule: str, value: int, split: str = "all", transform: Hook | None = None, target_transform: Callable[[Column], Column] | None = None) -> str:
    """Writes the frames of a dataset once to a folder named by rule and value, partitioned by split and label; returns the folder."""
    to = f"{out.rstrip('/')}/{name}_{rule}_{value}"
    events = stored(load(spark, name, root, transform, target_transform), "events")  # files are opened and decoded once: framing reads the events several times
    write_frames(to_frames(events, rule, value).withColumn("split", F.lit(split)), to)
    return to


#: The folder of noise recordings, which are no utterances, and the label of crops made from them.
NOISE, SILENCE = "_background_noise_", "_silence_"


def speech(files: DataFrame, valid: DataFrame, test: DataFrame, silence: int = 0) -> DataFrame:
    """path, label, speaker, utterance, split, weight of a directory of recordings label/speaker_nohash_n.wav, by its lists of validation and test paths.

    files, valid, test have a column path, below the root. A path on both lists is of the test part; what is on neither is for training, but for noise recordings and
    names without the divider. weight, for training rows, is the part of 1 that a row of its class gets when every class is drawn alike: 1 / rows of the class,
    divided by the sum of that over classes. ``silence`` adds so many training rows of a class of their own, to be cropped from noise."""
    name = parse_speech_path(F.col("path"))
    listed = lambda df, c: df.select(F.col("path").alias("of")).distinct().withColumn(c, F.lit(True))
    rows = files.select("path").distinct().where(F.col("path").contains("_nohash_") & ~F.col("path").contains(NOISE))
    for df, c in ((valid, "v"), (test, "t")):
        rows = rows.join(listed(df, c), F.col("path") == F.col("of"), "left").drop("of")
    split = F.when(F.col("t"), "test").when(F.col("v"), "val").otherwise("train")
    rows = rows.select("path", name["label"].alias("label"), name["speaker"].alias("speaker"), name["utterance"].alias("utterance"), split.alias("split"))
    if silence:
        crops = rows.sparkSession.range(silence).select(F.lit(None).cast("string").alias("path"), F.lit(SILENCE).alias("label"), F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("int").alias("utterance"), F.lit("train").alias("split"))
        rows = rows.unionByName(crops)
    weights = class_weights(rows.where("split = 'train'"), "label").select(F.col("label").alias("of"), "weight")
    return rows.join(weights, F.col("label") == F.col("of"), "left").select("path", "label", "speaker", "utterance", "split", F.when(F.col("split") == "train", F.col("weight")).alias("weight"))
