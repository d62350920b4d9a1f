"""Documents to packed training sequences, in five stages; each is one operator of the library's llm part.

Quality rules and language ID drop what they reject, and language ID writes the language it finds into lang. Near-dedup leaves
one document of each group, mixing repeats the documents of small groups, by source and language found, up to the limit, packing lays token pieces out in sequences. Extra columns of documents ride
along to the last stage. SQL cannot express the language model, the tokenizer or the packing; tests compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import langid, mixing, neardup, packing, quality_rules
from tidefold.llm.bpe import vocabulary
from tidefold.llm.runtime import discard, settled


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # copies of one text are one witness: near-dedup, not this stage, removes them and leaves one
    return quality_rules.keep(docs, witness="texts")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # what follows mixes by the language of the text, whatever it was labelled
    return langid.keep_known(docs, rename=True)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a source's texts of one language are a group of their own; nulls are names like others
    grouped = docs.withColumn("__group", F.to_json(F.struct("source", "lang")))
    return mixing.mixed(grouped, vocabulary(), source_col="__group").drop("__group")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        read, docs = docs, settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        discard(read)  # of documents itself, nothing was stored
    return STAGES[-1][1](spark, docs, sf_dir)
