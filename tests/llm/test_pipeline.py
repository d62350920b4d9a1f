"""The pipeline's stages on a small corpus, and the registered queries on the smallest tables."""

import os

import pytest

import corpus_pipeline
from tidefold.llm import langid, neardup, quality_rules
from tidefold.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == columns
        seen[name] = (before, docs)
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    before, after = seen["quality_rules"]
    assert ids(after) == {r["doc_id"] for r in quality_rules.judge(before, witness="texts").where("kept").collect()}
    before, after = seen["language_id"]
    assert ids(after) == {r["doc_id"] for r in langid.identify(before).collect() if r["lang_pred"] != "und"}
    before, after = seen["near_duplicates"]
    assert ids(after) == {r["doc_id"] for r in neardup.near_duplicates(before).where("kept").collect()} and after.count() == len(ids(after))
    before, after = seen["mixing"]
    assert ids(after) == ids(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert ids(packed) == ids(docs) and packed.where("offset + length > 2048").count() == 0


def test_the_language_found_changes_what_follows(spark):
    """English texts without a label, or with a wrong one, are mixed with those of their language, not as they were labelled."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 200 and lang in ('en', 'de')")
    rows = docs.withColumn("lang", F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.col("lang"))).cache()
    found = corpus_pipeline.language_stage(spark, rows, SF).cache()
    pred = {r["doc_id"]: r["lang_pred"] for r in langid.identify(rows).collect()}
    assert {r["doc_id"]: r["lang"] for r in found.collect()} == pred and found.columns == rows.columns
    uses = lambda df: {r["doc_id"]: r["count"] for r in corpus_pipeline.mixing_stage(spark, df, SF).groupBy("doc_id").count().collect()}
    assert uses(found) != uses(rows) and set(uses(found)) == set(pred)


def test_pipeline_runs_without_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_rows_with_odd_ids(spark):
    """Rows with null or repeated ids and unlike texts pass the first three stages as rows with ids of their own do."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 1, F.lit(7)).otherwise(F.col("doc_id")).cast("long")).withColumn("row", F.lit(1))
    texts = []
    for frame in (docs, odd):
        out = quality_rules.keep(frame)
        near = neardup.keep_one(out)
        assert near.columns == frame.columns
        texts.append((sorted(r["text"] for r in out.collect()), sorted(tuple(sorted(neardup.shingle_set(r["text"]))) for r in near.collect())))
    assert texts[0][0] == texts[1][0] and len(texts[0][1]) == len(texts[1][1])


def test_operators_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        got = sorted(map(tuple, QUERIES[name](spark, SF).collect()))
        want = sorted(con.execute(sql).fetchall())
        assert got == want, name
