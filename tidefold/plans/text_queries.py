"""Queries on texts: filters, vocabularies, token streams, budgets, windows, decoding rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scratch
from ..operators import corpus, sampling
from ..sources import streamed
from ..sources.tables import table
from ..sources.text import parse_speech_path
from .registry import query

L, BUDGET = 64, 20_000
WORDS = "WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, ws, len(ws) AS n, (sum(len(ws)) OVER (ORDER BY doc_id) - len(ws))::BIGINT AS start FROM w)"
STREAM = f"{WORDS}, st AS (SELECT start + k - 1 AS pos, length(ws[k]) AS token FROM (SELECT start, ws, unnest(range(1, n + 1)) AS k FROM s)), tot AS (SELECT count(*) AS n FROM st)"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _sized(spark, d):
    docs = _docs(spark, d).where("text is not null")
    return docs.select("doc_id", F.transform(F.split("text", " ", -1), lambda w: F.char_length(w)).alias("tokens"))


def _stream(spark, d):
    return corpus.flatten(_sized(spark, d), "doc_id", "tokens")


@query(r"SELECT doc_id, length(text)::INT AS n FROM documents WHERE regexp_matches(text, '\S')")
def text_not_blank(spark, d):
    return corpus.not_blank(_docs(spark, d)).select("doc_id", F.char_length("text").alias("n"))


@query("SELECT symbol, (dense_rank() OVER (ORDER BY symbol) - 1)::INT AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS symbol FROM documents)")
def char_vocabulary(spark, d):
    return corpus.char_vocabulary(_docs(spark, d))


@query(
    """WITH v AS (SELECT symbol, dense_rank() OVER (ORDER BY symbol) - 1 AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS symbol FROM documents WHERE lang = 'en')),
c AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS symbol FROM documents)
SELECT doc_id, count(*) AS n, sum(coalesce(id, 0))::BIGINT AS total, count(*) FILTER (WHERE id IS NULL) AS unknown FROM c LEFT JOIN v USING (symbol) GROUP BY doc_id"""
)
def char_encode(spark, d):
    docs = table(spark, d, "documents").where("text <> ''")
    coded = corpus.char_encode(docs.select("doc_id", "text"), corpus.char_vocabulary(docs.where("lang = 'en'")), -1)
    sums = F.aggregate("ids", F.lit(0).cast("bigint"), lambda s, x: s + F.greatest(x, F.lit(0)))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n"), sums.alias("total"), F.size(F.filter("ids", lambda x: x < 0)).cast("bigint").alias("unknown"))


@query(r"SELECT conv_id, turn, chr(10) || array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(12288) || chr(13))), lambda x: x <> ''), chr(10)) AS cleaned FROM conversations")
def context_cleanup(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", corpus.clean_context(F.col("text")).alias("cleaned"))


@query("SELECT conv_id, turn, trim(string_split(text, chr(10) || chr(10))[1], ' ' || chr(9) || chr(10) || chr(13)) AS cut FROM conversations")
def stop_rule(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", corpus.stop_at_blank(F.col("text")).alias("cut"))


@query(f"{WORDS} SELECT doc_id, start, n::BIGINT AS n FROM s")
def stream_offsets(spark, d):
    sized = _sized(spark, d).select("doc_id", F.size("tokens").cast("bigint").alias("n"))
    return corpus.running_offsets(sized, "doc_id", "n").select("doc_id", "start", "n")


@query(f"{STREAM} SELECT CASE WHEN pos < floor(0.99 * tot.n) THEN 'train' ELSE 'valid' END AS part, count(*) AS n, min(pos) AS first, sum(token)::BIGINT AS total FROM st, tot GROUP BY 1")
def split_positions(spark, d):
    sized = _sized(spark, d)
    total = sized.agg(F.sum(F.size("tokens"))).first()[0] or 0
    parts = corpus.split_position(corpus.flatten(sized, "doc_id", "tokens"), total)
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.sum("token").alias("total"))


@query(
    f"""{STREAM}, c AS (SELECT pos // {L} AS chunk, list(token ORDER BY pos) AS x FROM st GROUP BY 1), f AS (SELECT pos // {L} - 1 AS chunk, token FROM st WHERE pos % {L} = 0)
SELECT chunk, x, list_append(x[2:], token) AS y FROM c JOIN f USING (chunk) WHERE len(x) = {L}"""
)
def window_slices(spark, d):
    return corpus.windows(_stream(spark, d), L)


@query(f"{STREAM}, c AS (SELECT pos // {L} AS chunk, list(token ORDER BY pos) AS tokens FROM st GROUP BY 1) SELECT * FROM c WHERE len(tokens) = {L}")
def fixed_chunks(spark, d):
    return corpus.chunks(_stream(spark, d), L)


@query(f"{STREAM} SELECT i, floor({sampling.uniform_sql(5, 'i')} * (tot.n - {L} - 1))::BIGINT AS start FROM (SELECT unnest(range(1000)) AS i), tot")
def random_starts(spark, d):
    total = _sized(spark, d).agg(F.sum(F.size("tokens"))).first()[0] or 0
    return spark.range(1000).select(F.col("id").alias("i"), F.floor(sampling.uniform(5, F.col("id")) * F.lit(total - L - 1)).alias("start"))


@query(f"{WORDS} SELECT doc_id, least(n, {BUDGET} - start)::BIGINT AS n_kept FROM s WHERE start < {BUDGET}")
def take_budget(spark, d):
    sized = _sized(spark, d).select("doc_id", F.size("tokens").cast("bigint").alias("n"))
    return corpus.take_budget(sized, "doc_id", "n", BUDGET).select("doc_id", "n_kept")


@query(f"{WORDS} SELECT doc_id, least(n, {BUDGET} - start)::BIGINT AS n_kept FROM s WHERE start < {BUDGET}")
def take_budget_streamed(spark, d):
    """The same of a dataset of 24 files, of which only the first few are read."""
    folder = scratch.folder(spark, "fixtures")
    _docs(spark, d).repartitionByRange(24, "doc_id").sortWithinPartitions("doc_id").write.parquet(folder)
    words = F.size(F.split("text", " ", -1))
    return streamed.take_until(spark, streamed.list_files(spark, folder), words, BUDGET, ["doc_id"], F.col("text").isNotNull())


@query(
    """WITH a AS (SELECT doc_id, 0 AS part FROM documents UNION ALL SELECT item_id, 1 FROM benchmark) SELECT part, doc_id AS id, row_number() OVER (ORDER BY part, doc_id) - 1 AS pos FROM a"""
)
def concat_streams(spark, d):
    docs, bench = table(spark, d, "documents").select("doc_id"), table(spark, d, "benchmark").select("item_id")
    first = corpus.running_offsets(docs.withColumn("one", F.lit(1)), "doc_id", "one").select(F.lit(0).alias("part"), F.col("doc_id").alias("id"), F.col("start").alias("pos"))
    second = corpus.running_offsets(bench.withColumn("one", F.lit(1)), "item_id", "one").select(F.lit(1).alias("part"), F.col("item_id").alias("id"), (F.col("start") + docs.count()).alias("pos"))
    return first.unionByName(second)


@query(f"{WORDS} SELECT doc_id, CASE WHEN n <= 16 THEN list_transform(ws, lambda w: length(w)) ELSE list_transform(ws[n - 15:], lambda w: length(w)) END AS ids FROM s")
def last_context(spark, d):
    return _sized(spark, d).select("doc_id", corpus.last_tokens(F.col("tokens"), 16).alias("ids"))


@query(
    """WITH c AS (SELECT conv_id, list(length(text) ORDER BY turn) AS v FROM conversations GROUP BY conv_id), m AS (SELECT max(len(v)) AS longest FROM c)
SELECT conv_id, list_concat(v, list_transform(range(longest - len(v)), lambda k: 0)) AS padded, list_transform(range(longest), lambda t: (t < len(v))::INT) AS mask FROM c, m"""
)
def pad_and_mask(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.char_length("text").alias("n")))), lambda x: x["n"]).alias("v"))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.select("conv_id", corpus.pad(F.col("v"), F.lit(longest)).alias("padded"), corpus.length_mask(F.size("v"), F.lit(longest)).alias("mask"))


@query("SELECT doc_id, list_transform(range(2), lambda k: (k = quality)::INT) AS hot, list_transform(range(6), lambda k: (k // 3 = quality)::INT) AS slots FROM labels")
def one_hot_labels(spark, d):
    return table(spark, d, "labels").select("doc_id", corpus.one_hot(F.col("quality"), 2).alias("hot"), corpus.redundant_one_hot(F.col("quality"), 2, 3).alias("slots"))


@query("SELECT source AS label, count(*) AS n, (1.0 / count(*)) / sum(1.0 / count(*)) OVER () AS weight FROM documents GROUP BY source")
def class_weights(spark, d):
    from ..operators.metrics import class_weights as weights

    return weights(table(spark, d, "documents").select(F.col("source").alias("label")), "label")


@query(
    """WITH p AS (SELECT doc_id, lang || '/' || source || '_nohash_' || doc_id || '.wav' AS path FROM documents)
SELECT doc_id, string_split(path, '/')[1] AS label, regexp_extract(string_split(path, '/')[2], '^(.*?)_nohash_', 1) AS speaker, regexp_extract(path, '_nohash_([0-9]+)', 1)::INT AS utterance FROM p"""
)
def parse_paths(spark, d):
    path = F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("_nohash_"), F.col("doc_id"), F.lit(".wav"))
    return table(spark, d, "documents").select("doc_id", parse_speech_path(path).alias("s")).select("doc_id", "s.*")


@query()
def tokenize_eos(spark, d):
    import public_tokenizers

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    out = corpus.tokenize(corpus.not_blank(_docs(spark, d)), public_tokenizers.path("byte_bpe_50k.json"), 50256)
    return out.select("doc_id", "ids")


@query(r"SELECT doc_id, text AS decoded, 50256 AS last_id FROM documents WHERE regexp_matches(text, '\S')")
def tokens_decoded(spark, d):
    """Tokenized and decoded again: byte-pair tokens lose nothing, so the text must come back."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = tokenize_eos(spark, d)
    return corpus.detokenize(ids, path, 50256).select("doc_id", "decoded", F.element_at("ids", -1).alias("last_id"))


@query(
    """WITH a AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS token FROM conversations) SELECT conv_id, list_sort(list(DISTINCT token)) AS seen, count(DISTINCT token) AS n FROM a GROUP BY conv_id"""
)
def seen_tokens(spark, d):
    words = table(spark, d, "conversations").select("conv_id", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("token")).distinct()
    return words.groupBy("conv_id").agg(F.sort_array(F.collect_list("token")).alias("seen"), F.count("*").alias("n"))
