"""Queries that write the driver's tables in the formats of the sources, and read them back through their decoders.

Fixture files go below the shared folder, and are removed when the process ends."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalar, scratch
from ..operators import corpus, frames
from ..sources import binary, datasets, event_ranges, indexed, text
from ..sources.tables import EVENTS_SQL, events, table
from .registry import query


def _folder(spark) -> str:
    return scratch.folder(spark, "fixtures")


#: Times are the event's place within its sample: the 23 bits of the narrowest format hold eight million.
_SQL = f"WITH {EVENTS_SQL} SELECT sample, (i - 1)::BIGINT AS event_id, i::BIGINT AS t, {{x}}::INT AS x, {{y}}::INT AS y, {{p}}::INT AS p FROM ev"


def _numbered(spark, d):
    i = F.row_number().over(Window.partitionBy("sample").orderBy("t", "event_id"))
    return events(spark, d).withColumn("i", i).select("sample", "event_id", "x", "y", "p", F.col("i").cast("bigint").alias("t"))


def _round_trip(spark, d, kind: str, ending: str):
    folder = _folder(spark)
    named = _numbered(spark, d).withColumn("name", F.concat(F.lit("s"), F.col("sample"), F.lit(ending)))
    binary.write_files(binary.encode_events(named, "name", kind), folder)
    out = binary.read_events(spark, folder, kind, f"*{ending}")
    return out.select(F.regexp_extract("path", r"s(\d+)\.[a-z0-9]+$", 1).cast("bigint").alias("sample"), "event_id", "t", "x", "y", "p")


@query(_SQL.format(x="x", y="y", p="p"))
def source_aedat3(spark, d):
    return _round_trip(spark, d, "aedat3", ".aedat")


@query(_SQL.format(x="x", y="y", p="p"))
def source_atis40(spark, d):
    return _round_trip(spark, d, "atis40", ".bin")


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, * FROM ({_SQL.format(**c)})" for k, c in (("aedat2", {"x": "127 - y", "y": "127 - x", "p": "1 - p"}), ("aedat3", {"x": "x", "y": "y", "p": "p"}), ("atis40", {"x": "x", "y": "y", "p": "p"}))))
def source_ranges(spark, d):
    """Three formats read in byte ranges much smaller than the files."""
    named = _numbered(spark, d).withColumn("name", F.concat(F.lit("s"), F.col("sample"), F.lit(".ev")))
    out = []
    for kind in ("aedat2", "aedat3", "atis40"):
        folder = _folder(spark)
        binary.write_files(binary.encode_events(named, "name", kind), folder)
        sample = F.regexp_extract("path", r"s(\d+)\.[a-z0-9]+$", 1).cast("bigint").alias("sample")
        out.append(event_ranges.read_ranges(spark, folder, kind, "*.ev", 250).select(F.lit(kind).alias("kind"), sample, "event_id", "t", "x", "y", "p"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(_SQL.format(x="x", y="y", p="p"))
def source_matlab(spark, d):
    return _round_trip(spark, d, "mat", ".mat")


@query(_SQL.format(x="127 - y", y="127 - x", p="1 - p"))
def source_aedat2(spark, d):
    return _round_trip(spark, d, "aedat2", ".aedat")


@query(_SQL.format(x="x", y="y", p="p").replace("i::BIGINT AS t", "(i - 1)::BIGINT AS t"))
def source_atis_td(spark, d):
    return _round_trip(spark, d, "atis_td", ".dat")


@query(_SQL.format(x="x", y="y", p="p"))
def source_pos_neg_npz(spark, d):
    return _round_trip(spark, d, "pos_neg_npz", ".npz")


@query(_SQL.format(x="x", y="y", p="p"))
def source_event_npz(spark, d):
    return _round_trip(spark, d, "npz", ".npz")


_FRAMES = "SELECT sample, ((i - 1) % 3)::INT AS frame, p AS channel, y, x, count(*)::DOUBLE AS n FROM ev GROUP BY ALL"


@query(f"WITH {EVENTS_SQL} {_FRAMES}")
def source_frames_npz(spark, d):
    import numpy as np
    import pyarrow as pa

    def run(key, group):
        f = np.zeros((3, 2, 8, 5), np.int64)
        np.add.at(f, tuple(group.column(c).to_numpy() for c in ("frame", "p", "y", "x")), 1)
        return pa.table({"name": [f"s{key[0].as_py()}.npz"], "content": pa.array([binary.npz_bytes(frames=f)], pa.binary())})

    folder = _folder(spark)
    framed = _numbered(spark, d).withColumn("frame", F.expr("(t - 1) % 3").cast("int"))
    binary.write_files(framed.select("sample", "frame", "p", "y", "x").groupBy("sample").applyInArrow(run, "name string, content binary"), folder)
    out = binary.read_frames(spark, folder)
    return out.select(F.regexp_extract("path", r"s(\d+)\.npz$", 1).cast("bigint").alias("sample"), "frame", "channel", "y", "x", "n")


@query(f"WITH {EVENTS_SQL}, s AS (SELECT *, count(*) OVER (PARTITION BY sample) AS total FROM ev) SELECT sample, ('c' || sample % 3) AS label, (CASE WHEN total < 4 THEN 3 ELSE least((i - 1) // greatest(total // 4, 1), 3) END)::INT AS frame, p AS channel, y, x, count(*) AS n FROM s GROUP BY ALL")
def dataset_frames(spark, d):
    """A directory of samples by class, to frames by equal counts, to partitioned parquet."""
    folder = _folder(spark)
    named = _numbered(spark, d).withColumn("name", F.concat(F.lit("c"), F.col("sample") % 3, F.lit("/s"), F.col("sample"), F.lit(".bin")))
    binary.write_files(binary.encode_events(named, "name", "atis40"), f"{folder}/raw")
    out = spark.read.parquet(datasets.build(spark, "n_mnist", f"{folder}/raw", folder, "count", 4))
    return out.select(F.regexp_extract("sample", r"s(\d+)\.bin$", 1).cast("bigint").alias("sample"), F.col("label").cast("string").alias("label"), "frame", "channel", "y", "x", "n")


@query(f"WITH {EVENTS_SQL}, s AS (SELECT *, 4 - x AS mirrored FROM ev) SELECT sample, (sample % 3)::INT AS target, mirrored::INT AS x, count(*) AS n FROM s WHERE i > 1 GROUP BY ALL")
def dataset_hooks(spark, d):
    """Per-sample hooks: the first event of a sample is dropped and columns are mirrored; classes become numbers."""
    folder = _folder(spark)
    named = _numbered(spark, d).withColumn("name", F.concat(F.lit("c"), F.col("sample") % 3, F.lit("/s"), F.col("sample"), F.lit(".bin")))
    binary.write_files(binary.encode_events(named, "name", "atis40"), folder)
    mirror = lambda e: e.where("event_id > 0").withColumn("x", 4 - F.col("x"))
    out = datasets.load(spark, "n_mnist", folder, mirror, lambda c: F.substring(c, 2, 9).cast("int"))
    return out.groupBy(F.regexp_extract("sample", r"s(\d+)\.bin$", 1).cast("bigint").alias("sample"), F.col("label").alias("target"), "x").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS number, c_mktsegment AS label, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) <= ceil(0.7 * count(*) OVER (PARTITION BY c_mktsegment)) THEN 'train' ELSE 'test' END AS split FROM customer")
def dataset_split(spark, d):
    samples = table(spark, d, "customer").select(F.col("c_custkey").alias("number"), F.col("c_mktsegment").alias("label"))
    return datasets.split_samples(samples, 0.7).select("number", "label", "split")


_TOKENS = "SELECT doc_id, [doc_id % 65536, n_chars % 65536, length(lang)]::BIGINT[] AS tokens, source FROM documents"


def _tokens(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", F.array(F.col("doc_id") % 65536, F.col("n_chars") % 65536, F.char_length("lang").cast("bigint")).alias("tokens"))


@query(f"SELECT pos, token::INT AS token FROM (SELECT (row_number() OVER (ORDER BY doc_id, k) - 1)::BIGINT AS pos, tokens[k] AS token FROM ({_TOKENS}), unnest(range(1, 4)) AS u(k)) WHERE pos < 1000")
def source_token_npy(spark, d):
    """Token streams of capped files: 1,000 tokens, 256 to a file. The cap is the sink's feature."""
    folder = _folder(spark)
    binary.write_npy(corpus.capped_stream(_tokens(spark, d), "doc_id", "tokens", 1000), folder, 256)
    out = binary.read_npy(spark, folder)
    return out.select((F.regexp_extract("path", r"(\d+)\.npy$", 1).cast("bigint") * 256 + F.col("pos")).alias("pos"), "token")


_ITEMS = f"SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::BIGINT AS item, tokens, tokens[2:3] AS part FROM ({_TOKENS})"


def _stem(path: str = "path"):
    return F.regexp_extract(path, r"([^/]+)$", 1).alias("source")


@query(_ITEMS)
def source_indexed(spark, d):
    """A corpus for each source, in parts of 64 tokens, read in ranges of 50 bytes: small, so that small tables have many of both."""
    folder = _folder(spark)
    indexed.write_indexed(_tokens(spark, d), folder, "source", "doc_id", part_tokens=64, hot_rows=1)
    out = indexed.read_indexed(spark, folder, 50)
    return out.select(_stem(), "item", "tokens", binary.item_slice("tokens", 1, 2).alias("part"))


@query(f"SELECT source, item, part FROM ({_ITEMS}) WHERE item % 3 = 0")
def source_indexed_slices(spark, d):
    """Two tokens of every third item, by their byte ranges."""
    folder = _folder(spark)
    indexed.write_indexed(_tokens(spark, d), folder, "source", "doc_id", part_tokens=64)
    wanted = table(spark, d, "documents").groupBy("source").count()
    wanted = wanted.select(F.concat(F.lit(scratch.qualified(spark, folder) + "/"), "source").alias("path"), F.explode(F.sequence(F.lit(0), F.col("count") + 2, F.lit(3))).alias("item"))
    out = indexed.read_slices(spark, folder, wanted, 1, 2)
    return out.select(_stem(), "item", F.col("tokens").alias("part"))


@query("SELECT md5(text) AS digest, length(text)::INT AS n FROM documents")
def source_text(spark, d):
    return text.text_files(spark, [f"{d}/documents.parquet"]).select(F.md5("text").alias("digest"), F.char_length("text").alias("n"))


@query("SELECT (c_nationkey + 1)::BIGINT AS label, c_custkey AS t_start, c_custkey * 2 + 5 AS t_end FROM customer")
def source_intervals(spark, d):
    folder = _folder(spark)
    rows = table(spark, d, "customer").select((F.col("c_nationkey") + 1).alias("label"), F.col("c_custkey").alias("t_start"), (F.col("c_custkey") * 2 + 5).alias("t_end"))
    rows.write.csv(folder, header=True)
    return text.read_intervals(spark, folder)


@query("SELECT n_name || '/' || n_nationkey || '.wav' AS path FROM nation")
def source_file_list(spark, d):
    folder = _folder(spark)
    names = table(spark, d, "nation").select(F.explode(F.array(F.concat("n_name", F.lit("/"), "n_nationkey", F.lit(".wav ")), F.lit(""), F.lit("  "))).alias("value"))
    names.write.text(folder)
    return text.read_list(spark, folder)


@query(
    f"""WITH s AS (SELECT s_suppkey::INT AS layer, s_acctbal::DOUBLE AS b FROM supplier), n AS (SELECT layer, unnest(['lif1', 'lif2']) AS node, unnest([b, b / 2]) AS mean FROM s)
SELECT layer, node, round(mean, 4) AS mean, 0.5::DOUBLE AS std, 2.0::DOUBLE AS tau, 1.0::DOUBLE AS threshold FROM n"""
)
def source_metric_document(spark, d):
    """Metric documents whose layers are keys of an object."""
    folder = _folder(spark)
    node = lambda m: F.struct(m.alias("mean"), F.lit(0.5).alias("std"), F.lit(2.0).alias("tau"), F.lit(1.0).alias("threshold"))
    b = F.col("s_acctbal").cast("double")
    layer = F.struct(F.col("s_suppkey").cast("string").alias("k"), F.struct(node(b).alias("lif1"), node(b / 2).alias("lif2")).alias("v"))
    doc = table(spark, d, "supplier").agg(F.map_from_entries(F.collect_list(layer)).alias("layers")).select(F.lit("c").alias("checkpoint"), "layers")
    text.write_json(doc, folder)
    rows = text.layer_rows(text.read_stats(spark, folder))
    return rows.select("layer", "node", F.round("mean", 4).alias("mean"), "std", "tau", "threshold")


@query("SELECT symbol, (dense_rank() OVER (ORDER BY symbol) - 1)::BIGINT AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS symbol FROM documents)")
def vocabulary_file(spark, d):
    folder = _folder(spark)
    text.write_vocabulary(corpus.char_vocabulary(table(spark, d, "documents").select("text")), folder)
    return text.read_vocabulary(spark, folder)


@query(
    """WITH r AS (SELECT r_name, count(*) AS n, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name),
h AS (SELECT * FROM (VALUES (1, '# Nations'), (2, ''), (3, '| region | nations | names |'), (4, '|-|-|-|')) AS t(line_no, line))
SELECT line_no::INT AS line_no, line FROM h UNION ALL SELECT (4 + row_number() OVER (ORDER BY r_name))::INT, '| ' || r_name || ' | ' || n || ' | ' || names || ' |' FROM r"""
)
def markdown_report(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = both.groupBy(F.col("r_name").alias("region")).agg(F.count("*").cast("string").alias("nations"), F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("names"))
    return text.markdown(rows, "Nations", ["region"])


@query(
    """WITH u AS (SELECT conv_id, turn, [length(t) FOR t IN string_split(text, ' ')] AS ids FROM conversations), b AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS longest FROM u)
SELECT conv_id, turn, list_concat(ids, list_transform(range(longest - len(ids)), lambda k: 0))::INT[] AS ids, list_transform(range(longest), lambda k: CASE WHEN k < len(ids) THEN 1 ELSE 0 END)::INT[] AS mask FROM b"""
)
def padded_batches(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.transform(F.split("text", " ", -1), lambda w: F.char_length(w)).alias("ids"))
    return corpus.pad_in_batches(rows, "ids", F.col("conv_id")).select("conv_id", "turn", "ids", "mask")


@query("SELECT vec_id, list_transform(embedding[(vec_id % 49 + 1):(vec_id % 49 + 16)]::DOUBLE[], lambda x: round(x, 6)) AS crop FROM embeddings")
def silence_crop(spark, d):
    crop = text.cut_silence(F.col("embedding").cast("array<double>"), 16, (F.col("vec_id") % 49 + 0.5) / F.lit(49.0))
    return table(spark, d, "embeddings").select("vec_id", F.transform(crop, lambda x: scalar.rounded(x, 6)).alias("crop"))


_PATHS = "SELECT doc_id, CASE WHEN doc_id % 50 = 3 THEN '_background_noise_' ELSE lang END || '/' || source || '_nohash_' || doc_id || '.wav' AS path FROM documents"


@query(
    f"""WITH p AS ({_PATHS}), l AS (SELECT path, string_split(path, '/')[1] AS label, regexp_extract(string_split(path, '/')[2], '^(.*?)_nohash_', 1) AS speaker, doc_id::INT AS utterance,
  CASE WHEN doc_id % 10 = 1 THEN 'test' WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM p WHERE path NOT LIKE '_background_noise_/%'
  UNION ALL SELECT NULL, '_silence_', NULL, NULL, 'train' FROM range(20)),
w AS (SELECT label, (1.0 / count(*)) / sum(1.0 / count(*)) OVER () AS weight FROM l WHERE split = 'train' GROUP BY label)
SELECT l.path, l.label, l.speaker, coalesce(l.utterance, -1)::INT AS utterance, l.split, CASE WHEN l.split = 'train' THEN round(w.weight, 12) END AS weight FROM l LEFT JOIN w USING (label)"""
)
def dataset_speech(spark, d):
    """Recordings split by lists that are files, with class weights and crops of noise."""
    folder = _folder(spark)
    folders = F.when(F.col("doc_id") % 50 == 3, F.lit("_background_noise_")).otherwise(F.col("lang"))
    paths = table(spark, d, "documents").select("doc_id", F.concat(folders, F.lit("/"), "source", F.lit("_nohash_"), "doc_id", F.lit(".wav")).alias("path"))
    lists = {"validation": "doc_id % 10 = 0", "testing": "doc_id % 10 = 1"}
    for name, chosen in lists.items():
        paths.where(chosen).select("path").write.text(f"{folder}/{name}_list")
    valid, test = (text.read_list(spark, f"{folder}/{name}_list") for name in lists)
    out = datasets.speech(paths, valid, test, silence=20)
    return out.withColumn("utterance", F.coalesce("utterance", F.lit(-1))).withColumn("weight", F.round("weight", 12))  # crops have no number


_LOG = """WITH m AS (SELECT date_diff('month', DATE '1970-01-01', o_orderdate::DATE)::INT AS epoch, CASE o_orderstatus WHEN 'F' THEN 'train' ELSE 'valid' END AS split, count(*) AS n FROM orders GROUP BY 1, 2)"""


@query(f"{_LOG} SELECT epoch, split, (n / 8)::DOUBLE AS loss, n::DOUBLE AS ppl, 0.0005::DOUBLE AS lr, '2026-01-01 00:00:00' AS at FROM m")
def log_append(spark, d):
    """A training log to which two runs append, read back."""
    folder = _folder(spark)
    month = ((F.year("o_orderdate") - 1970) * 12 + F.month("o_orderdate") - 1).cast("int")
    split = F.when(F.col("o_orderstatus") == "F", "train").otherwise("valid")
    log = table(spark, d, "orders").groupBy(month.alias("epoch"), split.alias("split")).agg(F.count("*").alias("n"))
    log = log.select("epoch", "split", (F.col("n") / 8).alias("loss"), F.col("n").cast("double").alias("ppl"), F.lit(0.0005).alias("lr"), F.lit("2026-01-01 00:00:00").alias("at"))
    for part in (0, 1):
        text.append_log(log.where(F.col("epoch") % 2 == part), folder)
    return text.parse_log(spark.read.text(folder))
