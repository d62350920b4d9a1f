"""Queries for training and firing metrics, layer alignment and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..sources.tables import EVENTS_SQL, events, table
from ..sources.text import log_line, parse_log
from .registry import query

# a spike is an event at or over the threshold; user groups stand for layers, event types for nodes, days for batches
SPK = f"WITH {EVENTS_SQL}, sp AS (SELECT sample, x AS node, (sample % 12)::INT AS layer, t // 86400000000 AS batch, p AS spike FROM ev)"
RATES = f"{SPK}, rt AS (SELECT layer, node, batch, avg(spike) AS rate FROM sp GROUP BY ALL), nd AS (SELECT layer, node, avg(rate) AS mean, stddev_pop(rate) AS std FROM rt GROUP BY ALL)"


def _spikes(spark, d):
    return events(spark, d).select("sample", F.col("x").alias("node"), (F.col("sample") % 12).cast("int").alias("layer"), F.expr("t div 86400000000").alias("batch"), F.col("p").alias("spike"))


def _nodes(spark, d):
    return metrics.node_statistics(metrics.firing_by_batch(_spikes(spark, d), ["layer", "node", "batch"]), ["layer", "node"])


@query(f"{RATES} SELECT layer, node, batch, round(rate, 6) AS rate FROM rt")
def firing_rate(spark, d):
    return metrics.firing_by_batch(_spikes(spark, d), ["layer", "node", "batch"]).withColumn("rate", F.round("rate", 6))


@query(f"{RATES} SELECT layer, node, round(mean, 6) AS mean, round(std, 6) AS std FROM nd")
def node_statistics(spark, d):
    return _nodes(spark, d).select("layer", "node", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"{RATES} SELECT round(avg(mean), 6) AS firing, round((1 - avg(mean)) * 100, 4) AS silent_pct FROM nd")
def overall_firing(spark, d):
    return metrics.overall(_nodes(spark, d)).select(F.round("firing", 6).alias("firing"), F.round("silent_pct", 4).alias("silent_pct"))


@query(f"{SPK} SELECT layer, round(sum(spike) / count(spike), 6) AS rate FROM sp GROUP BY layer")
def monitor_rate(spark, d):
    return metrics.weighted_rate(_spikes(spark, d), ["layer"]).withColumn("rate", F.round("rate", 6))


@query(f"{SPK}, m AS (SELECT sample, node, max(spike) AS m FROM sp GROUP BY ALL) SELECT round(avg(1 - m), 6) AS silent FROM m")
def silent_neurons(spark, d):
    return metrics.silent_share(_spikes(spark, d), ["sample", "node"]).select(F.round("silent", 6).alias("silent"))


LOSS = "ls AS (SELECT o_orderkey AS step, (o_orderkey % 20)::INT AS epoch, CASE WHEN o_orderkey % 5 = 0 THEN 'valid' ELSE 'train' END AS split, o_totalprice / 99991 AS loss FROM orders)"


def _losses(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("step"), (k % 20).cast("int").alias("epoch"), F.when(k % 5 == 0, "valid").otherwise("train").alias("split"), (F.col("o_totalprice") / 99991).alias("loss"))


@query(f"WITH {LOSS} SELECT epoch, split, round(avg(loss), 6) AS avg_loss, round(exp(avg(loss)), 5) AS ppl FROM ls GROUP BY ALL")
def perplexity(spark, d):
    return metrics.perplexity(_losses(spark, d), ["epoch", "split"]).select("epoch", "split", F.round("avg_loss", 6).alias("avg_loss"), F.round("ppl", 5).alias("ppl"))


@query(f"WITH {LOSS} SELECT step, epoch, round(avg(loss) OVER (PARTITION BY epoch ORDER BY step ROWS UNBOUNDED PRECEDING), 6) AS running FROM ls")
def running_loss(spark, d):
    return metrics.running_mean(_losses(spark, d), "epoch", "step").select("step", "epoch", F.round("running", 6).alias("running"))


@query(f"WITH {LOSS} SELECT step, epoch, round(avg(loss) OVER (PARTITION BY epoch ORDER BY step ROWS 99 PRECEDING), 6) AS running FROM ls")
def last_hundred_mean(spark, d):
    return metrics.running_mean(_losses(spark, d), "epoch", "step", last=100).select("step", "epoch", F.round("running", 6).alias("running"))


@query(f"WITH {LOSS} SELECT step, epoch, round(loss / first_value(loss) OVER (PARTITION BY epoch ORDER BY step), 6) AS relative FROM ls")
def normalised_loss(spark, d):
    from pyspark.sql import Window

    first = F.first("loss").over(Window.partitionBy("epoch").orderBy("step"))
    return _losses(spark, d).select("step", "epoch", F.round(F.col("loss") / first, 6).alias("relative"))


@query(f"WITH {LOSS}, e AS (SELECT epoch, round(avg(loss), 6) AS loss FROM ls WHERE split = 'valid' GROUP BY epoch) SELECT epoch, loss FROM e ORDER BY loss, epoch LIMIT 1")
def best_epoch(spark, d):
    valid = _losses(spark, d).where("split = 'valid'").groupBy("epoch").agg(F.round(F.avg("loss"), 6).alias("loss"))
    return metrics.best_epoch(valid)


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag")
def correlation(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query(
    """SELECT o_orderpriority AS node, round(max(o_totalprice), 6) AS top, round(quantile_cont(o_totalprice, 0.99), 4) AS p99, round(max(o_totalprice) * 0.9::DOUBLE, 4) AS part FROM orders GROUP BY 1"""
)
def activation_scales(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("node"), "o_totalprice")
    named = lambda mode, q, to: metrics.activation_scale(o, ["node"], "o_totalprice", mode, q).withColumnRenamed("scale", to)
    out = named("max", 1, "top").join(named("percentile", 0.99, "p99"), "node").join(named("fraction", 0.9, "part"), "node")
    return out.select("node", F.round("top", 6).alias("top"), F.round("p99", 4).alias("p99"), F.round("part", 4).alias("part"))


LAYERS = """sm AS (SELECT r_regionkey AS layer, length(r_name) / 10.0::DOUBLE AS mean FROM region), lg AS (SELECT n_nationkey AS layer, (n_regionkey + 1) / 8.0::DOUBLE AS mean FROM nation)"""


@query(f"WITH {LAYERS}, b AS (SELECT unnest(range(25))::INT AS i) SELECT b.i AS i, sm.layer AS a_layer, sm.mean AS a_mean, lg.layer AS b_layer, lg.mean AS b_mean FROM b LEFT JOIN sm ON sm.layer = least(round_even(b.i / 24.0::DOUBLE * 4, 0)::INT, 4) LEFT JOIN lg ON lg.layer = b.i")
def aligned_layers(spark, d):
    small = table(spark, d, "region").select(F.col("r_regionkey").alias("layer"), (F.char_length("r_name") / F.lit(10.0)).alias("mean"))
    large = table(spark, d, "nation").select(F.col("n_nationkey").alias("layer"), ((F.col("n_regionkey") + 1) / F.lit(8.0)).alias("mean"))
    return metrics.align(small, large, 5, 25)


@query(f"WITH {LAYERS} SELECT layer, round(layer / 24::DOUBLE, 6) AS rel FROM lg")
def relative_positions(spark, d):
    return metrics.relative_position(table(spark, d, "nation").select(F.col("n_nationkey").alias("layer")), "layer").select("layer", F.round("rel", 6).alias("rel"))


@query(f"WITH {LAYERS} SELECT round((1 - avg(sm.mean)) * 100, 4) AS sparse, round((avg(sm.mean) - (SELECT avg(mean) FROM lg)) / (SELECT avg(mean) FROM lg) * 100, 4) AS difference FROM sm")
def sparsity_difference(spark, d):
    a = table(spark, d, "region").agg(F.avg(F.char_length("r_name") / F.lit(10.0)).alias("a"))
    b = table(spark, d, "nation").agg(F.avg((F.col("n_regionkey") + 1) / F.lit(8.0)).alias("b"))
    both = a.join(b)
    return both.select(F.round((1 - F.col("a")) * 100, 4).alias("sparse"), F.round(metrics.relative_difference(F.col("a"), F.col("b")), 4).alias("difference"))


@query(
    """WITH l AS (SELECT (o_orderkey % 300)::INT AS epoch, CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'valid' END AS split, o_orderkey AS line, round(o_totalprice / 50000, 6) AS loss FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY epoch, split ORDER BY line DESC) AS r FROM l)
SELECT epoch, split, line, loss FROM k WHERE r = 1"""
)
def log_last_write(spark, d):
    k = F.col("o_orderkey")
    log = table(spark, d, "orders").select((k % 300).cast("int").alias("epoch"), F.when(k % 2 == 0, "train").otherwise("valid").alias("split"), k.alias("line"), F.round(F.col("o_totalprice") / 50000, 6).alias("loss"))
    # written as log lines and parsed again, as a log on disk would be
    more = {"ppl": F.lit(1.0), "lr": F.lit(0.1), "at": F.lit("2024-01-01 00:00:00")}
    text = log.withColumns(more).select("line", log_line().alias("value"))
    return metrics.last_write(parse_log(text).select("epoch", "split", "line", "loss"), ["epoch", "split"])


@query(f"{RATES} SELECT layer, round(avg(mean), 6) AS mean, round(layer / 11::DOUBLE, 6) AS rel FROM nd GROUP BY layer")
def layer_means(spark, d):
    rows = _nodes(spark, d).groupBy("layer").agg(F.avg("mean").alias("mean"))
    return metrics.relative_position(rows, "layer").select("layer", F.round("mean", 6).alias("mean"), F.round("rel", 6).alias("rel"))


@query(
    """WITH lg AS (SELECT vec_id AS row, (k - 1)::INT AS item, embedding[k]::DOUBLE * 8 AS logit, label FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)),
m AS (SELECT row, label, max(logit) AS m, max(CASE WHEN item = label THEN logit END) AS t FROM lg GROUP BY row, label), l AS (SELECT lg.row, ln(sum(exp(logit - m))) + any_value(m) - any_value(t) AS loss FROM lg JOIN m USING (row) GROUP BY lg.row),
k AS (SELECT row, item, label, row_number() OVER (PARTITION BY row ORDER BY logit DESC, item) AS r FROM lg) SELECT round(avg((item = label)::INT), 6) AS accuracy, round(avg(loss), 6) AS loss, count(*) AS n FROM k JOIN l USING (row) WHERE r = 1"""
)
def classification_report(spark, d):
    from ..operators import decoding

    e = table(spark, d, "embeddings")
    logits = e.select(F.col("vec_id").alias("row"), "label", F.posexplode("embedding").alias("item", "v")).select("row", "label", "item", (F.col("v").cast("double") * 8).alias("logit"))
    chosen = decoding.greedy(logits).join(decoding.cross_entropy(logits, "label"), "row").join(e.select(F.col("vec_id").alias("row"), "label"), "row")
    return chosen.agg(F.round(F.avg((F.col("item") == F.col("label")).cast("int")), 6).alias("accuracy"), F.round(F.avg("loss"), 6).alias("loss"), F.count("*").alias("n"))


@query("SELECT p_partkey::VARCHAR AS layer, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part")
def numeric_key_order(spark, d):
    from ..operators.corpus import running_offsets

    keys = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("layer"))
    ordered = running_offsets(keys.select("layer", F.col("layer").cast("bigint").alias("n"), F.lit(1).alias("one")), "n", "one", "pos")
    return ordered.select("layer", "pos")
