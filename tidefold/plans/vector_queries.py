"""Queries on vectors: kernels, projections, encoders, decoding filters over embeddings read as logits, scalar functions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar, vectors
from ..operators import corpus, decoding, encoding, sampling
from ..sources.tables import EVENTS_SQL, events, table
from .registry import query

LOGITS = "lg AS (SELECT vec_id AS row, (k - 1)::INT AS item, embedding[k]::DOUBLE * 8 AS logit, label FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings))"
SOFT = f"{LOGITS}, mx AS (SELECT *, logit - max(logit) OVER (PARTITION BY row) AS z FROM lg), pr AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY row) AS p FROM mx)"
RUN = f"{SOFT}, ru AS (SELECT *, sum(p) OVER (PARTITION BY row ORDER BY p DESC, item ROWS UNBOUNDED PRECEDING) AS c FROM pr)"


def _logits(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), "label", F.posexplode("embedding").alias("item", "e")).select("row", "item", (F.col("e").cast("double") * 8).alias("logit"), "label")


@query(f"WITH {SOFT} SELECT row, item, round(p, 6) AS p FROM pr")
def softmax_rows(spark, d):
    return decoding.softmax(_logits(spark, d)).select("row", "item", F.round("p", 6).alias("p"))


@query(
    f"""WITH {LOGITS}, mx AS (SELECT *, logit / 0.8::DOUBLE - max(logit / 0.8::DOUBLE) OVER (PARTITION BY row) AS z FROM lg), pr AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY row) AS p FROM mx),
ru AS (SELECT *, sum(p) OVER (PARTITION BY row ORDER BY p DESC, item ROWS UNBOUNDED PRECEDING) AS c FROM pr), k AS (SELECT * FROM ru WHERE c - p <= 0.9::DOUBLE)
SELECT row, item, round(p / sum(p) OVER (PARTITION BY row), 6) AS p FROM k"""
)
def nucleus_renormalised(spark, d):
    return decoding.nucleus(decoding.softmax(_logits(spark, d), temperature=0.8), 0.9).select("row", "item", F.round("p", 6).alias("p"))


@query(
    f"""WITH {RUN}, cu AS (SELECT *, coalesce(max(CASE WHEN c > 0.7::DOUBLE THEN p END) OVER (PARTITION BY row), max(p) OVER (PARTITION BY row)) AS cut FROM ru)
SELECT row, item, round(power(p, 1 / 0.8::DOUBLE), 6) AS p FROM cu WHERE p >= cut"""
)
def nucleus_with_ties(spark, d):
    return decoding.nucleus_cutoff(decoding.softmax(_logits(spark, d)), 0.7, 0.8).select("row", "item", F.round("p", 6).alias("p"))


@query(
    f"""WITH {LOGITS}, s AS (SELECT DISTINCT vec_id AS row, item FROM (SELECT vec_id, unnest([vec_id % 64, (vec_id * 7) % 64, (vec_id * 13) % 64])::INT AS item FROM embeddings))
SELECT lg.row, lg.item, round(CASE WHEN s.item IS NULL THEN logit WHEN logit > 0 THEN logit / 1.3::DOUBLE ELSE logit * 1.3::DOUBLE END, 6) AS logit FROM lg LEFT JOIN s ON s.row = lg.row AND s.item = lg.item"""
)
def repetition_penalty(spark, d):
    i = F.col("vec_id")
    seen = table(spark, d, "embeddings").select(i.alias("row"), F.explode(F.array(*[(k % 64).cast("int") for k in (i, i * 7, i * 13)])).alias("item"))
    return decoding.repetition_penalty(_logits(spark, d), seen, 1.3).select("row", "item", F.round("logit", 6).alias("logit"))


@query(f"WITH {LOGITS} SELECT row, item, CASE WHEN item = 0 THEN -999999999.0 ELSE round(logit, 6) END AS logit FROM lg")
def mute_token(spark, d):
    return decoding.mute(_logits(spark, d).withColumn("logit", F.round("logit", 6))).select("row", "item", "logit")


@query(f"WITH {LOGITS}, k AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY logit DESC, item) AS r FROM lg) SELECT row, item FROM k WHERE r = 1")
def greedy_choice(spark, d):
    return decoding.greedy(_logits(spark, d))


@query(
    f"""WITH {SOFT}, c AS (SELECT *, sum(p) OVER (PARTITION BY row ORDER BY item ROWS UNBOUNDED PRECEDING) AS c, sum(p) OVER (PARTITION BY row) AS total FROM pr)
SELECT row, min(item) AS item FROM c WHERE c > {sampling.uniform_sql(9, 'row')} * total GROUP BY row"""
)
def multinomial_draw(spark, d):
    return sampling.multinomial(decoding.softmax(_logits(spark, d)), "row", "item", "p", 9)


@query(f"WITH {LOGITS}, m AS (SELECT row, max(logit) AS m, max(CASE WHEN item = label THEN logit END) AS t FROM lg GROUP BY row) SELECT lg.row, round(ln(sum(exp(logit - m))) + any_value(m) - any_value(t), 6) AS loss FROM lg JOIN m USING (row) GROUP BY lg.row")
def cross_entropy(spark, d):
    return decoding.cross_entropy(_logits(spark, d).where("label is not null"), "label").select("row", F.round("loss", 6).alias("loss"))


@query(
    f"""WITH {LOGITS}, g AS (SELECT row // 4 AS sample, row % 4 AS t, row, item, logit, row // 4 % 10 AS target FROM lg), m AS (SELECT row, max(logit) AS m, max(CASE WHEN item = target THEN logit END) AS t FROM g GROUP BY row),
l AS (SELECT g.row, any_value(sample) AS sample, ln(sum(exp(logit - m))) + any_value(m) - any_value(m.t) AS loss FROM g JOIN m USING (row) GROUP BY g.row) SELECT round(avg(loss), 6) AS loss, count(*) AS n FROM l"""
)
def temporal_cross_entropy(spark, d):
    steps = _logits(spark, d).withColumn("target", F.expr("cast(row div 4 % 10 as int)"))
    return decoding.cross_entropy(steps, "target").agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("*").alias("n"))


@query(f"WITH {LOGITS}, k AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY logit DESC, item) AS r FROM lg) SELECT round(avg((r <= 1)::INT), 6) AS acc1, round(avg((r <= 5)::INT), 6) AS acc5 FROM k WHERE item = label")
def top_k_accuracy(spark, d):
    from ..operators.metrics import top_k_accuracy as top

    return top(_logits(spark, d), "label").select(F.round("acc1", 6).alias("acc1"), F.round("acc5", 6).alias("acc5"))


_PAIR = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, list_inner_product(v, v) AS q FROM e), p AS (SELECT a.vec_id, list_inner_product(a.v, b.v) AS s, a.q + b.q AS q FROM n a, n b)"""


@query(f"{_PAIR} SELECT vec_id, round(sum(s), 4) AS linear, round(sum(power(s, 2)), 4) AS polynomial, round(sum(1 / (1 + exp(-s))), 4) AS sigmoid, round(sum(exp(-greatest(q - 2 * s, 0) / 2)), 4) AS gaussian FROM p GROUP BY vec_id")
def kernel_similarity(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.kernel_sums(e, e).select("vec_id", *[F.round(c, 4).alias(c) for c in vectors.KERNELS])


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
p AS (SELECT list_inner_product(a.v, b.v) / greatest(a.n, 1e-12) / greatest(b.n, 1e-12) AS s, (a.label = b.label)::INT AS y FROM e a, e b), c AS (SELECT *, least(greatest(s, 1e-6), 1 - 1e-6) AS q FROM p)
SELECT round(avg(power(s - y, 2)), 6) AS mse, round(avg(abs(s - y)), 6) AS l1, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS bce FROM c"""
)
def similarity_loss(spark, d):
    return vectors.similarity_loss(table(spark, d, "embeddings")).select(*[F.round(c, 6).alias(c) for c in ("mse", "l1", "bce")])


_DOT, _GAP = "list_inner_product(a.v, b.v)", "(a.n + b.n - 2 * list_inner_product(a.v, b.v))"
_KERNEL_SQL = {"polynomial": f"power({_DOT}, 2.0)", "sigmoid": f"1 / (1 + exp(-2.0::DOUBLE * {_DOT}))", "gaussian": f"exp(-greatest({_GAP}, 0) / 2)"}
_KERNEL_ARG = {"polynomial": 2.0, "sigmoid": 2.0, "gaussian": 1.0}


@query(
    "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n FROM embeddings), "
    + ", ".join(f"{k} AS (SELECT '{k}' AS kernel, avg(power(s - y, 2)) AS mse, avg(abs(s - y)) AS l1, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS bce FROM (SELECT *, least(greatest(s, 1e-6), 1 - 1e-6) AS q FROM (SELECT {x} AS s, (a.label = b.label)::INT AS y FROM e a, e b)))" for k, x in _KERNEL_SQL.items())
    + " SELECT kernel, round(mse, 6) AS mse, round(l1, 6) AS l1, round(bce, 6) AS bce FROM ("
    + " UNION ALL ".join(f"SELECT * FROM {k}" for k in _KERNEL_SQL)
    + ")"
)
def kernel_losses(spark, d):
    losses = vectors.similarity_losses(table(spark, d, "embeddings"), _KERNEL_ARG)
    return losses.select("kernel", *[F.round(c, 6).alias(c) for c in ("mse", "l1", "bce")])


@query("SELECT turn_id, (k % 64)::BIGINT AS id, list_transform(embedding, lambda v: CASE WHEN v >= 0 THEN 1 ELSE 0 END) AS bits FROM (SELECT conv_id * 1000 + turn AS turn_id, (conv_id * 7 + turn) AS k FROM conversations) JOIN embeddings ON vec_id = k % 64")
def embedding_lookup(spark, d):
    i = F.col("conv_id") * 7 + F.col("turn")
    ids = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), (i % 64).alias("id"))
    found = corpus.embed(ids, table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "embedding")
    return found.select("turn_id", "id", F.transform("embedding", lambda v: scalar.heaviside(v)).alias("bits"))


@query(
    """WITH u AS (SELECT vec_id AS n, (k - 1)::BIGINT AS t, embedding[k]::DOUBLE AS v FROM (SELECT *, unnest(range(1, 9)) AS k FROM embeddings))
SELECT t + 8 * n AS tn, t, n, round(v, 6) AS v FROM u"""
)
def merged_steps(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.posexplode(F.slice("embedding", 1, 8)).alias("t", "v")).withColumn("t", F.col("t").cast("bigint"))
    merged = corpus.merge_steps(e, 8)
    return corpus.split_steps(merged.withColumn("kept", F.col("tn")), 8).select(F.col("kept").alias("tn"), "t", "n", F.round(F.col("v").cast("double"), 6).alias("v"))


@query(
    """WITH e AS (SELECT vec_id, (k - 1)::INT AS k, embedding[k]::DOUBLE AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)), s AS (SELECT vec_id, avg(x) AS m, var_pop(x) AS v FROM e GROUP BY vec_id)
SELECT e.vec_id, e.k, round((x - m) / sqrt(v + 0.00001::DOUBLE), 5) AS y FROM e JOIN s USING (vec_id)"""
)
def layer_norm(spark, d):
    out = table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.layer_norm(F.col("embedding"))).alias("k", "y"))
    return out.select("vec_id", "k", F.round("y", 5).alias("y"))


_WEIGHT = [[((i * 7 + j * 3) % 5 - 2) / 4 for j in range(64)] for i in range(3)]
_DOT = [f"list_inner_product(embedding::DOUBLE[], {row}::DOUBLE[])" for row in _WEIGHT]


@query(
    f"""WITH z AS (SELECT vec_id, {_DOT[0]} AS a, {_DOT[1]} AS b, {_DOT[2]} AS c FROM embeddings)
SELECT vec_id, round(a, 6) AS a, round(power(greatest(b, 0), 2), 6) AS b, round(1 / (1 + exp(-c)) * a, 6) AS c FROM z"""
)
def gated_projection(spark, d):
    z = table(spark, d, "embeddings").select("vec_id", vectors.matvec(F.col("embedding"), _WEIGHT).alias("z"))
    a, b, c = (F.col("z")[k] for k in range(3))
    return z.select("vec_id", F.round(a, 6).alias("a"), F.round(F.pow(F.greatest(b, F.lit(0.0)), 2), 6).alias("b"), F.round(1 / (1 + F.exp(-c)) * a, 6).alias("c"))


@query("SELECT vec_id, list_transform(embedding, lambda v: (v >= 0)::INT) AS bits FROM embeddings")
def embedding_binarised(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", scalar.heaviside).alias("bits"))


@query("SELECT (k - 1)::INT AS t, vec_id AS n, embedding[k]::DOUBLE AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)")
def transpose(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.posexplode("embedding").alias("t", "x")).select("t", "n", F.col("x").cast("double").alias("x"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: (v >= 0)::INT) AS b FROM embeddings)
SELECT vec_id, list_transform(range(8), lambda k: list_sum(list_transform(range(8), lambda j: b[k * 8 + j + 1] * (1 << j)::INT))::INT) AS packed, b AS unpacked FROM e"""
)
def bit_packed(spark, d):
    bits = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", scalar.heaviside).alias("b")).select("vec_id", scalar.pack_bits(F.col("b")).alias("packed"), F.size("b").alias("n"))
    return bits.select("vec_id", "packed", scalar.unpack_bits(F.col("packed"), F.col("n")).alias("unpacked"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, round(round_even(value / 20, 0) * 20, 6) AS q, round(greatest(least(round_even(value / 100 / {2 / 64}::DOUBLE, 0) * {2 / 64}::DOUBLE, {255 / 64}::DOUBLE), {-256 / 64}::DOUBLE), 6) AS q8 FROM ev")
def quantised(spark, d):
    v = F.col("value")
    return events(spark, d).select("event_id", F.round(scalar.step_quantise(v, 20.0), 6).alias("q"), F.round(scalar.quantise_8bit(v / 100, 64.0), 6).alias("q8"))


X_SQL = f"WITH {EVENTS_SQL}, xs AS (SELECT event_id, value / 99.7::DOUBLE - 0.5::DOUBLE AS x FROM ev)"


def _x(spark, d):
    return events(spark, d).select("event_id", (F.col("value") / F.lit(99.7) - 0.5).alias("x"))



@query(f"{X_SQL} SELECT event_id, {', '.join(f'round({scalar.duck(scalar.smooth_step(k, 2.0))}, 6) AS {k}' for k in scalar.KINDS)}, round({scalar.duck(scalar.smooth_step('q_pseudo_spike', 3.0))}, 6) AS q_pseudo_spike FROM xs")
def smooth_steps(spark, d):
    rows = _x(spark, d)
    kinds = [F.round(F.expr(scalar.smooth_step(k, 2.0)), 6).alias(k) for k in scalar.KINDS]
    return rows.select("event_id", *kinds, F.round(F.expr(scalar.smooth_step("q_pseudo_spike", 3.0)), 6).alias("q_pseudo_spike"))


@query(f"{X_SQL} SELECT event_id, {', '.join(f'round({scalar.duck(scalar.slope(k, 3.0))}, 6) AS {k}' for k in scalar.SLOPES)} FROM xs")
def surrogate_slopes(spark, d):
    return _x(spark, d).select("event_id", *[F.round(F.expr(scalar.slope(k, 3.0)), 6).alias(k) for k in scalar.SLOPES])


# erf as its series of positive terms, exp(-z^2) 2^n z^(2n+1) / (1 * 3 * .. * (2n+1)); beyond |z| = 6 it is 1 in doubles
_ODD_LOGS = np.cumsum(np.log(2 * np.arange(160) + 1)).tolist()


@query(
    f"""{X_SQL}, z AS (SELECT event_id, least(greatest(2 * x, -6), 6) AS z FROM xs),
t AS (SELECT event_id, CASE WHEN z = 0 THEN 0 ELSE sign(z) * list_sum(list_transform(range(160), lambda n: exp((2 * n + 1) * ln(abs(z)) + n * ln(2) - z * z - ({_ODD_LOGS}::DOUBLE[])[n + 1]))) END AS s FROM z)
SELECT event_id, round((1 + 2 / sqrt(pi()) * s) / 2, 6) AS y FROM t"""
)
def erf_step(spark, d):
    return _x(spark, d).select("event_id", F.round(scalar.erf_step(F.col("x")), 6).alias("y"))


@query(
    """WITH c AS (SELECT l_partkey, count(*) AS n, avg(l_quantity) AS q FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, round(1 + ln(1 + exp(ln(0.5::DOUBLE + n / 24::DOUBLE))), 6) AS tau, round(ln(1 + exp(q / 10 - 2.5::DOUBLE)), 6) AS theta FROM c"""
)
def learned_parameters(spark, d):
    """A neuron for each part: its raw parameters from how often and how much it is ordered."""
    counts = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("q"))
    raw = F.ln(F.lit(0.5) + F.col("n") / F.lit(24.0))
    return counts.select("l_partkey", F.round(scalar.learned_tau(raw), 6).alias("tau"), F.round(scalar.softplus(F.col("q") / 10 - F.lit(2.5)), 6).alias("theta"))


UNIT = f"WITH {EVENTS_SQL}, u AS (SELECT event_id, least(greatest(value / 500, 0), 1) AS x FROM ev)"


def _unit(spark, d):
    return events(spark, d).select("event_id", F.least(F.greatest(F.col("value") / 500, F.lit(0.0)), F.lit(1.0)).alias("x"))


@query(f"{UNIT} SELECT event_id, round_even(17 * (1 - x), 0)::INT AS step, round_even(7 - ln({math.exp(7) - 1}::DOUBLE * x + 1), 0)::INT AS log_step, list_transform(range(18), lambda t: (t = round_even(17 * (1 - x), 0)::INT)::INT) AS spikes FROM u")
def latency_code(spark, d):
    out = _unit(spark, d).select("event_id", encoding.latency(F.col("x"), 18).alias("step"), encoding.latency(F.col("x"), 8, log=True).alias("log_step"))
    return out.withColumn("spikes", encoding.spike_at(F.col("step"), 18))


@query(f"{UNIT} SELECT event_id, ({sampling.uniform_sql(11, 'event_id')} <= x)::INT AS spike FROM u")
def poisson_code(spark, d):
    return _unit(spark, d).select("event_id", encoding.poisson(F.col("x"), 11, F.col("event_id")).alias("spike"))


@query(f"{UNIT} SELECT event_id, list_transform(range(7, -1, -1), lambda b: (floor(floor(least(x, {1 - 2**-8}) * 256) / power(2.0, b)) % 2)::INT) AS digits FROM u")
def phase_code(spark, d):
    return _unit(spark, d).select("event_id", encoding.weighted_phase(F.least(F.col("x"), F.lit(1 - 2.0**-8)), 8).alias("digits"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, [1, 0, 0, 1, 0][((i - 1) % 5 + 1)::INT] AS spike FROM ev")
def periodic_code(spark, d):
    i = F.row_number().over(Window.partitionBy("sample").orderBy("t", "event_id")) - 1
    pattern = F.array(*[F.lit(v) for v in (1, 0, 0, 1, 0)])
    return events(spark, d).withColumn("i", i).select("event_id", encoding.periodic(pattern, F.col("i")).alias("spike"))


_MU = [(0.0 + (2 * i - 3) / 2.0 * (1.0 / 4)) for i in range(1, 7)]
_S2 = (1 / 1.5 * 1.0 / 4) ** 2


@query(f"{UNIT}, g AS (SELECT event_id, list_transform({_MU}::DOUBLE[], lambda m: round_even(50 * (1 - exp(-(x - m) * (x - m) / 2 / {_S2}::DOUBLE)), 0)) AS ts FROM u) SELECT event_id, list_transform(ts, lambda t: CASE WHEN t >= 50 THEN -1 ELSE t::INT END) AS times FROM g")
def population_code(spark, d):
    return _unit(spark, d).select("event_id", encoding.gaussian_tuning(F.col("x"), 6, 0.0, 1.0).alias("times"))


_V0 = encoding.psp_scale()
TEMPO = f"""WITH {EVENTS_SQL}, s AS (SELECT sample, (i % 40)::INT AS st, sum(0.1::DOUBLE * (x + 1)) AS w FROM ev GROUP BY ALL), g AS (SELECT sample, st, w, unnest(range(50)) AS t FROM s),
v AS (SELECT sample, t, sum(CASE WHEN t >= st THEN (exp(-(t - st) / 15.0::DOUBLE) - exp(-(t - st) / 3.75::DOUBLE)) * {_V0}::DOUBLE * w ELSE 0 END) AS v FROM g GROUP BY sample, t),
k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY v DESC, t) AS r FROM v), o AS (SELECT sample, v AS v_max, t AS t_max FROM k WHERE r = 1)"""


def _tempotron(spark, d):
    i = F.row_number().over(Window.partitionBy("sample").orderBy("t", "event_id"))
    spikes = events(spark, d).withColumn("i", i).select("sample", (F.col("i") % 40).cast("int").alias("st"), (F.lit(0.1) * (F.col("x") + 1)).alias("w"))
    return encoding.tempotron(spikes, "sample", "st", F.col("w"), 50)


@query(f"{TEMPO} SELECT sample, round(v_max, 6) AS v_max, t_max::INT AS t_max, (CASE WHEN v_max >= 1 THEN t_max ELSE -t_max END)::INT AS spike FROM o")
def tempotron(spark, d):
    return _tempotron(spark, d).select("sample", F.round("v_max", 6).alias("v_max"), F.col("t_max").cast("int").alias("t_max"), F.col("spike").cast("int").alias("spike"))


@query(f"{TEMPO} SELECT round(sum(CASE WHEN (v_max >= 1)::INT <> sample % 2 THEN power(v_max - 1, 2) ELSE 0 END) / count(*), 6) AS loss FROM o")
def tempotron_loss(spark, d):
    return encoding.tempotron_loss(_tempotron(spark, d), (F.col("sample") % 2).cast("int")).select(F.round("loss", 6).alias("loss"))


@query(f"WITH {LOGITS} SELECT row, item, CASE WHEN label = item THEN 1.1 ELSE 0.9 END::DOUBLE AS theta FROM lg")
def threshold_margins(spark, d):
    return _logits(spark, d).select("row", "item", encoding.threshold_margin(F.col("label"), F.col("item")).alias("theta"))


@query(
    f"""WITH {EVENTS_SQL}, s AS (SELECT event_id, value, coalesce(lag(value) OVER (PARTITION BY sample ORDER BY t, event_id), 0) AS before FROM ev) SELECT event_id, before, round(value * 0.3::DOUBLE + before * 0.7::DOUBLE, 6) AS mixed FROM s"""
)
def time_mix(spark, d):
    shifted = corpus.time_shift(events(spark, d), "value")
    return shifted.select("event_id", "before", F.round(corpus.time_mix(F.col("value"), F.col("before"), 0.3), 6).alias("mixed"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, round(2595 * log10(1 + value / 700), 6) AS mel, round(700 * (power(10, value / 2595) - 1), 6) AS hz FROM ev")
def mel_scale(spark, d):
    return events(spark, d).select("event_id", F.round(scalar.mel(F.col("value")), 6).alias("mel"), F.round(scalar.hz(F.col("value")), 6).alias("hz"))


@query("SELECT vec_id, round(list_max(list_transform(embedding::DOUBLE[], lambda v: abs(v))), 6) AS peak, round(embedding[1]::DOUBLE / list_max(list_transform(embedding::DOUBLE[], lambda v: abs(v))), 6) AS first FROM embeddings")
def peak_normalised(spark, d):
    from ..sources.text import peak_normalise

    e = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(F.transform(e, lambda x: F.abs(x))), 6).alias("peak"), F.round(peak_normalise(e)[0], 6).alias("first"))


@query("SELECT l_orderkey, l_linenumber, (l_orderkey >> 3) & 31 AS field, ((l_partkey & 7) << 4) | (l_suppkey & 15) AS word FROM lineitem")
def bit_fields(spark, d):
    field = scalar.bits(F.col("l_orderkey"), 31 << 3, 3)
    word = F.shiftleft(F.col("l_partkey").bitwiseAND(F.lit(7).cast("bigint")), 4).bitwiseOR(F.col("l_suppkey").bitwiseAND(F.lit(15).cast("bigint")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", field.alias("field"), word.alias("word"))


_DCT = vectors.cosine_blocks(4)


# SQL: block (bi, bj) of the 8 by 8 matrix, its row r of the transform, back in place (row, column) of the matrix
_BLOCK = "list_transform(range(16), lambda m: embedding[(bi * 4 + m // 4) * 8 + bj * 4 + m % 4 + 1]::DOUBLE)"


@query(
    f"""WITH b AS (SELECT vec_id, bi, bj, {_BLOCK} AS x FROM embeddings, unnest(range(2)) AS i(bi), unnest(range(2)) AS j(bj)),
y AS (SELECT vec_id, bi, bj, list_transform({np.kron(_DCT, _DCT).tolist()}::DOUBLE[][], lambda r: round(list_inner_product(x, r), 5)) AS y FROM b),
v AS (SELECT vec_id, (bi * 4 + m // 4) * 8 + bj * 4 + m % 4 AS pos, y[m + 1] AS v FROM y, unnest(range(16)) AS k(m))
SELECT vec_id, list(v ORDER BY pos) AS y FROM v GROUP BY vec_id"""
)
def cosine_transform(spark, d):
    out = table(spark, d, "embeddings").select("vec_id", vectors.two_sided_blocks(F.col("embedding"), _DCT, 8).alias("y"))
    return out.select("vec_id", F.transform("y", lambda x: scalar.rounded(x, 5)).alias("y"))


@query("SELECT event_id, regexp_extract(props, '([0-9]+)', 1)::INT AS k, '{\"k\":' || regexp_extract(props, '([0-9]+)', 1) || '}' AS again FROM events")
def json_round_trip(spark, d):
    parsed = table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("j"))
    return parsed.select("event_id", F.col("j.k").alias("k"), F.to_json("j").alias("again"))
