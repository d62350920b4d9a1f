"""Queries that run an ordered recurrence along each user's events; SQL is a recursive query with the same arithmetic."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import recurrences as rec
from ..sources.tables import EVENTS_SQL, events
from .registry import query


def _input(spark, d):
    return events(spark, d).select("sample", "event_id", "t", (F.col("value") / 100).alias("x"), "p", F.col("x").alias("kind"))


def _neuron_sql(charge: str, v0: str = "0.0", reset: str = "0.0", theta: float = 1.0, out: str = "") -> str:
    """charge is SQL over v and x; reset over h."""
    return f"""WITH RECURSIVE {EVENTS_SQL}, inp AS (SELECT sample, event_id, i, value / 100 AS x FROM ev),
r AS (SELECT sample, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0 AS spike, {v0}::DOUBLE AS v, 0.0::DOUBLE AS h FROM (SELECT DISTINCT sample FROM inp) UNION ALL
  SELECT sample, i, event_id, CASE WHEN h >= {theta} THEN 1 ELSE 0 END, CASE WHEN h >= {theta} THEN {reset} ELSE h END, h FROM
  (SELECT e.sample, e.i, e.event_id, {charge} AS h FROM r JOIN inp e ON e.sample = r.sample AND e.i = r.i + 1))
SELECT event_id, spike, round(v, 6) AS v{out} FROM r WHERE i > 0"""


def _shown(df, *more):
    return df.select("event_id", "spike", F.round("v", 6).alias("v"), *more)


@query(_neuron_sql("r.v + e.x"))
def neuron_if(spark, d):
    return _shown(rec.neuron(_input(spark, d), rec.integrate()))


@query(_neuron_sql("r.v + (e.x - r.v) / 2.3::DOUBLE"))
def neuron_lif(spark, d):
    return _shown(rec.neuron(_input(spark, d), rec.leaky(2.3)))


@query(_neuron_sql("r.v - r.v / 2.3::DOUBLE + e.x"))
def neuron_lif_no_decay(spark, d):
    return _shown(rec.neuron(_input(spark, d), rec.leaky(2.3, decay_input=False)))


@query(_neuron_sql("r.v + (e.x - r.v) / 2.3::DOUBLE", reset="h - 1"))
def neuron_lif_soft(spark, d):
    return _shown(rec.neuron(_input(spark, d), rec.leaky(2.3), v_reset=None))


@query(_neuron_sql("r.v + (e.x - r.v) * (1 / (1 + exp(-0.5::DOUBLE)))"))
def neuron_plif(spark, d):
    return _shown(rec.neuron(_input(spark, d), rec.parametric(0.5)))


_SURROGATE = "1 / (1 + exp(-4.0::DOUBLE * (h - 1)))"


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, inp AS (SELECT sample, event_id, i, value / 100 AS x FROM ev),
r AS (SELECT sample, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0.0::DOUBLE AS s, 0.0::DOUBLE AS v FROM (SELECT DISTINCT sample FROM inp) UNION ALL
  SELECT sample, i, event_id, {_SURROGATE}, (1 - {_SURROGATE}) * h FROM (SELECT e.sample, e.i, e.event_id, r.v + (e.x - r.v) / 2 AS h FROM r JOIN inp e ON e.sample = r.sample AND e.i = r.i + 1))
SELECT event_id, round(s, 6) AS out, round(v, 6) AS v FROM r WHERE i > 0"""
)
def neuron_surrogate(spark, d):
    out = rec.neuron(_input(spark, d), rec.leaky(2.0), fire=lambda u: 1 / (1 + np.exp(-4.0 * u)))
    return out.select("event_id", F.round("out", 6).alias("out"), F.round("v", 6).alias("v"))


@query(_neuron_sql("r.v / 2.3::DOUBLE + e.x", reset="h - 1"))
def neuron_learnable(spark, d):
    return _shown(rec.neuron(_input(spark, d), rec.learnable(2.3), v_reset=None))


@query(_neuron_sql("r.v + (e.x + r.v * (r.v - 0.8::DOUBLE)) / 2.3::DOUBLE", v0="-0.1", reset="-0.1"))
def neuron_qif(spark, d):
    return _shown(rec.neuron(_input(spark, d), rec.quadratic(2.3), v_reset=-0.1))


@query(_neuron_sql("r.v + (e.x - r.v + exp(least(r.v - 0.8::DOUBLE, 700))) / 2", v0="-0.1", reset="-0.1"))
def neuron_eif(spark, d):
    return _shown(rec.neuron(_input(spark, d), rec.exponential(), v_reset=-0.1))


@query(_neuron_sql("0.876543211::DOUBLE * r.v + 0.512345679::DOUBLE * e.x + 0.01::DOUBLE"))
def neuron_general(spark, d):
    return _shown(rec.neuron(_input(spark, d), rec.linear(0.876543211, 0.512345679, 0.01)))


@query(_neuron_sql("r.v + (e.x - r.v) / 2.3::DOUBLE", out=", round(greatest(h, 0), 6) AS out"))
def neuron_activation(spark, d):
    return _shown(rec.neuron(_input(spark, d), rec.leaky(2.3), emit=lambda h: np.maximum(h, 0.0)), F.round("out", 6).alias("out"))


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, inp AS (SELECT sample, event_id, i, value / 100 AS x FROM ev),
r AS (SELECT sample, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0 AS spike, 0.0::DOUBLE AS v, 0.0::DOUBLE AS w FROM (SELECT DISTINCT sample FROM inp) UNION ALL
  SELECT sample, i, event_id, s, CASE WHEN s = 1 THEN 0.0 ELSE h END, w + (0.5::DOUBLE * h - w) / 2.7::DOUBLE + 0.1::DOUBLE * s FROM
  (SELECT *, CASE WHEN h >= 1 THEN 1 ELSE 0 END AS s FROM (SELECT e.sample, e.i, e.event_id, r.w, r.v + (e.x - r.v - r.w) / 2.3::DOUBLE AS h FROM r JOIN inp e ON e.sample = r.sample AND e.i = r.i + 1)))
SELECT event_id, spike, round(v, 6) AS v, round(w, 6) AS w FROM r WHERE i > 0"""
)
def neuron_adaptive(spark, d):
    return _shown(rec.adaptive(_input(spark, d), tau=2.3, tau_w=2.7, a=0.5, b=0.1), F.round("w", 6).alias("w"))


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, inp AS (SELECT sample, event_id, i, value / 100 AS k, x + 0.5::DOUBLE AS v FROM ev),
r AS (SELECT sample, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0.0::DOUBLE AS p, 0.0::DOUBLE AS q, -1e38::DOUBLE AS o, 0.0::DOUBLE AS y FROM (SELECT DISTINCT sample FROM inp) UNION ALL
  SELECT sample, i, event_id, exp(w + o - n2) * p + exp(k - n2) * v, exp(w + o - n2) * q + exp(k - n2), n2, (exp(o - n1) * p + exp(u + k - n1) * v) / (exp(o - n1) * q + exp(u + k - n1)) FROM
  (SELECT *, greatest(o, u + k) AS n1, greatest(w + o, k) AS n2 FROM (SELECT e.sample, e.i, e.event_id, e.k, e.v, r.p, r.q, r.o, -0.5::DOUBLE AS w, 0.3::DOUBLE AS u FROM r JOIN inp e ON e.sample = r.sample AND e.i = r.i + 1)))
SELECT event_id, round(y, 6) AS y FROM r WHERE i > 0"""
)
def weighted_key_value(spark, d):
    rows = _input(spark, d).select("sample", "event_id", "t", F.col("x").alias("k"), (F.col("kind") + 0.5).cast("double").alias("v"))
    return rec.wkv(rows, -0.5, 0.3).select("event_id", F.round("y", 6).alias("y"))


@query(
    f"""WITH {EVENTS_SQL}, s AS (SELECT event_id, value / 100 AS k, x + 0.5::DOUBLE AS v, row_number() OVER (ORDER BY t, event_id) AS i FROM ev),
m AS (SELECT a.event_id, a.k, a.v, coalesce(sum(exp(b.k - 0.5::DOUBLE * (a.i - 1 - b.i)) * b.v), 0) AS p, coalesce(sum(exp(b.k - 0.5::DOUBLE * (a.i - 1 - b.i))), 0) AS q
  FROM s a LEFT JOIN s b ON b.i BETWEEN a.i - 200 AND a.i - 1 GROUP BY ALL)
SELECT event_id, round((p + exp(0.3::DOUBLE + k) * v) / (q + exp(0.3::DOUBLE + k)), 6) AS y FROM m"""
)
def weighted_key_value_one_key(spark, d):
    """All events as one key, in blocks. In the SQL, weights more than 200 steps old (under exp(-100)) are left out."""
    rows = _input(spark, d).select(F.lit(1).alias("sample"), "event_id", "t", F.col("x").alias("k"), (F.col("kind") + 0.5).cast("double").alias("v"))
    return rec.wkv(rows, -0.5, 0.3, hot_rows=0).select("event_id", F.round("y", 6).alias("y"))


@query(
    f"""WITH {EVENTS_SQL}, s AS (SELECT event_id, (x = 0)::INT AS a, p AS b, row_number() OVER (ORDER BY t, event_id) AS i FROM ev)
SELECT u.event_id, round(sum(w.a * pow(1 - 1 / 4.3::DOUBLE, u.i - w.i)), 6) AS tr_pre, round(sum(w.b * pow(1 - 1 / 7.9::DOUBLE, u.i - w.i)), 6) AS tr_post FROM s u JOIN s w ON w.i BETWEEN u.i - 300 AND u.i GROUP BY u.event_id"""
)
def timing_traces_one_key(spark, d):
    """All events as one key, in blocks. In the SQL, spikes more than 300 steps old (under 1e-17) are left out."""
    rows = _input(spark, d).select(F.lit(1).alias("sample"), "event_id", "t", "p", (F.col("kind") == 0).cast("int").alias("a"))
    return rec.traces(rows, 4.3, 7.9, "a", "p", hot_rows=0).select("event_id", *[F.round(c, 6).alias(c) for c in ("tr_pre", "tr_post")])


@query(
    f"""WITH RECURSIVE {EVENTS_SQL},
r AS (SELECT sample, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0.0::DOUBLE AS c FROM (SELECT DISTINCT sample FROM ev) UNION ALL
  SELECT e.sample, e.i, e.event_id, r.c - (1 - e.p) * r.c / 20 + e.p FROM r JOIN ev e ON e.sample = r.sample AND e.i = r.i + 1)
SELECT event_id, round(c, 6) AS current FROM r WHERE i > 0"""
)
def synapse_filter(spark, d):
    return rec.synapse(_input(spark, d), 20.0, "p").select("event_id", F.round("current", 6).alias("current"))


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, inp AS (SELECT sample, event_id, i, (x = 0)::INT AS a, p AS b FROM ev),
r AS (SELECT sample, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.5::DOUBLE AS w FROM (SELECT DISTINCT sample FROM inp) UNION ALL
  SELECT e.sample, e.i, e.event_id, r.x + (-r.x / 4 + e.a), r.y + (-r.y / 8 + e.b), r.w + ((1 - r.w) * e.a + r.w * -0.1::DOUBLE * e.b) * 0.1::DOUBLE FROM r JOIN inp e ON e.sample = r.sample AND e.i = r.i + 1)
SELECT event_id, round(x, 6) AS tr_pre, round(y, 6) AS tr_post, round(w, 6) AS weight FROM r WHERE i > 0"""
)
def timing_traces(spark, d):
    rows = _input(spark, d).withColumn("a", (F.col("kind") == 0).cast("int"))
    out = rec.traces(rows, 4.0, 8.0, "a", "p", (1.0, -1.0), (0.0, -0.1))
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("tr_pre", "tr_post", "weight")])


@query(
    f"""WITH RECURSIVE {EVENTS_SQL},
r AS (SELECT sample, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0.0::DOUBLE AS tr, 0.0::DOUBLE AS o FROM (SELECT DISTINCT sample FROM ev) UNION ALL
  SELECT sample, i, event_id, z, p - 0.1::DOUBLE * z FROM (SELECT e.sample, e.i, e.event_id, e.p, 0.9::DOUBLE * r.tr + {(1 - 0.9) / 25}::DOUBLE * (e.p + e.x) AS z FROM r JOIN ev e ON e.sample = r.sample AND e.i = r.i + 1))
SELECT event_id, round(o, 6) AS norm_out FROM r WHERE i > 0"""
)
def channel_normalised(spark, d):
    rows = _input(spark, d).withColumn("total", F.col("p") + F.col("kind"))
    return rec.normalised(rows, 0.9, 0.1, 5, "p").select("event_id", F.round("norm_out", 6).alias("norm_out"))


def _vectors(spark, d):
    return _input(spark, d).withColumn("xs", F.array("x", F.col("p").cast("double")))


W_IN, W_HID, BIAS = np.array([[1.0, -0.5], [-0.75, 1.25]]), np.array([[0.5, -0.25], [0.25, 0.5]]), np.array([-0.5, 0.125])

_VANILLA = """CASE WHEN 1.0 * e.x - 0.5 * e.p + (0.5 * r.a - 0.25 * r.b) - 0.5 >= 0 THEN 1 ELSE 0 END, CASE WHEN -0.75 * e.x + 1.25 * e.p + (0.25 * r.a + 0.5 * r.b) + 0.125 >= 0 THEN 1 ELSE 0 END"""


def _cell_sql(order: str) -> str:
    return f"""SELECT sample, event_id, value / 100 AS x, p, row_number() OVER (PARTITION BY sample ORDER BY {order}) AS i FROM ev"""


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, inp AS ({_cell_sql('t, event_id')}),
r AS (SELECT sample, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0 AS a, 0 AS b FROM (SELECT DISTINCT sample FROM inp) UNION ALL SELECT e.sample, e.i, e.event_id, {_VANILLA} FROM r JOIN inp e ON e.sample = r.sample AND e.i = r.i + 1)
SELECT event_id, a AS h0, b AS h1 FROM r WHERE i > 0"""
)
def cell_vanilla(spark, d):
    out = rec.vanilla_cell(_vectors(spark, d), W_IN, W_HID, BIAS)
    return out.select("event_id", F.col("hs")[0].cast("int").alias("h0"), F.col("hs")[1].cast("int").alias("h1"))


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, inp AS ({_cell_sql('t, event_id')}), inp2 AS ({_cell_sql('t DESC, event_id DESC')}),
r AS (SELECT sample, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0 AS a, 0 AS b FROM (SELECT DISTINCT sample FROM inp) UNION ALL SELECT e.sample, e.i, e.event_id, {_VANILLA} FROM r JOIN inp e ON e.sample = r.sample AND e.i = r.i + 1),
q AS (SELECT sample, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0 AS a, 0 AS b FROM (SELECT DISTINCT sample FROM inp2) UNION ALL SELECT e.sample, e.i, e.event_id, {_VANILLA.replace('r.', 'q.')} FROM q JOIN inp2 e ON e.sample = q.sample AND e.i = q.i + 1)
SELECT r.event_id, r.a AS h0, r.b AS h1, q.a AS g0, q.b AS g1 FROM r JOIN q USING (event_id) WHERE r.i > 0"""
)
def cell_bidirectional(spark, d):
    out = rec.bidirectional(_vectors(spark, d), rec.vanilla_cell, w_in=W_IN, w_hid=W_HID, bias=BIAS)
    part = lambda c, k: F.col(c)[k].cast("int")
    return out.select("event_id", part("hs", 0).alias("h0"), part("hs", 1).alias("h1"), part("hs_back", 0).alias("g0"), part("hs_back", 1).alias("g1"))


_ONE = np.array([[0.5], [0.25], [-0.5], [0.75]])
_FOUR = np.array([[1.0, -0.5], [0.5, 0.5], [-0.75, 1.0], [1.25, 0.25]])
_B4 = np.array([-0.25, 0.125, 0.25, -0.5])


def _gate(k: int, rows: np.ndarray, hid: np.ndarray, bias: np.ndarray, scale: str = "1") -> str:
    return f"(CASE WHEN {rows[k, 0]} * e.x + {rows[k, 1]} * e.p + {bias[k]} + {scale} * {hid[k, 0]} * r.h >= 0 THEN 1 ELSE 0 END)"


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, inp AS ({_cell_sql('t, event_id')}),
r AS (SELECT sample, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0 AS h, 0 AS c FROM (SELECT DISTINCT sample FROM inp) UNION ALL
  SELECT sample, i, event_id, (c * gf + gi * gg) * go, c * gf + gi * gg FROM (SELECT e.sample, e.i, e.event_id, r.c, {_gate(0, _FOUR, _ONE, _B4)} AS gi, {_gate(1, _FOUR, _ONE, _B4)} AS gf, {_gate(2, _FOUR, _ONE, _B4)} AS gg, {_gate(3, _FOUR, _ONE, _B4)} AS go
  FROM r JOIN inp e ON e.sample = r.sample AND e.i = r.i + 1))
SELECT event_id, h FROM r WHERE i > 0"""
)
def cell_lstm(spark, d):
    return rec.lstm_cell(_vectors(spark, d), _FOUR, _ONE, _B4).select("event_id", F.col("hs")[0].cast("int").alias("h"))


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, inp AS ({_cell_sql('t, event_id')}),
r AS (SELECT sample, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0 AS h FROM (SELECT DISTINCT sample FROM inp) UNION ALL
  SELECT sample, i, event_id, CASE WHEN z = 1 THEN h ELSE n END FROM (SELECT e.sample, e.i, e.event_id, r.h, {_gate(1, _FOUR, _ONE, _B4)} AS z, {_gate(2, _FOUR, _ONE, _B4, _gate(0, _FOUR, _ONE, _B4))} AS n
  FROM r JOIN inp e ON e.sample = r.sample AND e.i = r.i + 1))
SELECT event_id, h FROM r WHERE i > 0"""
)
def cell_gru(spark, d):
    return rec.gru_cell(_vectors(spark, d), _FOUR[:3], _ONE[:3], _B4[:3]).select("event_id", F.col("hs")[0].cast("int").alias("h"))


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, inp AS ({_cell_sql('t, event_id')}),
r AS (SELECT sample, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0.0::DOUBLE AS v, 0 AS s FROM (SELECT DISTINCT sample FROM inp) UNION ALL
  SELECT sample, i, event_id, CASE WHEN h >= 1 THEN 0.0 ELSE h END, CASE WHEN h >= 1 THEN 1 ELSE 0 END FROM (SELECT e.sample, e.i, e.event_id, r.v + ((e.x + r.s) - r.v) / 2.3::DOUBLE AS h FROM r JOIN inp e ON e.sample = r.sample AND e.i = r.i + 1))
SELECT event_id, s AS spike FROM r WHERE i > 0"""
)
def recurrent_elementwise(spark, d):
    return rec.feedback(_input(spark, d), lambda x, y: x + y, rec.leaky(2.3)).select("event_id", "spike")


_LW, _LB = np.array([[0.5, 0.25, 0.5, -0.25], [0.75, -0.5, 0.25, 0.5]]), np.array([0.25, 0.5])


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, inp AS ({_cell_sql('t, event_id')}),
r AS (SELECT sample, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, 0 AS a, 0 AS b FROM (SELECT DISTINCT sample FROM inp) UNION ALL
  SELECT sample, i, event_id, CASE WHEN g >= 1 THEN 0.0 ELSE g END, CASE WHEN h >= 1 THEN 0.0 ELSE h END, CASE WHEN g >= 1 THEN 1 ELSE 0 END, CASE WHEN h >= 1 THEN 1 ELSE 0 END FROM
  (SELECT e.sample, e.i, e.event_id, r.u + (0.5 * e.x + 0.25 * e.p + 0.5 * r.a - 0.25 * r.b + 0.25) AS g, r.v + (0.75 * e.x - 0.5 * e.p + 0.25 * r.a + 0.5 * r.b + 0.5) AS h FROM r JOIN inp e ON e.sample = r.sample AND e.i = r.i + 1))
SELECT event_id, a AS y0, b AS y1 FROM r WHERE i > 0"""
)
def recurrent_linear(spark, d):
    out = rec.linear_feedback(_vectors(spark, d), _LW, _LB, rec.integrate())
    return out.select("event_id", F.col("ys")[0].cast("int").alias("y0"), F.col("ys")[1].cast("int").alias("y1"))


@query(
    """WITH RECURSIVE b AS (SELECT o_orderpriority AS sample, date_diff('month', DATE '1970-01-01', o_orderdate::DATE) AS m, max(o_totalprice) AS scale FROM orders GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY m) AS i FROM b),
r AS (SELECT sample, i, m, scale AS e FROM n WHERE i = 1 UNION ALL SELECT n.sample, n.i, n.m, (1 - 0.1::DOUBLE) * r.e + 0.1::DOUBLE * n.scale FROM r JOIN n ON n.sample = r.sample AND n.i = r.i + 1)
SELECT sample, m, round(e, 4) AS ema FROM r"""
)
def scale_average(spark, d):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    from ..operators.metrics import activation_scale
    from ..sources.tables import table

    orders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("sample"), ((F.year("o_orderdate") - 1970) * 12 + F.month("o_orderdate") - 1).cast("bigint").alias("m"), "o_totalprice")
    return rec.ema(activation_scale(orders, ["sample", "m"], "o_totalprice"), order=("m",)).select("sample", "m", F.round("ema", 4).alias("ema"))


@query(
    f"""WITH s AS (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seen, sum(n_chars) OVER ()::DOUBLE AS total FROM documents)
SELECT doc_id, seen, round(0.0006::DOUBLE * CASE WHEN seen < total / 5 THEN {0.00001 / 0.0006}::DOUBLE + {1 - 0.00001 / 0.0006}::DOUBLE * seen / (total / 5)
ELSE {0.5 + 0.00001 / 0.0006 / 2}::DOUBLE + {0.5 - 0.00001 / 0.0006 / 2}::DOUBLE * cos({math.pi}::DOUBLE * (seen - total / 5) / (total * 4 / 5)) END, 12) AS lr FROM s"""
)
def learning_rate(spark, d):
    """The rate at which each document is met: warm-up over a fifth of all characters, then the cosine to their end."""
    from ..operators.corpus import running_offsets
    from ..sources.tables import table

    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    total = float(docs.agg(F.sum("n_chars")).first()[0] or 1)
    seen = running_offsets(docs, "doc_id", "n_chars", "seen")
    return seen.select("doc_id", "seen", F.round(rec.learning_rate(F.col("seen"), total / 5, total, 0.0006, 0.00001), 12).alias("lr"))
