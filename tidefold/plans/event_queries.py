"""Queries on the event stream: frames, histograms, clusters, joins, splits, streaming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import frames as fr
from ..operators import lookups, sampling
from ..sources.tables import EVENTS_SQL, events, table
from ..streaming import streams
from .registry import query

M = 8
HOUR6 = 6 * 3_600_000_000
EV = f"WITH {EVENTS_SQL}"
W2_SQL = f"""{EV}, b AS (SELECT sample, min(t) AS a, (max(t) - min(t)) // {M} AS d FROM ev GROUP BY sample),
f AS (SELECT ev.*, CASE WHEN d = 0 THEN {M - 1} ELSE least((t - a) // d, {M - 1}) END AS frame FROM ev JOIN b USING (sample))"""
W1_SQL = f"""{EV}, c AS (SELECT sample, count(*) AS n FROM ev GROUP BY sample),
f AS (SELECT ev.*, CASE WHEN n < {M} THEN {M - 1} ELSE least((i - 1) // greatest(n // {M}, 1), {M - 1}) END AS frame FROM ev JOIN c USING (sample))"""
HIST = "SELECT sample, frame::INT AS frame, p AS channel, y, x, count(*) AS n FROM f GROUP BY ALL"


@query(f"{W2_SQL} {HIST}")
def frames_equal_time(spark, d):
    return fr.histogram(fr.equal_time(events(spark, d), M))


@query(f"{W1_SQL} {HIST}")
def frames_equal_count(spark, d):
    return fr.histogram(fr.equal_count(events(spark, d), M))


@query(
    f"""{W2_SQL}, s AS (SELECT DISTINCT sample FROM ev), g AS (SELECT sample, unnest(range({M})) AS frame FROM s)
SELECT g.sample, g.frame::INT AS frame, count(f.event_id) AS n FROM g LEFT JOIN f ON f.sample = g.sample AND f.frame = g.frame GROUP BY ALL"""
)
def frames_dense(spark, d):
    return fr.dense(fr.histogram(fr.equal_time(events(spark, d), M)), M)


@query(
    f"""WITH RECURSIVE {EVENTS_SQL},
r AS (SELECT sample, i, event_id, t, t AS opened, 0 AS frame FROM ev WHERE i = 1 UNION ALL
  SELECT e.sample, e.i, e.event_id, e.t, CASE WHEN e.t - r.opened > {HOUR6} THEN e.t ELSE r.opened END, CASE WHEN e.t - r.opened > {HOUR6} THEN r.frame + 1 ELSE r.frame END
  FROM r JOIN ev e ON e.sample = r.sample AND e.i = r.i + 1)
SELECT sample, event_id, frame FROM r"""
)
def frames_anchored(spark, d):
    return fr.anchored(events(spark, d), HOUR6).select("sample", "event_id", "frame")


@query(
    f"""WITH RECURSIVE {EVENTS_SQL},
r AS (SELECT min(t) AS a, 0 AS frame FROM ev UNION ALL SELECT (SELECT min(t) FROM ev WHERE t > r.a + {HOUR6}), r.frame + 1 FROM r WHERE (SELECT max(t) FROM ev) > r.a + {HOUR6})
SELECT event_id, frame FROM ev ASOF JOIN r ON ev.t >= r.a"""
)
def frames_anchored_one_sample(spark, d):
    """All events as one sample, framed in ranges."""
    return fr.anchored(events(spark, d).withColumn("sample", F.lit(1)), HOUR6, hot_rows=0).select("event_id", "frame")


@query(f"{EV} SELECT sample, (x * 2 + p)::INT AS cell, count(*) AS n FROM ev GROUP BY ALL")
def frames_custom(spark, d):
    def integrate(rows: pd.DataFrame) -> pd.DataFrame:
        cells = (rows["x"] * 2 + rows["p"]).value_counts()
        return pd.DataFrame({"sample": rows["sample"].iloc[0], "cell": cells.index.astype("int32"), "n": cells.to_numpy()})

    return fr.custom(events(spark, d), integrate, "sample bigint, cell int, n bigint")


@query(
    f"""{EV}, k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY {sampling.uniform_sql(3, 'event_id')}, event_id) AS r FROM ev)
SELECT sample, event_id, row_number() OVER (PARTITION BY sample ORDER BY t, event_id) - 1 AS pos FROM k WHERE r <= 20"""
)
def temporal_delete(spark, d):
    return fr.temporal_delete(events(spark, d), 20, 3).select("sample", "event_id", F.col("pos").cast("bigint").alias("pos"))


@query(
    f"""{EV}, s AS (SELECT *, sum(p) OVER w AS c FROM ev WINDOW w AS (PARTITION BY sample ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))
SELECT sample, event_id, (sum(c) OVER (PARTITION BY sample ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) = 1)::INT AS first FROM s"""
)
def first_spike(spark, d):
    return fr.first_spike(events(spark, d), "p").select("sample", "event_id", "first")


CLUSTERS = f"""{EV}, g AS (SELECT sample, t, CASE WHEN t - lag(t) OVER (PARTITION BY sample ORDER BY t) > {HOUR6} THEN 1 ELSE 0 END AS new FROM ev WHERE p = 1),
h AS (SELECT sample, t, sum(new) OVER (PARTITION BY sample ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g),
c AS (SELECT sample, cluster, min(t) AS first, max(t) AS last, count(*) AS n FROM h GROUP BY sample, cluster)"""


@query(f"{CLUSTERS} SELECT * FROM c")
def spike_clusters(spark, d):
    return fr.spike_clusters(events(spark, d), "p", HOUR6)


@query(
    f"""{CLUSTERS}, o AS (SELECT ev.sample, ev.t, ev.value FROM ev WHERE value < 50 AND NOT EXISTS (SELECT 1 FROM c WHERE c.sample = ev.sample AND ev.t BETWEEN c.first AND c.last)),
k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value DESC, t) AS r FROM o),
m AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n, last) AS r FROM c)
SELECT coalesce(k.sample, m.sample) AS sample, k.t AS peak_t, k.value AS peak_v, m.last AS smallest_end FROM (SELECT * FROM k WHERE r = 1) k FULL JOIN (SELECT * FROM m WHERE r = 1) m ON k.sample = m.sample"""
)
def spike_cluster_peak(spark, d):
    ev = events(spark, d)
    return fr.peak_outside_clusters(ev, fr.spike_clusters(ev, "p", HOUR6), "value", 50.0)


INTERVALS = f"""{EV}, l AS (SELECT sample, t AS s, coalesce(lead(t) OVER (PARTITION BY sample ORDER BY t, event_id), t + {HOUR6}) AS e, x AS label FROM ev WHERE x IN (2, 3))"""


def _intervals(ev):
    from pyspark.sql import Window

    w = Window.partitionBy("sample").orderBy("t", "event_id")
    chosen = ev.where("x in (2, 3)")
    return chosen.select("sample", F.col("t").alias("s"), F.coalesce(F.lead("t").over(w), F.col("t") + HOUR6).alias("e"), F.col("x").alias("label"))


@query(
    f"""{INTERVALS} SELECT ev.sample, ev.event_id, l.label, row_number() OVER (PARTITION BY ev.sample, l.label ORDER BY ev.t, ev.event_id) - 1 AS k
FROM ev JOIN l ON ev.sample = l.sample AND ev.t >= l.s AND ev.t < l.e"""
)
def interval_join(spark, d):
    ev = events(spark, d)
    found = lookups.interval_join(ev, _intervals(ev), "sample", "t", "s", "e", width=24 * 3_600_000_000)
    return lookups.number_within(found, ["sample", "label"], ["t", "event_id"]).select("sample", "event_id", "label", F.col("k").cast("bigint").alias("k"))


@query(f"{EV} SELECT event_id, 127 - y AS x, 127 - x AS y, 1 - p AS p FROM ev")
def pixel_swap(spark, d):
    return events(spark, d).select("event_id", (127 - F.col("y")).alias("x2"), (127 - F.col("x")).alias("y2"), (1 - F.col("p")).alias("p2")).toDF("event_id", "x", "y", "p")


@query(f"{EV} SELECT event_id, t, p FROM ev WHERE p = 1 UNION ALL SELECT event_id, t, p FROM ev WHERE p = 0")
def tagged_stack(spark, d):
    ev = events(spark, d)
    tag = lambda v: ev.where(F.col("p") == v).select("event_id", "t", F.lit(v).alias("p"))
    return tag(1).unionByName(tag(0))


@query(f"{EV} SELECT sample, event_id, row_number() OVER (PARTITION BY sample ORDER BY t, event_id) AS k FROM ev")
def sort_events(spark, d):
    return lookups.number_within(events(spark, d), ["sample"], ["t", "event_id"]).select("sample", "event_id", (F.col("k") + 1).cast("bigint").alias("k"))


@query("SELECT event_type, count(*) AS n, date_trunc('day', ts)::TIMESTAMP AS start, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    # complete mode keeps every window: the counts of all rows, whatever order the files came in
    stream = streams.event_stream(spark, d)
    counts = stream.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = streams.run_once(counts.select(F.col("w.start").alias("start"), "event_type", "n", "total"), "complete")
    return out.select("event_type", "n", F.col("start").cast("timestamp_ntz").alias("start"), F.round("total", 4).alias("total"))


_KEYED = f"""WITH RECURSIVE {EVENTS_SQL},
r AS (SELECT sample, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0 AS spike, 0.0::DOUBLE AS v FROM (SELECT DISTINCT sample FROM ev) UNION ALL
  SELECT sample, i, event_id, CASE WHEN h >= 1 THEN 1 ELSE 0 END, CASE WHEN h >= 1 THEN 0.0 ELSE h END FROM
  (SELECT e.sample, e.i, e.event_id, r.v + (e.value / 100 - r.v) / 2.3::DOUBLE AS h FROM r JOIN ev e ON e.sample = r.sample AND e.i = r.i + 1))
SELECT sample AS user_id, event_id, spike, round(v, 6) AS v FROM r WHERE i > 0"""


@query(_KEYED)
def stream_keyed_neuron(spark, d):
    return streams.run_once(streams.keyed_neuron(streams.event_stream(spark, d), 2.3)).select("user_id", "event_id", "spike", F.round("v", 6).alias("v"))


@query(f"SELECT k.* FROM ({_KEYED}) k JOIN events e USING (event_id) WHERE epoch_us(e.ts) < (SELECT epoch_ms(max(ts)) * 1000 - 86400000000 FROM events)")
def stream_ordered_neuron(spark, d):
    """In event time: all rows that the watermark, a day before the last one, has passed."""
    out = streams.run_once(streams.ordered_neuron(streams.event_stream(spark, d), "1 day", 2.3))
    return out.select("user_id", "event_id", "spike", F.round("v", 6).alias("v"))


@query(
    f"""SELECT l_orderkey, l_linenumber, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {sampling.uniform_sql(7, 'l_orderkey * 10 + l_linenumber')}, l_orderkey * 10 + l_linenumber) AS k,
count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE k <= floor(0.05 * n)"""
)
def subset_ratio(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ident"))
    return sampling.subset(rows, 0.05, 7, "l_returnflag", "ident").drop("ident")


@query("SELECT o_orderkey, o_orderpriority, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= ceil(0.8 * count(*) OVER (PARTITION BY o_orderpriority)))::INT AS is_train FROM orders")
def stratified_split(spark, d):
    return sampling.stratified(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), 0.8, "o_orderpriority", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def split_membership(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return lookups.membership(table(spark, d, "customer").select("c_custkey"), orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"), "c_custkey")


@query("SELECT s_suppkey, s_name, n_name AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def dictionary_lookup(spark, d):
    entries = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    return lookups.dictionary(table(spark, d, "supplier"), entries, "s_nationkey", "nation").select("s_suppkey", "s_name", "nation")


@query("SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def file_label_match(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def list_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))
