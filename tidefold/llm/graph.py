"""Connected components of a distributed edge list, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of long ids -> (node, component): component is the smallest id reachable from node.

    Each round sends every vertex to its smallest neighbour (or itself) and contracts the edges along. The first round compares
    ids, which finishes groups whose links all lead to their smallest id; later rounds compare ids hashed with the round, so any chain
    shrinks by a constant factor. A vertex with very many edges is pre-aggregated in its groupBy, and its join may be split by the
    adaptive skew join. Each round is a stored table: the lineage stays short and nothing is collected but the counts of rows.
    """
    spark = edges.sparkSession
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    cur = stored(spark, edges.where("a <> b").select(*pair(F.col("a"), F.col("b"))).distinct(), "edges")
    maps: list[DataFrame] = []
    while not cur.isEmpty():
        k = len(maps)
        order = (lambda c: F.struct(F.lit(0).cast("long").alias("h"), c.alias("id"))) if k == 0 else (lambda c, k=k: F.struct(F.xxhash64(F.lit(k), c).alias("h"), c.alias("id")))
        ends = cur.select(F.col("a").alias("u"), order(F.col("b")).alias("v")).union(cur.select(F.col("b"), order(F.col("a"))))
        to = stored(spark, ends.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("v", order(F.col("u")))["id"].alias("t")), "contract")
        maps.append(to)
        first, second = to.select(F.col("u").alias("a"), F.col("t").alias("ta")), to.select(F.col("u").alias("b"), F.col("t").alias("tb"))
        moved = cur.join(first, "a").join(second, "b").where("ta <> tb").select(*pair(F.col("ta"), F.col("tb"))).distinct()
        nxt = stored(spark, moved, "edges")
        discard(cur)
        cur = nxt
    if not maps:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = maps[0].select(F.col("u").alias("node"), F.col("t").alias("label"))
    for to in maps[1:]:
        labels = labels.join(to.select(F.col("u").alias("label"), "t"), "label", "left").select("node", F.coalesce("t", "label").alias("label"))
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
