"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

Filters are directions c = (c1, .., cm): the vector space is cut into m blocks, each with CODE random unit
vectors, and every combination of one from each block is a filter. A vector belongs to all filters whose
inner product with it exceeds the cap's height. List decoding finds them block by block: a prefix of the
combination goes on only while the best that the other blocks can add reaches the height. Vectors of one
label that share a filter are compared exactly in double precision.

Equal vectors are one class. A large bucket is compared block against block in many tasks, as matrix products; no pairs are
emitted. A pair in several common buckets counts in the first of its common filters only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .neardup import components_sql
from .runtime import ship, stored

COSINE = 0.98
#: Blocks, code vectors of a block, the cap's height in standard deviations of an inner product with a random filter, and how far below
#: its best filter a vector's own height is at least, so that a vector far from all filters still shares some with its neighbours.
BLOCKS, CODE, HEIGHT, MARGIN = 3, 20, 3.2, 0.4
#: Vectors of a bucket that one task compares with as many others.
SIDE = 256


class Filters:
    def __init__(self, dim: int, blocks: int = BLOCKS, code: int = CODE, height: float = HEIGHT, margin: float = MARGIN, seed: int = 3):
        if code**blocks > 1 << 16:
            raise ValueError("more filters than 16-bit numbers")
        rng = np.random.default_rng([seed, dim])
        blocks = min(blocks, dim)
        self.parts = [p for p in np.array_split(np.arange(dim), blocks) if len(p)]
        self.books = []
        for p in self.parts:
            c = rng.normal(size=(code, len(p)))
            self.books.append(c / np.linalg.norm(c, axis=1, keepdims=True) * np.sqrt(len(p) / dim))
        self.code, self.height, self.margin = code, height / np.sqrt(dim), margin / np.sqrt(dim)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that rows of unit exceed."""
        scores = [unit[:, p] @ b.T for p, b in zip(self.parts, self.books, strict=True)]
        ahead = [np.zeros(len(unit))]  # the most that later blocks can add
        for s in reversed(scores[1:]):
            ahead.append(ahead[-1] + s.max(1))
        ahead = ahead[::-1]
        height = np.minimum(self.height, ahead[0] + scores[0].max(1) - self.margin)
        row, total, name = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), np.int64)
        for s, rest in zip(scores, ahead, strict=True):
            sums = total[:, None] + s[row]
            at, c = np.nonzero(sums + rest[row][:, None] >= height[row][:, None])
            row, total, name = row[at], sums[at, c], name[at] * self.code + c
        return row, name


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles from vectors of one dimension, each kept as 32-bit floats where these hold it exactly, else as doubles."""
    raw = column.to_pylist()
    short = np.fromiter((len(v) == 4 * dim for v in raw), bool, len(raw))
    out = np.empty((len(raw), dim))
    for at, kind in ((np.flatnonzero(short), "<f4"), (np.flatnonzero(~short), "<f8")):
        if len(at):
            out[at] = np.frombuffer(b"".join([raw[k] for k in at.tolist()]), kind).reshape(-1, dim)
    return out


def _classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, d1, d2, x): d1, d2 digest the vector, x is its bytes; null where it links with nothing."""

    def run(batches):
        for b in batches:
            col = b.column(1)
            ends = np.cumsum([n or 0 for n in col.value_lengths().to_pylist()])
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # null parts are not numbers; -0 is 0
            with np.errstate(over="ignore", invalid="ignore"):
                exact = flat.astype("<f4").astype(np.float64) == flat
            d1, d2, unit = [], [], []
            for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
                a = flat[start:end]
                ok = end > start and np.isfinite(a).all() and a.any()
                d = np.frombuffer(xxhash.xxh3_128_digest(a.tobytes()), "<i8").tolist() if ok else [None, None]
                d1.append(d[0]), d2.append(d[1]), unit.append((a.astype("<f4") if exact[start:end].all() else a).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(np.diff(ends, prepend=0), pa.int32()), pa.array(unit, pa.binary())], names=["id", "label", "d1", "d2", "dim", "x"])

    label = vectors.schema[label_col].dataType.simpleString()
    chosen = vectors.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>"), label_col)
    return chosen.mapInArrow(run, f"id bigint, label {label}, d1 bigint, d2 bigint, dim int, x binary")


def _unit(a: np.ndarray) -> np.ndarray:
    top = np.abs(a).max(1, keepdims=True)
    return a / np.linalg.norm(a / top, axis=1, keepdims=True) / top


def _before(filters: list[np.ndarray], here: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of the filters that come before `here`; filters are sorted."""
    row, name = np.repeat(np.arange(len(filters)), [len(f) for f in filters]), np.concatenate(filters)
    low = name < here
    return row[low], name[low]


def _meets_before(fa: list[np.ndarray], fb: list[np.ndarray], here: int) -> np.ndarray:
    """Whether each row of a shares with each of b a filter that comes before `here`."""
    (ra, na), (rb, nb) = _before(fa, here), _before(fb, here)
    names = np.intersect1d(na, nb)
    a, b = np.zeros((len(fa), len(names)), np.float32), np.zeros((len(fb), len(names)), np.float32)
    for m, row, name in ((a, ra, na), (b, rb, nb)):
        at = np.searchsorted(names, name)
        ok = at < len(names)
        ok[ok] = names[at[ok]] == name[ok]
        m[row[ok], at[ok]] = 1
    return a @ b.T > 0


def _compare(group: pa.Table) -> pa.Table:
    """Links between side a and side b of one (label, filter, block, block) group: partial link counts, and a spanning set of links."""
    group = group.combine_chunks()
    rep, d1, d2, size, side = (group.column(c).to_numpy() for c in ("rep", "d1", "d2", "size", "side"))
    filters, here, dim = [np.frombuffer(f, "<u2") for f in group.column("filters").to_pylist()], group.column("filter")[0].as_py(), group.column("dim")[0].as_py()
    unit = _unit(_matrix(group.column("x"), dim))
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    own = group.column("i")[0].as_py() == group.column("j")[0].as_py()  # a block against itself; else either side may be empty
    b = a if own else b
    hit = unit[a] @ unit[b].T >= COSINE
    if own:
        hit = np.triu(hit, 1)
    i, j = np.nonzero(hit)
    links = np.zeros(len(rep), np.int64)
    if len(i):
        first = hit & ~_meets_before([filters[k] for k in a], [filters[k] for k in b], here)
        links[a] += first @ size[b]
        links[b] += size[a] @ first
    root = np.arange(len(rep))
    ai, bj = a[i], b[j]
    while len(i):
        was = root.copy()
        low = np.minimum(root[ai], root[bj])
        np.minimum.at(root, ai, low)
        np.minimum.at(root, bj, low)
        root = root[root]
        if (root == was).all():
            break
    out = np.flatnonzero((links > 0) | (root != np.arange(len(rep))))
    return pa.table({"label": group.column("label").take(pa.array(out)), "d1": d1[out], "d2": d2[out], "rep": pa.array(rep[out], pa.int64()), "links": pa.array(links[out], pa.int64()), "to": pa.array(rep[root[out]], pa.int64())})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links (other rows linked directly), component_id, kept.

    Vectors of equal, non-null label and equal length are linked at a cosine of COSINE or more. A vector that is null, empty, zero, or holds null or non-finite
    parts, and one with a null label, links with nothing: no links, a component of its own. Rows that repeat an id with equal vectors are linked copies; with
    other vectors each row counts its own links, and the component is shared: the id joins what its rows link to. A row without id takes no part and is kept.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(spark, _classes(vectors, id_col, vec_col, label_col), "vectors")
    live = rows.where("id is not null and label is not null and d1 is not null")
    key = ["label", "d1", "d2"]
    classes = stored(spark, live.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("dim").alias("dim"), F.first("x").alias("x")), "classes")

    def caps(batches):
        made: dict[int, Filters] = {}
        for b in batches:
            dims = b.column(b.schema.get_field_index("dim")).to_numpy()
            for dim in sorted(set(dims.tolist())):
                at = np.flatnonzero(dims == dim)
                part = b.take(pa.array(at))
                f = made.setdefault(dim, Filters(dim))
                row, name = f.decode(_unit(_matrix(part.column(part.schema.get_field_index("x")), dim)))
                order = np.lexsort((name, row))
                lists = np.split(name[order].astype("<u2"), np.cumsum(np.bincount(row, minlength=len(at)))[:-1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([v.tobytes() for v in lists], pa.binary()), pa.array([v.tolist() for v in lists], pa.list_(pa.int32()))], names=[*part.schema.names, "filters", "names"])

    label = rows.schema["label"].dataType.simpleString()
    capped = stored(spark, classes.mapInArrow(caps, f"label {label}, d1 bigint, d2 bigint, rep bigint, size bigint, dim int, x binary, filters binary, names array<int>"), "caps")
    counts = capped.select("label", "dim", F.explode("names").alias("filter")).groupBy("label", "dim", "filter").agg(F.count("*").alias("n")).where("n > 1")
    counts = counts.select(F.col("label").alias("c_label"), F.col("dim").alias("c_dim"), F.col("filter").alias("c_filter"), F.ceil(F.col("n") / SIDE).cast("int").alias("blocks"))
    # the places are found on names alone; vectors join their tasks afterwards, once for each
    inside = capped.select("label", "dim", *key[1:], F.explode("names").alias("filter"))
    placed = inside.join(counts, (F.col("label") == F.col("c_label")) & (F.col("dim") == F.col("c_dim")) & (F.col("filter") == F.col("c_filter")))
    placed = placed.groupBy(*key).agg(F.collect_list(F.struct("filter", "blocks", F.pmod(F.xxhash64(*key), F.col("blocks")).cast("int").alias("block"))).alias("at"))
    # each block meets itself and every other once
    meets = lambda p: F.transform(F.sequence(F.lit(0), p["blocks"] - 1), lambda k: F.struct(p["filter"].alias("filter"), F.least(p["block"], k).alias("i"), F.greatest(p["block"], k).alias("j"), (p["block"] > k).cast("int").alias("side")))
    tasks = capped.drop("names").join(placed, key).select(*[c for c in capped.columns if c != "names"], F.explode(F.flatten(F.transform("at", meets))).alias("m")).select("*", "m.*").drop("m")
    found = tasks.groupBy("label", "dim", "filter", "i", "j").applyInArrow(_compare, f"label {label}, d1 bigint, d2 bigint, rep bigint, links bigint, to bigint")
    found = stored(spark, found, "found")

    links = found.groupBy(*key).agg(F.sum("links").alias("links"))
    edges = found.select(F.col("rep").alias("a"), F.col("to").alias("b"))
    # an id with several vectors joins their classes
    several = live.groupBy("id").agg(F.count_distinct(*key).alias("n")).where("n > 1").select("id")
    several = stored(spark, live.join(several, "id", "left_semi").select("id", *key).distinct(), "several")
    if not several.isEmpty():
        edges = edges.union(several.join(classes.select(*key, "rep"), key).select("rep", "id"))
    comps = components(edges)
    per_class = classes.select(*key, "rep", "size").join(links, key, "left").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    per_class = per_class.select(*key, (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    # stored, so that the join with the rows stands alone: copies of one vector may be split between tasks
    per_class = stored(spark, per_class, "linked")
    out = rows.select("id", *key).join(per_class, key, "left")
    out = out.select(F.col("id").alias(id_col), F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


#: DuckDB SQL for near_vectors() over the table embeddings, for distinct ids and vectors of one length: all pairs of a label.
NEAR_VECTORS_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT id, label, x, sqrt(list_inner_product(x, x)) AS n FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
links AS (SELECT a.id AS x, b.id AS y FROM u a JOIN u b ON a.label = b.label AND a.id <> b.id WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.x, b.x) / a.n / b.n >= {COSINE}),
k AS (SELECT x AS id, count(*) AS n FROM links GROUP BY x),
{components_sql("v")}
SELECT v.id AS vec_id, coalesce(k.n, 0) AS n_links, component_id, v.id = component_id AS kept FROM v JOIN component USING (id) LEFT JOIN k USING (id)
"""
