"""Near-duplicate documents by fast similarity sketching, banding, and exact verification.

Sketch: coordinates are bins. In round i < T each shingle hashes to one bin and a fraction; in
round T + j all shingles go to bin j. A bin keeps the smallest (round, fraction); rounds end when
every bin is filled, which the second half guarantees, and the part of equal coordinates is
concentrated around the Jaccard similarity as with T independent hashes. Bands of ROWS coordinates
make candidates: a pair at the threshold 0.75 is missed by all BANDS bands with probability
(1 - 0.75^ROWS)^BANDS = 2e-6, and less above it.

Texts with equal shingle sets are one class. Members of a bucket are compared with the bucket's
smallest id first. Where they are still in different components, a bucket of at most SMALL members
lists the pairs left; in a larger one, the members outside the smallest id's component meet all
others block by block, as products of incidence matrices, and no pairs are listed. Blocks first meet
with their sizes and a byte of each coordinate: full texts go only to the blocks where some pair's
estimate is not more than DOUBT standard deviations under the threshold (a similar pair fails that with
probability 1e-9). So every candidate pair is either tested on full sets, or already in one component,
or ruled out by its sizes or sketches.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .runtime import ship, spread, stored

SHINGLE, SIMILAR = 5, 75
BANDS, ROWS = 48, 5
T = BANDS * ROWS
#: Members of a bucket whose pairs may be listed; rows of a block in larger ones; shingles of one matrix product.
SMALL, BLOCK, COLUMNS = 24, 192, 8192
#: Standard deviations that the estimate of a pair may lie under the threshold; fewest equal coordinates of T that this leaves.
DOUBT = 6
FEWEST = int(T * SIMILAR / 100 - DOUBT * (T * SIMILAR * (100 - SIMILAR) / 10_000) ** 0.5)
#: Shingles that are sketched, or ordered for a product, at a time.
PORTION = 1 << 18
#: Odd multipliers of the mixers (fixed values).
P_SHINGLE, P_ROUND, P_MIX_A, P_MIX_B, P_BAND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * P_MIX_A
    x = (x ^ (x >> np.uint64(27))) * P_MIX_B
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles: A-Z lower-cased, words between ASCII white space."""
    found = (text or "").encode().lower().split()  # of bytes, both are ASCII only
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    if len(h) < size:
        h = np.array([xxhash.xxh64_intdigest(b"\0".join(found))], np.uint64)
        return _mix(h)
    n = len(h) - size + 1
    x = h[:n].copy()
    for k in range(1, size):
        x = x * P_SHINGLE + h[k : k + n]
    return np.unique(_mix(x))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """One row of T coordinates for each non-empty set."""
    bins = np.full(len(sets) * T, _EMPTY)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    t, low = np.uint64(T), np.uint64(0xFFFFFFFF)
    for i in range(2 * T):
        if not len(items):
            break
        x = _mix(items + np.uint64(int(P_ROUND) * (i + 1) & 0xFFFFFFFFFFFFFFFF))
        at = owner * T + (((x >> np.uint64(32)) * t >> np.uint64(32)).astype(np.int64) if i < T else i - T)
        np.minimum.at(bins, at, np.uint64(i << 32) | (x & low))
        if i < 8 or i % 8 == 0:
            full = (bins.reshape(-1, T) != _EMPTY).all(1)
            if full.any():
                stay = ~full[owner]
                items, owner = items[stay], owner[stay]
    return bins.reshape(-1, T)


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    parts = coordinates.reshape(len(coordinates), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * P_BAND, parts.shape[:2]).copy()
    for k in range(ROWS):
        key = _mix(key * P_SHINGLE + parts[:, :, k])
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= SIMILAR * union, on full sets."""
    if min(len(a), len(b)) * 100 < SIMILAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILAR * (len(a) + len(b) - both)


def _portions(rows: list[int], sizes: list[int]) -> list[list[int]]:
    """rows in order, cut so that no portion of several rows has more than 256 of them or more than PORTION shingles."""
    out: list[list[int]] = [[]]
    held = 0
    for r, n in zip(rows, sizes, strict=True):
        if out[-1] and (len(out[-1]) == 256 or held + n > PORTION):
            out.append([])
            held = 0
        out[-1].append(r)
        held += n
    return out


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for b in batches:
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            some = [k for k, s in enumerate(sets) if len(s)]
            digest: list[tuple[int | None, int | None]] = [(None, None)] * len(sets)
            bands: list[np.ndarray | None] = [None] * len(sets)
            mini: list[bytes | None] = [None] * len(sets)
            for part in _portions(some, [len(sets[k]) for k in some]) if some else ():
                coordinates = sketch([sets[k] for k in part])
                for k, keys, low in zip(part, band_keys(coordinates), coordinates.astype(np.uint8), strict=True):
                    d = np.frombuffer(xxhash.xxh3_128_digest(sets[k].tobytes()), "<i8")
                    digest[k], bands[k], mini[k] = (int(d[0]), int(d[1])), keys, low.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digest], pa.int64()), pa.array([d[1] for d in digest], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(mini, pa.binary())],
                names=["id", "n_shingles", "d1", "d2", "bands", "mini"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, mini binary")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""

    def run(batches):
        for batch in batches:
            last, seen, keep = None, None, []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != last:
                    last, seen = b, shingle_set(tb)
                keep.append(similar(shingle_set(ta), seen))
            m = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(m), batch.column(1).filter(m)], names=["a", "b"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _matches(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether each set of a is similar to each of b, by intersections of all at once."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    sets = [*a, *b]
    both = np.zeros((len(a), len(b)), np.float64)
    # shingles are hashes: equal ranges of them hold about as many each, so memory does not grow with the sets
    ranges = max(1, -(-int(la.sum() + lb.sum()) // PORTION))
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in sets]
    for k in range(ranges):
        parts = [x[c[k] : c[k + 1]] for x, c in zip(sets, cuts, strict=True)]
        _, column, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = times > 1
        place = np.cumsum(shared) - 1
        row = np.repeat(np.arange(len(sets)), [len(x) for x in parts])
        keep = shared[column]
        row, column = row[keep], place[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for start in range(0, int(shared.sum()), COLUMNS):
            x, y = np.searchsorted(column, [start, start + COLUMNS])
            m = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - start)), np.float32)
            m[row[x:y], column[x:y] - start] = 1
            both += m[: len(a)] @ m[len(a) :].T
    return 100 * both >= SIMILAR * (la[:, None] + lb[None] - both)


def _block_links(ids: np.ndarray, label: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between side 0 and side 1, or within side 0 where there is no side 1."""
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if (side == 1).any() else a
    hit = _matches([sets[k] for k in a], [sets[k] for k in b]) & (label[a][:, None] != label[b][None])
    i, j = (x[k] for x, k in zip((a, b), np.nonzero(hit), strict=True))
    root = np.arange(len(ids))
    while len(i):
        was = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == was).all():
            break
    out = np.flatnonzero(root != np.arange(len(ids)))
    return ids[out], ids[root[out]]


def _doubtful(size: np.ndarray, label: np.ndarray, side: np.ndarray, mini: np.ndarray) -> np.ndarray:
    """The rows that, by sizes and sketches, may be similar to one of another label: of side 0 to side 1, or within side 0 where there is no side 1."""
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if (side == 1).any() else a
    equal = np.zeros((len(a), len(b)), np.int16)
    for x, y in zip(mini[a].T, mini[b].T, strict=True):
        equal += x[:, None] == y[None]
    low, high = np.minimum(size[a][:, None], size[b][None]), np.maximum(size[a][:, None], size[b][None])
    hit = (equal >= FEWEST) & (100 * low >= SIMILAR * high) & (label[a][:, None] != label[b][None])
    return np.unique(np.concatenate([a[hit.any(1)], b[hit.any(0)]]))


def _by_task(rows: DataFrame, work: Callable[[tuple, list[tuple]], pa.RecordBatch | None], schema: str) -> DataFrame:
    """work((key, i, j), rows of the task) over rows(key, i, j, ..): one task's rows are held at a time."""
    dealt = rows.repartition(spread(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        held: list[tuple] = []
        now = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:3] != now:
                    if held and (out := work(now, held)) is not None:
                        yield out
                    now, held = row[:3], []
                held.append(row[3:])
        if held and (out := work(now, held)) is not None:
            yield out

    return dealt.mapInArrow(run, schema)


def _blocks(labelled: DataFrame, texts: DataFrame, minis: DataFrame) -> DataFrame:
    """Links in large mixed buckets: members outside the component of the bucket's smallest id (x) against each other and against those in it (d)."""
    home = labelled.where("id = pivot").select("key", F.col("label").alias("home"))
    # stored, so that each join on the bucket stands alone and a large bucket's rows may be split between tasks
    sided = stored(labelled.sparkSession, labelled.join(home, "key").withColumn("x", F.col("label") != F.col("home")), "sided")
    count = lambda c: F.ceil(F.sum(c.cast("int")) / BLOCK).cast("int")
    blocks = stored(labelled.sparkSession, sided.groupBy("key").agg(count(F.col("x")).alias("nx"), count(~F.col("x")).alias("nd")).where("nx > 0"), "blocks")
    placed = sided.join(blocks, "key").select("key", "id", "label", "x", "nx", "nd", F.pmod(F.xxhash64("id"), F.when(F.col("x"), F.col("nx")).otherwise(F.col("nd"))).cast("int").alias("own"))
    task = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    own, nx, nd = F.col("own"), F.col("nx"), F.col("nd")
    # tasks (i, j): i, j < nx two blocks of x; j >= nx a block of x and one of d
    among = F.transform(F.sequence(F.lit(0), nx - 1), lambda k: task(F.least(own, k), F.greatest(own, k), own > k))
    across = F.transform(F.sequence(F.lit(0), nd - 1), lambda k: task(own, nx + k, F.lit(0)))
    of_d = F.transform(F.sequence(F.lit(0), nx - 1), lambda k: task(k, nx + own, F.lit(1)))
    tasks = placed.select("key", "id", "label", F.explode(F.when(F.col("x"), F.when(nd > 0, F.concat(among, across)).otherwise(among)).otherwise(of_d)).alias("m"))
    tasks = tasks.select("key", "m.i", "m.j", "m.side", "id", "label")

    def look(task, rows):
        side, ids, label, size = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        at = _doubtful(size, label, side, np.frombuffer(b"".join([r[4] for r in rows]), np.uint8).reshape(len(rows), T))
        if not len(at):
            return None
        fixed = [pa.array([v] * len(at), t) for v, t in zip(task, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
        return pa.RecordBatch.from_arrays([*fixed, pa.array(side[at].astype(np.int32)), pa.array(ids[at]), pa.array(label[at])], names=["key", "i", "j", "side", "id", "label"])

    def link(task, rows):
        side, ids, label = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        x, y = _block_links(ids, label, side, [shingle_set(r[3]) for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    seen = tasks.join(minis, "id").select("key", "i", "j", "side", "id", "label", "size", "mini")
    doubtful = stored(labelled.sparkSession, _by_task(seen, look, "key bigint, i int, j int, side int, id bigint, label bigint"), "doubtful")
    return _by_task(doubtful.join(texts, "id").select("key", "i", "j", "side", "id", "label", "text"), link, "a bigint, b bigint")


def _freed(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    component_id is the smallest id reachable by links (100 * intersection >= 75 * union of five-word shingle sets, or equal sets);
    kept marks the document that stays for its component. A text of fewer words is one shingle; a null text or one without words links with
    nothing. Rows that repeat an id are one document, for which the text with the smallest set digest is compared; each row keeps its own
    n_shingles. A row without id links with nothing: its component is null and it is kept. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    sk = stored(spark, _sketches(docs, id_col, text_col), "sketch")
    ids = sk.where("id is not null and n_shingles > 0").groupBy("id").agg(F.min(F.struct("d1", "d2")).alias("d")).select("id", "d.d1", "d.d2")
    classes = stored(spark, ids.groupBy("d1", "d2").agg(F.min("id").alias("rep")), "classes")

    # buckets with two members or more
    reps = sk.join(classes.select(F.col("rep").alias("id"), "d1", "d2"), ["id", "d1", "d2"]).dropDuplicates(["id"])
    buckets = stored(spark, reps.select("id", F.col("n_shingles").alias("size"), F.explode("bands").alias("key")), "bands")
    many = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "size")).alias("p")).where("n > 1").select("key", "n", F.col("p.id").alias("pivot"), F.col("p.size").alias("pivot_size"))
    member = stored(spark, buckets.join(many, "key"), "members")
    involved = member.select("id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(involved, "id", "left_semi")
    # of rows that repeat an id, the text that stands for it
    texts = stored(spark, texts.dropDuplicates(["id"]) if _unique(sk) else _standing(texts, ids), "texts")
    _freed(spark)

    links: list[DataFrame] = []
    label: DataFrame | None = None

    def labelled() -> DataFrame:
        if label is None:
            return member.withColumn("label", F.col("id"))
        return member.join(label.select(F.col("node").alias("id"), "component"), "id", "left").select(*member.columns, F.coalesce("component", "id").alias("label"))

    def take(found: DataFrame, label: DataFrame | None) -> DataFrame | None:
        found = stored(spark, found, "links")
        if found.isEmpty():
            return label
        links.append(found)
        return stored(spark, components(reduce(DataFrame.unionByName, links)), "labels")

    fits = lambda x, y: 100 * F.least(x, y) >= SIMILAR * F.greatest(x, y)  # noqa: E731  sizes that can be similar at all
    with_pivot = fits("size", "pivot_size") & (F.col("id") != F.col("pivot"))
    # one partner each: the smallest pivot of all its buckets
    first = member.where(with_pivot).groupBy(F.col("id").alias("a")).agg(F.min("pivot").alias("b"))
    label = take(_verified(first, texts), label)
    # all pivots that are not in its component yet
    home = labelled().where("id = pivot").select("key", F.col("label").alias("home"))
    pairs = labelled().where(with_pivot).join(home, "key").where("label <> home").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    label = take(_verified(pairs, texts), label)
    _freed(spark)
    mixed = labelled().groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    mixed = stored(spark, labelled().where("n > 2").join(mixed, "key"), "mixed")
    few = mixed.where(f"n <= {SMALL}")
    other = few.select("key", F.col("id").alias("b"), F.col("label").alias("lb"), F.col("size").alias("sb"))
    pairs = few.where("id <> pivot").join(other, "key").where((F.col("id") > F.col("b")) & (F.col("b") != F.col("pivot")) & (F.col("label") != F.col("lb")) & fits("size", "sb"))
    label = take(_verified(pairs.select(F.col("id").alias("a"), "b").distinct(), texts), label)
    minis = reps.select("id", F.col("n_shingles").alias("size"), "mini")
    label = take(_blocks(mixed.where(f"n > {SMALL}"), texts, minis), label)
    _freed(spark)

    out = sk.select("id", "n_shingles")
    of = ids.join(classes, ["d1", "d2"]).select("id", "rep")
    if label is not None:
        of = of.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("rep"))
    out = out.join(of, "id", "left").select("id", "n_shingles", F.coalesce("rep", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _unique(sk: DataFrame) -> bool:
    return sk.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()


def _standing(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Of each id, the text whose set has the digest that stands for it."""

    def run(batches):
        for b in batches:
            d = [np.frombuffer(xxhash.xxh3_128_digest(shingle_set(t).tobytes()), "<i8").tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64())], names=["id", "text", "d1", "d2"])

    with_digest = texts.mapInArrow(run, "id bigint, text string, d1 bigint, d2 bigint")
    return with_digest.join(ids, ["id", "d1", "d2"], "left_semi").dropDuplicates(["id"]).select("id", "text")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicate rows, the one with the smallest id; all columns unchanged, whatever their names.

    Rows are compared as rows: where ids are null or repeat, each row is a document of its own, so a text goes only if its group has another row. Rows without an
    id come after all others; of rows alike in id, one stays (the same on every run over the same files). Rows without words have no group and stay."""
    spark = docs.sparkSession
    names = [f"d{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names)
    ident, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    if rows.where(F.col(ident).isNull()).isEmpty() and _unique(rows.select(F.col(ident).alias("id"))):
        kept = near_duplicates(rows, ident, text).where("kept").select(ident)
        return rows.join(kept, ident, "left_semi").select(*names).toDF(*docs.columns)
    numbered = stored(spark, rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(numbered, "row", text).select("row", "component_id")
    order = F.struct(F.col(ident).isNull().alias("none"), F.col(ident).alias("id"), F.col("row"))
    first = groups.join(numbered.select("row", ident), "row").groupBy("component_id").agg(F.min(order).alias("first")).select("first.row")
    return numbered.join(first, "row", "left_semi").select(*names).toDF(*docs.columns)


def components_sql(nodes: str) -> str:
    """CTEs after links(x, y), each link both ways: component(id, component_id) of all ids of table nodes(id)."""
    return f"""reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
component AS (SELECT n.id, least(n.id, coalesce(min(r.y), n.id)) AS component_id FROM {nodes} n LEFT JOIN reach r ON r.x = n.id GROUP BY n.id)"""


#: DuckDB SQL for near_duplicates() over the table documents, for distinct ids: all pairs that share a shingle, by an inverted index.
NEAR_DUPLICATES_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
sh AS (SELECT DISTINCT id, array_to_string(w[i:i+{SHINGLE - 1}], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
both_have AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id),
links AS (SELECT x, y FROM both_have JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE 100 * c >= {SIMILAR} * (p.n + q.n - c)),
{components_sql("d")}
SELECT d.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.id = component_id AS kept FROM d JOIN component USING (id) LEFT JOIN n USING (id)
"""
