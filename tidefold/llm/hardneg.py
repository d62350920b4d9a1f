"""Hard negatives by rotated partial products.

Vectors are scaled to integers. An orthogonal matrix, the principal directions of all vectors, turns them so that the leading
components carry most of every inner product. For a block of anchors and a block of rows the products are summed over leading
components first. What the others can still add is bounded by the norms of the residuals, and a slack covers rounding. A pair
goes on only while its bounds reach an interval that is still wanted, which narrows as better rows are found; those left are
verified by integer products. The bounds only discard: results are those of an exhaustive search, whatever the rotation is.

Two searches: the nearest rows of an anchor's own label (its positives), then for each positive the highest scores of other labels
inside a window that the positive's score sets. Rows and anchors are dealt in blocks by hash; each pair of blocks is a task of its
own that yields at most the wanted number of rows for each anchor (and positive), and windows pick the best of these.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import ship, spread, stored

#: Production settings: x becomes floor(SCALE * x); positives of an anchor; negatives of a positive; the window of their scores in percent.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Vectors of a larger squared integer norm take no part: below it every score, and 100 times it, is exact in 64 bits.
MOST_NORM = 1 << 53
#: Numbers that a block of rows holds; rows and anchors whose products are taken at a time; pairs verified at a time.
BLOCK_NUMBERS, LEAST_ROWS, SUB_ROWS, SUB_ANCHORS, PORTION = 1 << 20, 1024, 1024, 512, 1 << 15
#: Part of the components after which bounds are tested; under this part of pairs left, the rest is done pair by pair.
STAGES, SPARSE = (0.25, 0.5, 0.75, 0.9), 0.05
#: Most dimensions and vector lengths for which a rotation is made; others are searched unrotated, with equal results.
MOST_DIM, MOST_DIMS = 2048, 16
_NONE = np.iinfo(np.int64).min


def _integers(vectors: DataFrame, label: str, scale: float) -> DataFrame:
    """(id, label, anchor, dim, d1, d2, x) of the rows that take part; x holds 32-bit integers where these suffice, else 64-bit ones."""

    def run(batches):
        for b in batches:
            col = b.column(3)
            ends = np.cumsum([n or 0 for n in col.value_lengths().to_pylist()])
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components are not numbers
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(scale * flat)
            keep, d1, d2, dim, x = [], [], [], [], []
            for k, (start, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                a = flat[start:end]
                with np.errstate(over="ignore"):
                    if end == start or not np.isfinite(a).all() or a @ a > MOST_NORM:
                        continue
                raw = a.astype("<i4" if np.abs(a).max() < 1 << 31 else "<i8").tobytes()
                d = np.frombuffer(xxhash.xxh3_128_digest(raw), "<i8").tolist()
                keep.append(k), d1.append(d[0]), d2.append(d[1]), dim.append(end - start), x.append(raw)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(dim, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(x, pa.binary())], names=["id", "label", "anchor", "dim", "d1", "d2", "x"])

    live = vectors.where("id is not null and label is not null and v is not null").select("id", "label", "anchor", "v")
    return live.mapInArrow(run, f"id bigint, label {label}, anchor boolean, dim int, d1 bigint, d2 bigint, x binary")


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(raw), dim), np.int64)
    short = np.array([len(v) == 4 * dim for v in raw], bool)
    for at, kind in ((np.flatnonzero(short), "<i4"), (np.flatnonzero(~short), "<i8")):
        if len(at):
            out[at] = np.frombuffer(b"".join([raw[k] for k in at.tolist()]), kind).reshape(-1, dim)
    return out


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """Principal directions for each length of vectors, as columns, leading first: eigenvectors of the sum of outer products of all vectors.

    Each task sums its vectors' products; the sums of tasks meet entry by entry, so what reaches the driver is one matrix a length."""
    lengths = [r["dim"] for r in rows.where(f"dim <= {MOST_DIM}").groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MOST_DIMS).collect()]

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column(0).to_numpy()
            for dim in sorted(set(dims.tolist()) & set(lengths)):
                a = _matrix(b.column(1).take(pa.array(np.flatnonzero(dims == dim))).to_pylist(), dim).astype(float)
                sums[dim] = sums.get(dim, 0) + a.T @ a
        for dim, s in sums.items():
            for k in range(dim):
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([k], pa.int32()), pa.array([s[k].tolist()], pa.list_(pa.float64()))], names=["dim", "k", "sums"])

    parts = rows.select("dim", "x").mapInArrow(run, "dim int, k int, sums array<double>").select("dim", "k", F.posexplode("sums").alias("j", "s"))
    out = {dim: np.zeros((dim, dim)) for dim in lengths}
    for r in parts.groupBy("dim", "k", "j").agg(F.sum("s").alias("s")).collect():  # MOST_DIMS matrices at most
        out[r["dim"]][r["k"], r["j"]] = r["s"]
    return {dim: np.linalg.eigh((g + g.T) / 2)[1][:, ::-1].copy() for dim, g in out.items()}


def top_rows(q: np.ndarray, x: np.ndarray, allowed: Callable[[slice, slice], np.ndarray], low: np.ndarray, high: np.ndarray, k: int, rotation: np.ndarray | None = None, counts: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, p, r, score): for anchor a and its interval p, the k rows r of highest score in low[a, p] .. high[a, p] that are allowed; of equal scores the first rows.

    q, x: integer vectors. counts, if given, gets how many pairs there were and how many were verified."""
    dim, norm = q.shape[1], lambda m: np.sqrt(np.einsum("ij,ij->i", m, m))
    qr, xr = q.astype(float), x.astype(float)
    if rotation is not None:
        qr, xr = qr @ rotation, xr @ rotation
    cuts = sorted({min(dim, max(1, math.ceil(dim * s))) for s in STAGES})
    q_rest, x_rest = [[norm(m[:, c:]) for c in cuts] for m in (qr, xr)]
    # rounding of the rotation and of the sums is far below this part of the norms
    q_slack, x_slack = norm(q.astype(float)) * (16 * dim**1.5 * np.finfo(float).eps), norm(x.astype(float))
    best = np.full((*low.shape, k), _NONE)  # scores, highest first
    held = np.zeros((*low.shape, k), np.int64)  # their rows
    r0 = 0
    while r0 < len(x):
        rs = slice(r0, min(len(x), r0 + min(SUB_ROWS, max(64, r0))))  # few rows first: they set intervals for the others
        for a0 in range(0, len(q), SUB_ANCHORS):
            qs = slice(a0, min(len(q), a0 + SUB_ANCHORS))
            alive = allowed(qs, rs)
            least, most = np.maximum(low[qs], best[qs, :, -1]).astype(float), high[qs].astype(float)
            if counts is not None:
                counts["pairs"] = counts.get("pairs", 0) + int(alive.sum())
            part, start = np.zeros(alive.shape), 0
            for c, qn, xn in zip(cuts, q_rest, x_rest, strict=True):
                part += qr[qs, start:c] @ xr[rs, start:c].T
                start = c
                rest = qn[qs][:, None] * xn[rs][None] + q_slack[qs][:, None] * x_slack[rs][None]
                top, bottom = part + rest, part - rest
                reach = np.zeros_like(alive)
                for p in range(low.shape[1]):
                    reach |= (top >= least[:, p, None]) & (bottom <= most[:, p, None])
                alive &= reach
                if np.count_nonzero(alive) <= SPARSE * alive.size:
                    break
            at_a, at_r = np.nonzero(alive)
            at_a, at_r = at_a + a0, at_r + rs.start
            if counts is not None:
                counts["verified"] = counts.get("verified", 0) + len(at_a)
            for s in range(0, len(at_a), PORTION):
                _merge(best, held, low, high, at_a[s : s + PORTION], at_r[s : s + PORTION], np.einsum("ij,ij->i", q[at_a[s : s + PORTION]], x[at_r[s : s + PORTION]]))
        r0 = rs.stop
    a, p, n = np.nonzero(best != _NONE)
    return a, p, held[a, p, n], best[a, p, n]


def _merge(best: np.ndarray, held: np.ndarray, low: np.ndarray, high: np.ndarray, a: np.ndarray, r: np.ndarray, score: np.ndarray) -> None:
    """Take verified pairs into the best of their intervals."""
    k = best.shape[2]
    for p in range(best.shape[1]):
        fit = (score >= np.maximum(low[a, p], best[a, p, -1])) & (score <= high[a, p])
        if not fit.any():
            continue
        who = np.unique(a[fit])
        aa = np.concatenate([np.repeat(who, k), a[fit]])
        ss = np.concatenate([best[who, p].ravel(), score[fit]])
        rr = np.concatenate([held[who, p].ravel(), r[fit]])
        order = np.lexsort((rr, ~ss, aa))  # ~ss falls as ss rises, and cannot overflow
        aa, ss, rr = aa[order], ss[order], rr[order]
        place = np.arange(len(aa)) - np.searchsorted(aa, aa)
        take = place < k
        best[aa[take], p, place[take]], held[aa[take], p, place[take]] = ss[take], rr[take]


def _codes(labels: pa.ChunkedArray) -> np.ndarray:
    return labels.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _sides(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The group with its rows in order of id and digest, the vectors, and where anchors and rows are."""
    group = group.combine_chunks().sort_by([("id", "ascending"), ("d1", "ascending"), ("d2", "ascending")])
    side = group.column("side").to_numpy()
    x = _matrix(group.column("x").to_pylist(), group.column("dim")[0].as_py())
    return group, x, np.flatnonzero(side == 1), np.flatnonzero(side == 0)


def _meeting(rows: DataFrame, anchors: DataFrame, on: list[str], extra: dict[str, str]) -> DataFrame:
    """Rows (side 0) and anchors (side 1) of equal ``on``, each row once for every block of anchors and each anchor once for every block of rows: columns i, j."""
    spark = rows.sparkSession
    wanted = F.greatest(F.lit(LEAST_ROWS), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dim")))
    # small tables are spread as well
    number = lambda n: F.greatest(F.ceil(F.col(n) / wanted), F.least(F.lit(spread(spark)), F.ceil(F.col(n) / LEAST_ROWS))).cast("int")
    counts = rows.groupBy(*on).agg(F.count("*").alias("n"), F.count_if("anchor").alias("a")).where("a > 0").select(*on, number("n").alias("ni"), F.ceil(F.col("a") / wanted).cast("int").alias("nj"))
    own = lambda n: F.pmod(F.xxhash64("id", "d1", "d2"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["label", "dim", "id", "d1", "d2", "x"]
    one = rows.join(counts, on).select(*kept, F.lit(0).alias("side"), *[F.lit(None).cast(t).alias(c) for c, t in extra.items()], own("ni").alias("i"), every("nj").alias("j"))
    two = anchors.join(counts, on).select(*kept, F.lit(1).alias("side"), *extra, every("ni").alias("i"), own("nj").alias("j"))
    # so many partitions in any case: a pair of blocks is much work for few bytes
    return one.unionByName(two).repartition(spread(spark), *dict.fromkeys([*on, "dim", "i", "j"]))


def hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score, for the rows where ``anchor`` (a condition on vectors) holds.

    Components become floor(scale * x), scores are integer inner products, higher first, then the smaller id. An anchor's positives are its first other rows of
    the same label (all, if fewer); the negatives of a positive are the first rows of other labels with low * positive_score <= 100 * negative_score <= high *
    positive_score. Rows with a null id, label or vector, an empty vector, any null or non-finite component, or a squared integer norm over MOST_NORM take no
    part; vectors of different lengths do not meet. Rows alike in id, label and vector count once; rows alike in id that differ are rows of their own, so an
    anchor's id may then come with several lists. Anchors without positives, or whose window holds nothing, give no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    label = vectors.schema[label_col].dataType.simpleString()
    chosen = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vec_col).cast("array<double>").alias("v"))
    key = ["id", "label", "d1", "d2"]
    rows = _integers(chosen, label, scale).groupBy(*key).agg(F.max("anchor").alias("anchor"), F.first("dim").alias("dim"), F.first("x").alias("x"))
    rows = stored(spark, rows, "vectors")
    turn = rotations(rows)

    def nearest(group: pa.Table) -> pa.Table:
        group, x, at, of = _sides(group)
        same = group.select(["id", "d1", "d2"]).to_pandas()
        code = same.groupby(["id", "d1", "d2"], sort=False).ngroup().to_numpy()  # an anchor is no row of its own
        shape = (len(at), 1)
        a, _, r, s = top_rows(x[at], x[of], lambda q, w: code[at[q]][:, None] != code[of[w]][None], np.full(shape, _NONE + 1), np.full(shape, np.iinfo(np.int64).max), positives, turn.get(x.shape[1]))
        mine, other = group.take(pa.array(at[a])), group.take(pa.array(of[r]))
        return pa.table({"label": mine["label"], "id": mine["id"], "d1": mine["d1"], "d2": mine["d2"], "p_id": other["id"], "p_d1": other["d1"], "p_d2": other["d2"], "score": pa.array(s, pa.int64())})

    anchors = rows.where("anchor")
    near = _meeting(rows, anchors, ["label", "dim"], {}).groupBy("label", "dim", "i", "j").applyInArrow(nearest, f"label {label}, id bigint, d1 bigint, d2 bigint, p_id bigint, p_d1 bigint, p_d2 bigint, score bigint")
    first = Window.partitionBy(*key).orderBy(F.desc("score"), "p_id", "p_d1", "p_d2")
    near = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives)
    # at most ``positives`` an anchor
    of_anchor = near.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("n", "score", "p_id"))).alias("pos")).select(*key, F.col("pos.score").alias("scores"), F.col("pos.p_id").alias("of"))
    anchors = stored(spark, anchors.join(of_anchor, key).select(*rows.columns, "scores", "of"), "anchors")

    def hardest(group: pa.Table) -> pa.Table:
        group, x, at, of = _sides(group)
        label_code = _codes(group.column("label"))
        scores = group.column("scores").take(pa.array(at)).to_pylist()
        named = group.column("of").take(pa.array(at)).to_pylist()
        lows, highs = np.full((len(at), positives), np.iinfo(np.int64).max), np.full((len(at), positives), _NONE + 1)
        for n, row in enumerate(scores):
            for p, s in enumerate(row):
                lows[n, p], highs[n, p] = -(-low * s // 100), high * s // 100
        a, p, r, s = top_rows(x[at], x[of], lambda q, w: label_code[at[q]][:, None] != label_code[of[w]][None], lows, highs, negatives, turn.get(x.shape[1]))
        mine, other = group.take(pa.array(at[a])), group.take(pa.array(of[r]))
        pairs = list(zip(a.tolist(), p.tolist()))
        made = {"label": mine["label"], "id": mine["id"], "d1": mine["d1"], "d2": mine["d2"], "n": pa.array(p, pa.int32()), "positive_id": pa.array([named[n][k] for n, k in pairs], pa.int64()), "positive_score": pa.array([scores[n][k] for n, k in pairs], pa.int64())}
        return pa.table(made | {"n_id": other["id"], "n_d1": other["d1"], "n_d2": other["d2"], "negative_score": pa.array(s, pa.int64())})

    met = _meeting(rows, anchors, ["dim"], {"scores": "array<bigint>", "of": "array<bigint>"})
    found = met.groupBy("dim", "i", "j").applyInArrow(hardest, f"label {label}, id bigint, d1 bigint, d2 bigint, n int, positive_id bigint, positive_score bigint, n_id bigint, n_d1 bigint, n_d2 bigint, negative_score bigint")
    best = Window.partitionBy(*key, "n").orderBy(F.desc("negative_score"), "n_id", "n_d1", "n_d2")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return found.select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("n_id").alias("negative_id"), "positive_score", "negative_score")


#: DuckDB SQL for hard_negatives() over the table embeddings as op11 calls it, for distinct ids and vectors of one length: all pairs.
HARD_NEGATIVES_SQL = f"""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda e: floor({SCALE} * e)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, positive_score, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= {NEGATIVES}
"""
