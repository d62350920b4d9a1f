"""Vectors in array columns: dot products, norms, kernels, block-wise similarity of two sets."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a tile: two tiles meet as one matrix product, small enough to stay in a core's cache.
BLOCK = 256
#: A table of vectors is dealt into so many blocks (fewer, where it has fewer tiles; more, where a block would hold over BLOCK_BYTES of numbers): as many
#: copies of each vector are shuffled, however many vectors there are below that.
BLOCKS, BLOCK_BYTES = 16, 32 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    n = F.size(v).cast("double")
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    centred = F.element_at(F.transform(F.array(mean), lambda m: F.transform(v, lambda x: x.cast("double") - m)), 1)

    def scaled(c: Column) -> Column:
        variance = F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x) / n
        return F.element_at(F.transform(F.array(F.sqrt(variance + eps)), lambda d: F.transform(c, lambda x: x / d)), 1)

    return F.element_at(F.transform(F.array(centred), scaled), 1)


def matvec(v: Column, weight: list[list[float]]) -> Column:
    """weight (rows by columns) times v."""
    return F.array(*[dot(v, F.array(*[F.lit(float(x)) for x in row])) for row in weight])


def _sigmoid(dot: np.ndarray, a: float) -> np.ndarray:
    out = np.exp(dot * -a)
    out += 1
    return np.divide(1, out, out=out)


def _gaussian(dot: np.ndarray, xx: np.ndarray, yy: np.ndarray, a: float) -> np.ndarray:
    out = dot * -2
    out += xx
    out += yy
    np.maximum(out, 0, out=out)
    out /= -2 * a * a
    return np.exp(out, out=out)


#: Each from the products x y, |x|^2 as a column, |y|^2 as a row and its number.
KERNELS: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray, float], np.ndarray]] = {
    "linear": lambda dot, xx, yy, a: dot,
    "polynomial": lambda dot, xx, yy, a: dot**a,
    "sigmoid": lambda dot, xx, yy, a: _sigmoid(dot, a),
    "gaussian": _gaussian,
}


def products(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What kernels are made from: x y of all pairs of rows, |x|^2 as a column and |y|^2 as a row."""
    return x @ y.T, (x * x).sum(1)[:, None], (y * y).sum(1)[None]


def _log_sums(p: np.ndarray) -> np.ndarray:
    """Sums of the logarithms of each row's numbers in 1e-6 .. 1: one logarithm of the product of every eight."""
    n = p.shape[1] // 8 * 8
    by_eight = np.multiply.reduce(p[:, :n].reshape(len(p), 8, -1), axis=1)
    return np.log(by_eight).sum(1) + np.log(p[:, n:]).sum(1)


def block_count(df: DataFrame, vector: str) -> int:
    rows, longest = df.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    return max(1, min(BLOCKS, -(-rows // BLOCK)), -(-rows * 8 * max(1, longest or 1) // BLOCK_BYTES))


def _matrix(t: pa.Table) -> np.ndarray:
    """The column v, lists of one length, as rows."""
    flat = pa.concat_arrays([c.flatten() for c in t.column("v").chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def kernel_reduce(left: DataFrame, right: DataFrame | None, ident: str, vector: str, reduce: Callable[..., np.ndarray], names: list[str], keep: str | None = None) -> DataFrame:
    """Blocks of left against blocks of right. reduce(x, y, kept of x, kept of y) makes ``names`` numbers for each row of the tile x from all rows of the tile y; they are
    summed over y in the task. One row for each row of left and block of right: ident and the names.

    Without right, left meets itself, and reduce must not tell x from y: a pair of blocks comes once, with twice its numbers, and all of a task are summed; ident is null.
    No pair of vectors becomes a row: a task holds two blocks and the matrices of two tiles. Every block meets every block, as the full product demands."""
    mirrored = right is None
    right = left if mirrored else right
    nl = block_count(left, vector)
    nr = nl if mirrored else block_count(right, vector)
    cols = [F.col(ident), F.col(vector).cast("array<double>").alias("v"), (F.col(keep) if keep else F.lit(None)).alias("k")]
    own = lambda n: F.pmod(F.xxhash64(ident), F.lit(n)).cast("int").alias("own")
    others = lambda first, last: F.explode(F.sequence(first, last)).alias("other")
    a = left.select(*cols, own(nl)).select("*", others(F.col("own") if mirrored else F.lit(0), F.lit(nr - 1)), F.lit(0).alias("side"))
    b = right.select(*cols, own(nr)).select("*", others(F.lit(0), F.col("own") if mirrored else F.lit(nl - 1)), F.lit(1).alias("side"))
    a = a.select(*a.columns[:3], F.col("own").alias("i"), F.col("other").alias("j"), "side")
    b = b.select(*b.columns[:3], F.col("other").alias("i"), F.col("own").alias("j"), "side")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        x, y = t.take(pa.array(np.flatnonzero(side == 0))), t.take(pa.array(np.flatnonzero(side == 1)))
        out = np.zeros((x.num_rows, len(names)))
        if x.num_rows and y.num_rows:
            mx, my, kx, ky = _matrix(x), _matrix(y), x.column("k").to_numpy(), y.column("k").to_numpy()
            for r in range(0, len(mx), BLOCK):
                rows = slice(r, r + BLOCK)
                for c in range(0, len(my), BLOCK):
                    out[rows] += reduce(mx[rows], my[c : c + BLOCK], kx[rows], ky[c : c + BLOCK])
        ids = x.column(ident)
        if mirrored:
            out, ids = out.sum(0, keepdims=True) * (1 if key[0] == key[1] else 2), pa.nulls(1, pa.int64())
        return pa.table({ident: ids, **{n: out[:, k] for k, n in enumerate(names)}})

    return a.unionByName(b).groupBy("i", "j").applyInArrow(run, ", ".join([f"{ident} bigint", *(f"{n} double" for n in names)]))


def moments(df: DataFrame, vector: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """The sum of all vectors and the sum of their outer products. Each task sums its own; the sums of tasks meet entry by entry, and one matrix reaches the driver."""

    def run(batches):
        first, second = None, None
        for b in batches:
            rows = b.column(0).drop_null().to_pylist()
            if not rows:
                continue
            m = np.array(rows, float).reshape(len(rows), -1)
            first, second = (m.sum(0), m.T @ m) if first is None else (first + m.sum(0), second + m.T @ m)
        if first is not None:
            table = np.vstack([first, second])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(table), dtype=np.int32)), pa.array(table.tolist(), pa.list_(pa.float64()))], names=["i", "s"])

    parts = df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "i int, s array<double>").select("i", F.posexplode("s").alias("j", "s"))
    found = parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # (length + 1) x length numbers
    n = max((r["j"] for r in found), default=-1) + 1
    out = np.zeros((n + 1, n))
    for r in found:
        out[r["i"], r["j"]] = r["s"]
    return out[0], out[1:]


def moment_sums(left: DataFrame, right: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """ident, linear, polynomial (of degree 2) of each row of left: the sums of x y and of (x y)^2 over all right vectors y, from the moments of right. No two vectors meet."""
    first, second = moments(right, vector)

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(first)))
            lin, poly = (x @ first, ((x @ second) * x).sum(1)) if len(first) else (np.zeros(len(x)), np.zeros(len(x)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lin), pa.array(poly)], names=[ident, "linear", "polynomial"])

    return left.select(ident, F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"{ident} bigint, linear double, polynomial double")


def kernel_sums(left: DataFrame, right: DataFrame, ident: str = "vec_id", vector: str = "embedding", args: dict[str, float] | None = None) -> DataFrame:
    """For each left vector, the sum over all right vectors of each kernel: ident, linear, polynomial, sigmoid, gaussian.

    The linear and the squared kernel come from the moments of right; the others, and other powers, need every pair and meet block by block."""
    args = {"linear": 1.0, "polynomial": 2.0, "sigmoid": 1.0, "gaussian": 1.0} | (args or {})
    by_moments = ["linear", *["polynomial"] * (args["polynomial"] == 2.0)]
    by_pairs = [k for k in KERNELS if k not in by_moments]

    def reduce(x, y, _, __):
        made = products(x, y)
        return np.stack([KERNELS[k](*made, args[k]).sum(1) for k in by_pairs], 1)

    part = kernel_reduce(left, right, ident, vector, reduce, by_pairs)
    pairs = part.groupBy(ident).agg(*[F.sum(k).alias(k) for k in by_pairs])
    alone = moment_sums(left, right, ident, vector).groupBy(ident).agg(*[F.sum(k).alias(k) for k in by_moments])
    return alone.join(pairs, ident).select(ident, *KERNELS)


def similarity_losses(vectors: DataFrame, kernels: dict[str, float], ident: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """A row for each kernel: kernel, mse, l1 and bce between the similarity of all pairs (clipped to 0..1 for bce) and whether their labels are equal.

    The similarity is a kernel's product; the linear one is divided by both norms, which makes it the cosine. Pairs with a null label or vector have no loss.
    The pairs of vectors meet once for all kernels, and each pair one way round."""
    names = [f"{loss}{k}" for k in range(len(kernels)) for loss in ("mse", "l1", "bce")]

    def reduce(x, y, kx, ky):
        dot, xx, yy = products(x, y)
        same = (kx[:, None] == ky[None]).astype(float)
        out = []
        for kernel, arg in kernels.items():
            s = dot / np.maximum(np.sqrt(xx), 1e-12) / np.maximum(np.sqrt(yy), 1e-12) if kernel == "linear" else KERNELS[kernel](dot, xx, yy, arg)
            gap = s - same
            p = np.clip(s, 1e-6, 1 - 1e-6)
            p += same
            p -= 1
            np.abs(p, out=p)  # p of a pair with equal labels, else 1 - p
            out += [np.einsum("ij,ij->i", gap, gap), np.abs(gap, out=gap).sum(1), -_log_sums(p)]
        return np.stack(out, 1)

    used = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    sums = kernel_reduce(used, None, ident, vector, reduce, names, label).agg(*[F.sum(n).alias(n) for n in names])
    n = float(used.count()) ** 2
    rows = [F.struct(F.lit(kernel).alias("kernel"), *[(F.col(f"{loss}{k}") / F.lit(n)).alias(loss) for loss in ("mse", "l1", "bce")]) for k, kernel in enumerate(kernels)]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def similarity_loss(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", kernel: str = "linear", arg: float = 1.0) -> DataFrame:
    """One row: mse, l1 and bce of one kernel, as in similarity_losses."""
    return similarity_losses(vectors, {kernel: arg}, ident, vector, label).drop("kernel")


def cosine_blocks(n: int) -> np.ndarray:
    """The n by n discrete cosine transform matrix."""
    k, i = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    a = np.cos((i + 0.5) * math.pi * k / n) * math.sqrt(2 / n)
    a[0] = math.sqrt(1 / n)
    return a


def two_sided(v: Column, a: np.ndarray) -> Column:
    """a X a' of the square matrix X that v holds row by row, as an array of the same kind."""
    return matvec(v, np.kron(a, a).tolist())


def two_sided_blocks(v: Column, a: np.ndarray, side: int) -> Column:
    """a X a' of each block X, as large as a, of the side by side matrix that v holds row by row; an array of the whole shape."""
    n = len(a)
    if side % n:
        raise ValueError(f"blocks of {n} do not divide a side of {side}")
    starts = range(0, side, n)
    blocks = [F.array(*[F.get(v, F.lit((i + r) * side + j + c)) for r in range(n) for c in range(n)]) for i in starts for j in starts]
    place = [(i // n * len(starts) + j // n, i % n * n + j % n) for i in range(side) for j in range(side)]
    done = F.transform(F.array(*blocks), lambda x: two_sided(x, a))
    return F.element_at(F.transform(F.array(done), lambda y: F.array(*[y[k][m] for k, m in place])), 1)
