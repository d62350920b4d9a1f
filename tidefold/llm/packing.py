"""Bin packing of token pieces by linear grouping.

The plan is made on the histogram of lengths, which has at most seq_len rows however many
documents there are: large lengths fall into groups of equal cardinality and are rounded up
to their group's largest; a linear program over configurations of these few sizes (columns
priced by a knapsack) says how many sequences of each configuration to open; actual pieces
take the rounded places; what is left, small pieces above all, goes to the fullest sequence
it fits in. The plan is a short list of runs: "pieces p .. p+n of the order by length stand in
sequences b .. b+n at offset o". Assigning it to pieces is one distributed look-up by rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .runtime import ship, stored

#: Pieces of one length that are ranked together in one task.
RANK_ROWS = 50_000


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole if it fits, else a shorter first piece and full ones."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first), *((s, most) for s in range(first, n, most))]


def token_pieces(docs: DataFrame, path: str, seq_len: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document: id, piece, start, length, ids_crc32 (and ids as binary). A null text is empty: one piece with the end id."""
    ship(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        enc = encoder(path)
        for b in batches:
            keys, at, piece, start, length, crc, ids = b.column(0), [], [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                data = enc.encode(text or "") + end
                for k, (s, n) in enumerate(cut(len(data) // 4, seq_len)):
                    part = data[4 * s : 4 * (s + n)]
                    at.append(i), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            cols = [keys.take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


# ---- the plan, on the histogram ----


def best_configuration(value: np.ndarray, sizes: list[int], room: int) -> tuple[float, np.ndarray]:
    """The configuration (how many of each size) of most value that fits: an unbounded knapsack."""
    f = np.zeros(room + 1)
    before = []
    for v, s in zip(value, sizes, strict=True):
        before.append(f)
        f = f.copy()
        for _ in range(room // s):
            step = f[:-s] + v
            if not (step > f[s:] + 1e-12).any():
                break
            np.maximum(f[s:], step, out=f[s:])
    got, c = np.zeros(len(sizes)), room
    total = float(f[room])
    for g in range(len(sizes) - 1, -1, -1):
        r = np.arange(c // sizes[g] + 1)
        take = int(np.argmax(before[g][c - r * sizes[g]] + r * value[g] - 1e-9 * r))
        got[g], c = take, c - take * sizes[g]
    return total, got


def configurations(sizes: list[int], demand: np.ndarray, room: int, rounds: int = 1500) -> list[tuple[np.ndarray, float]]:
    """(configuration, how many, a fraction allowed) that cover demand with fewest sequences: the linear program, by column generation."""
    k = len(sizes)
    basis = np.diag([float(room // s) for s in sizes])
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ demand
    for _ in range(rounds):
        worth, column = best_configuration(inverse.sum(0), sizes, room)
        if worth <= 1 + 1e-7:
            break
        u = inverse @ column
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        x = np.maximum(x - ratio[out] * u, 0)
        x[out] = ratio[out]
        pivot = inverse[out] / u[out]
        inverse = inverse - np.outer(u, pivot)
        inverse[out] = pivot
    return [(basis[:, j].astype(int), float(x[j])) for j in range(k)]


def plan(counts: np.ndarray, room: int, groups: int = 160, small: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """counts[n]: pieces of length n (1 .. room). Pieces are numbered by (length, rank).

    Returns runs (first number, sequence of the first less its number, offset), sorted, and how many sequences there are."""
    small = room // 3 if small is None else small
    total = np.concatenate([[0], np.cumsum(counts)])  # total[n]: pieces shorter than n
    lo, hi = int(total[small + 1]), int(total[room + 1])
    runs: list[tuple[int, int, int, int]] = []  # number, count, sequence, offset
    opened = 0
    free: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs of sequences (first, count)
    rest: list[tuple[int, int]] = [(0, lo)] if lo else []  # numbers that no configuration takes

    def length_at(number: int) -> int:
        return int(np.searchsorted(total, number, side="right")) - 1

    if hi > lo:
        groups = max(1, min(groups, hi - lo, int((counts[small + 1 :] > 0).sum())))
        bounds = np.unique(np.linspace(lo, hi, groups + 1).round().astype(np.int64))
        spans: dict[int, list[list[int]]] = {}  # rounded size -> number ranges
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            spans.setdefault(length_at(b - 1), []).append([a, b])
        sizes = sorted(spans, reverse=True)
        demand = np.array([sum(b - a for a, b in spans[s]) for s in sizes], float)
        queue = {s: [spans[s][0][0], spans[s][-1][1]] for s in sizes}  # ranges of one size are adjacent
        for config, many in sorted(configurations(sizes, demand, room), key=lambda c: -c[1]):
            slots = [s for s, n in zip(sizes, config, strict=True) for _ in range(n)]
            many = min([int(many + 1e-6), *((queue[s][1] - queue[s][0]) // n for s, n in zip(sizes, config, strict=True) if n)])
            if not slots or many <= 0:
                continue
            takes = []
            for s in slots:
                takes.append(queue[s][0])
                queue[s][0] += many
            # sequences of this configuration, cut where the length in any slot changes
            cuts = {0, many}
            for a in takes:
                cuts.update(int(t) - a for t in total[length_at(a) : length_at(a + many - 1) + 1] if a < t < a + many)
            for x, y in zip(sorted(cuts)[:-1], sorted(cuts)[1:], strict=True):
                used = 0
                for a in takes:
                    runs.append((a + x, y - x, opened + x, used))
                    used += length_at(a + x)
                free.setdefault(room - used, []).append((opened + x, y - x))
            opened += many
        rest += [(a, b) for a, b in queue.values() if b > a]

    # best fit, longest first, many pieces of one length at a time
    left: dict[int, list[tuple[int, int]]] = {}
    for a, b in rest:
        while a < b:
            n = length_at(a)
            e = min(b, int(total[n + 1]))
            left.setdefault(n, []).append((a, e))
            a = e
    have = sorted(free)
    for n in sorted(left, reverse=True):
        for a, b in left[n]:
            while a < b:
                k = bisect_left(have, n)
                if k == len(have):
                    new = -(-(b - a) // (room // n))
                    free[room] = [(opened, new)]
                    insort(have, room)
                    opened += new
                    continue
                f = have[k]
                first, many = free[f].pop()
                take = min(many, b - a)
                runs.append((a, take, first, room - f))
                a += take
                if take < many:
                    free[f].append((first + take, many - take))
                if not free[f]:
                    del free[f], have[k]
                if f - n not in free:
                    free[f - n] = []
                    insort(have, f - n)
                free[f - n].append((first, take))
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 2] - table[:, 0], table[:, 3], opened


def pack_pieces(pieces: DataFrame, seq_len: int, groups: int = 160, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces (a stored table: it is read three times).

    A length that many pieces share is ranked in as many parts as it needs, so no task ranks more than about RANK_ROWS."""
    spark = pieces.sparkSession
    counts = np.zeros(seq_len + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most seq_len rows
        counts[r["length"]] = r["n"]
    starts, delta, offsets, _ = plan(counts, seq_len, groups)
    base = np.concatenate([[0], np.cumsum(counts)[:-1]])

    lengths = [(n, int(counts[n]) // RANK_ROWS + 1, int(base[n])) for n in range(1, seq_len + 1) if counts[n]]
    parts = F.broadcast(spark.createDataFrame(lengths, "length bigint, parts bigint, base bigint"))  # at most seq_len rows
    # equal rows (repeated ids) may rank in any order: they are alike
    key = F.pmod(F.xxhash64(id_col, "piece"), "parts").alias("part")
    parted = pieces.join(parts, "length").select("*", key)
    before = parted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = before.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy(id_col, "piece"))
    numbered = parted.withColumn("rank", rank).join(before, ["length", "part"])
    out = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    numbered = numbered.select(*out, (F.col("base") + F.coalesce("before", F.lit(0)) + F.col("rank") - 1).alias("__number"))

    def place(batches):
        for b in batches:
            number = b.column(b.num_columns - 1).to_numpy()
            k = np.searchsorted(starts, number, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(number + delta[k]), pa.array(offsets[k])], names=[*out, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in out)
    return numbered.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str, seq_len: int = 2048, end_id: int = 0, groups: int = 160, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs all documents: one row a piece with id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one id. Documents longer than seq_len are cut. Rows that repeat an id are packed
    each for itself. An empty table gives an empty result. Columns other than the two named are not read.
    """
    spark = docs.sparkSession
    pieces = stored(spark, token_pieces(docs, path, seq_len, end_id, id_col, text_col, with_ids), "pieces")
    return pack_pieces(pieces, seq_len, groups, id_col)
