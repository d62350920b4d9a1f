"""Mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent and normalised. The exponent is bisected: to a
target entropy of the weights, or to the flattest weights for which no source is repeated more often than a
limit. With a token budget this gives each source a number of passes over its documents: whole passes, and
one that ends, in a hashed order of its own, where the source's budget is spent. The passes, one after the
other, are cut by their running token sums into blocks of equal budgets, each with every source's share, in
hashed order within the block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .runtime import ship, stored

#: Sources are a small dimension: more than so many are refused. Production settings: most passes over a source, tokens of a block.
MOST_SOURCES, REPEATS, BLOCK_TOKENS, SEED = 100_000, 2.0, 1 << 20, 5
_BITS = 62
#: Rows of a source that are put in order together, about: its hashes are cut into as many ranges as that takes, at least 2^LEAST_RANGES.
RANGE_ROWS, LEAST_RANGES = 50_000, 6


@dataclass
class Mixture:
    exponent: float
    weights: list[float]
    budget: float


def weights(tokens: list[int], exponent: float) -> list[float]:
    top = max(tokens)
    raw = [(n / top) ** exponent for n in tokens]
    return [r / sum(raw) for r in raw]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def once(tokens: list[int], w: list[float]) -> float:
    """The least budget with which every source is used at least once."""
    return max(n / x for n, x in zip(tokens, w, strict=True))


def solve(tokens: list[int], repeats: float | None = REPEATS, target_entropy: float | None = None, budget: float | None = None) -> Mixture:
    """The exponent in 0 .. 1 (flat .. proportional) for positive token counts. Without a budget, the least one that uses every source once.

    With target_entropy: the exponent whose weights have it (the nearest possible). Else the smallest exponent with at most ``repeats`` passes over any source."""

    def fits(a: float) -> bool:
        w = weights(tokens, a)
        if target_entropy is not None:
            return entropy(w) <= target_entropy
        b = budget if budget is not None else once(tokens, w)
        return max(b * x / n for n, x in zip(tokens, w, strict=True)) <= repeats * (1 + 1e-12)

    low, high = 0.0, 1.0
    if fits(0.0):
        high = 0.0
    else:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(mid) else (mid, high)
    w = weights(tokens, high)
    return Mixture(high, w, budget if budget is not None else once(tokens, w))


def sized(docs: DataFrame, path: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, n_tokens) of every document; null texts have none."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(enc.encode(t or "")) // 4 for t in b.column(2).to_pylist()], pa.int64())], names=["id", "source", "n_tokens"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), text_col)
    return chosen.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, source string, n_tokens bigint")


def _draw(epoch: Column, ident: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), epoch, ident), F.lit(1 << _BITS))


def passes(rows: DataFrame, repeats: float | None = REPEATS, target_entropy: float | None = None, budget: float | None = None, seed: int = SEED) -> tuple[DataFrame, Mixture | None]:
    """One row a source: p_source, whole (passes over all its documents), last (largest hash in the pass that follows, -1 for none), total (passes, with the part).

    The last pass is cut without sorting a source: token sums of 4096 hash ranges find the range where the budget ends, and only that range is put in order."""
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is not None, r["source"] or ""))
    live = [r for r in found if r["n"] > 0]
    empty = [(r["source"], 1, 0.0, 1.0) for r in found if r["n"] == 0]  # without a token: used once
    schema = "p_source string, whole int, rest double, total double"
    mixture = None
    share: list[tuple] = []
    if live:
        mixture = solve([r["n"] for r in live], repeats, target_entropy, budget)
        for r, w in zip(live, mixture.weights, strict=True):
            total = w * mixture.budget / r["n"]
            whole = int(total + 1e-9)
            share.append((r["source"], whole, max(0.0, (total - whole) * r["n"]) if total - whole > 1e-9 else 0.0, total))
    params = F.broadcast(spark.createDataFrame(share + empty, schema))  # at most MOST_SOURCES rows
    part = rows.join(params, F.col("source").eqNullSafe(F.col("p_source"))).where("rest > 0").select("p_source", "rest", "n_tokens", _draw(F.col("whole"), F.col("id"), seed).alias("h"))
    part = part.withColumn("range", F.shiftright("h", 50))
    ranges = part.groupBy("p_source", "rest", "range").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("p_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ranges.withColumn("before", before).where("before < rest").groupBy("p_source", "rest").agg(F.max(F.struct("range", "before")).alias("e"))
    ends = ends.select(F.col("p_source").alias("e_source"), F.col("e.range").alias("e_range"), F.col("e.before").alias("before"))
    within = part.join(F.broadcast(ends), F.col("p_source").eqNullSafe(F.col("e_source")) & (F.col("range") == F.col("e_range")))
    running = F.col("before") + F.coalesce(F.sum("n_tokens").over(Window.partitionBy("p_source").orderBy("h").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = {r["p_source"]: r["h"] for r in within.withColumn("running", running).where("running < rest").groupBy("p_source").agg(F.max("h").alias("h")).collect()}  # one row a source
    table = [(s, whole, last.get(s, -1), total) for s, whole, _, total in share + empty]
    return spark.createDataFrame(table, "p_source string, whole int, last bigint, total double"), mixture


def _epochs(frame: DataFrame, params: DataFrame, ident: Column, source: Column, name: str, seed: int, extra: list[Column]) -> DataFrame:
    """frame with a row for every pass that takes it; name is the column of the pass."""
    joined = frame.join(F.broadcast(params), source.eqNullSafe(F.col("p_source")))
    taken = F.col("whole") + (_draw(F.col("whole"), ident, seed) <= F.col("last")).cast("int")
    return joined.where(taken > 0).select("*", F.explode(F.sequence(F.lit(0), taken - 1)).alias(name)).select(*[F.col(c) for c in frame.columns], F.col(name), *extra)


def mixture(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeats: float | None = REPEATS, target_entropy: float | None = None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """One row for each use of a document: id, source, epoch, block, place, n_tokens.

    Blocks are numbered by the order in which they are read; place is the hashed order within a block. Null and empty texts have no tokens and go along with their source;
    a source without tokens is used once. A null source is a source of its own. Rows that repeat an id are used alike. With the default budget no document is left out.
    An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = stored(spark, sized(docs, path, id_col, text_col, source_col), "sized")
    params, found = passes(rows, repeats, target_entropy, budget, seed)
    blocks = max(1, math.ceil(found.budget / BLOCK_TOKENS)) if found else 1
    uses = _epochs(rows, params, F.col("id"), F.col("source"), "epoch", seed, [])
    uses = uses.withColumn("place", _draw(F.col("epoch"), F.col("id"), seed))
    out = _blocked(uses, blocks)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "epoch", "block", "place", "n_tokens")


def _blocked(uses: DataFrame, blocks: int) -> DataFrame:
    """uses(source, epoch, place, n_tokens, ..) with block: where the source's tokens before a use, epoch by epoch in order of place, lie in its sum.

    No source is put in order whole: sums of hash ranges come first, and only uses of one source, epoch and range meet in a task. Uses alike in place share a block."""
    most = uses.groupBy("source", "epoch").count().agg(F.max("count")).first()[0] or 0
    bits = max(LEAST_RANGES, math.ceil(math.log2(max(1, most / RANGE_ROWS))))
    uses = uses.withColumn("range", F.shiftright("place", _BITS - bits))
    ranges = uses.groupBy("source", "epoch", "range").agg(F.sum("n_tokens").alias("n"))
    in_order = Window.partitionBy("source").orderBy("epoch", "range")
    before = F.coalesce(F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col("source").alias("r_source"), F.col("epoch").alias("r_epoch"), F.col("range").alias("r_range"), before.alias("before"), F.sum("n").over(Window.partitionBy("source")).alias("all"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source", "epoch", "range").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = uses.withColumn("within", within).join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("epoch") == F.col("r_epoch")) & (F.col("range") == F.col("r_range")))
    block = F.floor((F.col("before") + F.col("within")) * F.lit(float(blocks)) / F.greatest(F.col("all"), F.lit(1)))
    return placed.withColumn("block", F.least(block, F.lit(blocks - 1)).cast("long"))


def mixed(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeats: float | None = REPEATS, target_entropy: float | None = None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """docs, each row as often as the mixture uses it, with unchanged columns. Texts are not shuffled."""
    spark = docs.sparkSession
    ship(spark)
    rows = stored(spark, sized(docs, path, id_col, text_col, source_col), "sized")
    params, _ = passes(rows, repeats, target_entropy, budget, seed)
    # names that no extra column of docs can clash with
    inner = docs.toDF(*[f"d{k}" for k in range(len(docs.columns))])
    ident, source = (F.col(f"d{docs.columns.index(c)}") for c in (id_col, source_col))
    out = _epochs(inner, params, ident, source.cast("string"), "epoch", seed, [])
    return out.drop("epoch").toDF(*docs.columns)
