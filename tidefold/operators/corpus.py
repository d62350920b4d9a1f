"""Text to token streams: filters, vocabularies, flattening, budgets, windows, splits, padding."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.blocks import HOT_ROWS, ranged
from ..functions.scratch import ship

#: Ordinals of one part of a two-level running sum.
PART = 4096
#: Ids of an Arrow batch, about.
IDS_BATCH = 1 << 20


def not_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text is not null and holds a character that is not (Unicode) white space."""
    return df.where(F.col(text).rlike(r"(?U)\S"))


def char_vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """symbol, id: the distinct characters in code point order, from 0. A vocabulary has at most a million rows, counted before it is ranked."""
    symbols = df.select(F.explode(F.array_distinct(F.split(text, ""))).alias("symbol")).where("symbol <> ''").distinct()
    return symbols.select("symbol", (F.dense_rank().over(Window.orderBy("symbol")) - 1).alias("id"))


def char_encode(df: DataFrame, vocabulary: DataFrame, unknown: int = 0, text: str = "text") -> DataFrame:
    """Adds ids: each character's id, ``unknown`` for one that is not in the vocabulary.

    The vocabulary is bounded by the number of code points; it becomes a table by code point that each Arrow batch indexes."""
    entries = [(ord(r["symbol"]), r["id"]) for r in vocabulary.collect()]
    shipped = df.sparkSession.sparkContext.broadcast(entries)

    def make():
        points = np.array([e[0] for e in shipped.value], np.int64)
        ids = np.full(0x110000, unknown, np.int32)
        ids[points] = [e[1] for e in shipped.value]
        return lambda t: None if t is None else ids[np.frombuffer(t.encode("utf-32-le"), "<u4")]

    return _with_ids(df, text, make)


def _with_ids(df: DataFrame, text: str, make: Callable[[], Callable[[str | None], np.ndarray | None]]) -> DataFrame:
    """Adds ids: what the function that make() gives in a task returns for each text. Rows leave in batches of about IDS_BATCH ids, however many came together."""
    at, names = df.columns.index(text), [*df.columns, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for b in batches:
            begin, held, count = 0, [], 0

            def out(end: int) -> pa.RecordBatch:
                null = np.array([x is None for x in held], bool)
                offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in held])]).astype(np.int32)
                flat = np.concatenate([x for x in held if x is not None] or [np.zeros(0, np.int32)]).astype(np.int32, copy=False)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(null))
                return pa.RecordBatch.from_arrays([*b.slice(begin, end - begin).columns, lists], names=names)

            for k, t in enumerate(b.column(at)):
                held.append(encode(t.as_py()))
                count += 0 if held[-1] is None else len(held[-1])
                if count >= IDS_BATCH:
                    yield out(k + 1)
                    begin, held, count = k + 1, [], 0
            if held:
                yield out(b.num_rows)

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def clean_context(text: Column) -> Column:
    """Lines stripped of white space (ideographic too), empty ones dropped, each preceded by a line feed."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.concat(F.lit("\n"), F.array_join(F.filter(lines, lambda x: x != ""), "\n"))


def running_offsets(df: DataFrame, order: str, size: str, name: str = "start") -> DataFrame:
    """Adds the sum of ``size`` over all rows before a row in ``order`` (a distinct integer): sums of parts first, then within each part.

    The window without a partition sees one row for each PART of the order's values, not the rows."""
    parted = df.withColumn("__part", F.expr(f"{order} div {PART}"))
    parts = parted.groupBy("__part").agg(F.sum(size).alias("__n"))
    before = parts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inner = F.coalesce(F.sum(size).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parted.withColumn("__inner", inner).join(before, "__part").withColumn(name, F.col("__before") + F.col("__inner")).drop("__part", "__inner", "__before")


def flatten(df: DataFrame, order: str, tokens: str) -> DataFrame:
    """pos, token: the rows' token arrays, one after the other in ``order``."""
    sized = running_offsets(df.withColumn("__size", F.size(tokens).cast("bigint")), order, "__size", "__start")
    return sized.select("__start", F.posexplode(tokens).alias("__k", "token")).select((F.col("__start") + F.col("__k")).alias("pos"), "token")


def take_budget(df: DataFrame, order: str, size: str, budget: int) -> DataFrame:
    """The rows in order until the running sum reaches the budget, with n_kept tokens of each; the last is cut to fit."""
    found = running_offsets(df, order, size, "__start").where(F.col("__start") < budget)
    return found.withColumn("n_kept", F.least(F.col(size), F.lit(budget) - F.col("__start"))).drop("__start")


def capped_stream(df: DataFrame, order: str, tokens: str, budget: int) -> DataFrame:
    """pos, token: the rows' tokens one after the other, up to the budget: what a capped token file holds."""
    kept = take_budget(df.withColumn("__size", F.size(tokens).cast("bigint")), order, "__size", budget)
    return flatten(kept.withColumn("__tokens", F.slice(tokens, F.lit(1), F.col("n_kept").cast("int"))), order, "__tokens")


def split_position(stream: DataFrame, total: int, share: float = 0.99, pos: str = "pos") -> DataFrame:
    """Adds part: train before floor(share * total), then valid."""
    return stream.withColumn("part", F.when(F.col(pos) < int(total * share), "train").otherwise("valid"))


def windows(stream: DataFrame, length: int, pos: str = "pos", token: str = "token") -> DataFrame:
    """Complete chunks of ``length`` tokens: chunk, x (its tokens), y (those one later; the last chunk needs one more token)."""
    chunk = F.expr(f"{pos} div {length}")
    own = stream.select(chunk.alias("chunk"), F.struct(F.col(pos).alias("p"), F.col(token).alias("t")).alias("s"))
    after = stream.where(F.expr(f"{pos} % {length} = 0 and {pos} > 0")).select((chunk - 1).alias("chunk"), F.struct(F.col(pos).alias("p"), F.col(token).alias("t")).alias("s"))
    rows = own.unionByName(after).groupBy("chunk").agg(F.sort_array(F.collect_list("s")).alias("s")).where(F.size("s") == length + 1)
    tokens = F.transform("s", lambda x: x["t"])
    return rows.select("chunk", F.slice(tokens, 1, length).alias("x"), F.slice(tokens, 2, length).alias("y"))


def chunks(stream: DataFrame, length: int, pos: str = "pos", token: str = "token") -> DataFrame:
    """chunk, tokens: complete chunks; the tail is dropped."""
    rows = stream.groupBy(F.expr(f"{pos} div {length}").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(token).alias("t")))).alias("s"))
    return rows.where(F.size("s") == length).select("chunk", F.transform("s", lambda x: x["t"]).alias("tokens"))


def last_tokens(ids: Column, length: int) -> Column:
    return F.when(F.size(ids) <= length, ids).otherwise(F.slice(ids, -length, length))


def pad(values: Column, length: Column, fill: float = 0) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(length - F.size(values), F.lit(0))))


def length_mask(size: Column, longest: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), longest - 1), lambda t: (t < size).cast("int"))


def pad_in_batches(df: DataFrame, ids: str, batch: Column, fill: float = 0) -> DataFrame:
    """df with ids padded to the longest of its batch and mask, 1 where an id is real. Lengths are aggregated and joined: a batch's rows need not meet."""
    sized = df.withColumn("__b", batch)
    longest = sized.groupBy(F.col("__b").alias("__of")).agg(F.max(F.size(ids)).alias("__longest"))
    out = sized.join(longest, F.col("__b").eqNullSafe(F.col("__of")))
    return out.withColumn("mask", length_mask(F.size(ids), F.col("__longest"))).withColumn(ids, pad(F.col(ids), F.col("__longest"), fill)).drop("__b", "__of", "__longest")


def merge_steps(df: DataFrame, steps: int, t: str = "t", n: str = "n") -> DataFrame:
    """(t, n) as one index tn = t + steps * n."""
    return df.withColumn("tn", F.col(t) + F.lit(steps) * F.col(n)).drop(t, n)


def split_steps(df: DataFrame, steps: int, t: str = "t", n: str = "n") -> DataFrame:
    """tn as (t, n) again."""
    return df.withColumn(t, F.col("tn") % steps).withColumn(n, F.expr(f"tn div {steps}")).drop("tn")


def embed(ids: DataFrame, table: DataFrame, ident: str, vector: str) -> DataFrame:
    """ids with the row of a table of vectors for each id: a join, so the table may be of any size."""
    return ids.join(table.select(ident, vector), ident)


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == label).cast("int"))


def redundant_one_hot(label: Column, classes: int, slots: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes * slots - 1)), lambda k: (F.floor(k / slots) == label).cast("int"))


def time_shift(df: DataFrame, value: str, key: str = "sample", order: tuple[str, ...] = ("t", "event_id"), name: str = "before", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds the previous step's value; 0 at the first. A key of more than hot_rows rows is shifted in ranges; a range's first row gets the last value before it."""
    # a value that is null stays null: only a first row has none before it
    rows = ranged(df, [key], order, hot_rows).columns({"__v": F.struct(F.col(value).alias("x"))}).preceding("__v", "__w").plain()
    return rows.withColumn(name, F.when(F.col("__w").isNull(), F.lit(0.0)).otherwise(F.col("__w.x"))).drop("__v", "__w")


def time_mix(now: Column, before: Column, share: float) -> Column:
    return now * F.lit(share) + before * F.lit(1 - share)


def _encoder(path: str) -> Callable[[str], np.ndarray]:
    """The ids of a text: by the cached words of the llm part, which may be left out, else by the library; both give the same."""
    try:
        from ..llm.bpe import encoder
    except ModuleNotFoundError as missing:
        if not (missing.name or "").startswith("tidefold.llm"):
            raise
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        return lambda t: np.array(lib.encode(t, add_special_tokens=False).ids, np.int32)
    words = encoder(path)
    return lambda t: np.frombuffer(words.encode(t), "<u4").astype(np.int32)


def tokenize(df: DataFrame, path: str, end_id: int, text: str = "text") -> DataFrame:
    """Adds ids: byte-pair tokens of the whole text (null: empty) by a public vocabulary file, without special tokens or truncation, then end_id."""
    ship(df.sparkSession)

    def make():
        encode = _encoder(path)
        return lambda t: np.append(encode(t or ""), np.int32(end_id))

    return _with_ids(df, text, make)


def _decoder(path: str) -> Callable[[np.ndarray], str]:
    """The text of ids, as the library gives it. Byte-level tokens are bytes: they are looked up and joined."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    with open(path, encoding="utf8") as f:
        plain = (json.load(f).get("decoder") or {}).get("type") == "ByteLevel"
    if not plain:
        return lambda x: lib.decode(x.tolist(), skip_special_tokens=False)
    # printable Latin-1 bytes stand for themselves, the others for U+0100 and up in order (fixed values)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    made = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in lib.get_vocab(with_added_tokens=True).items()}
    return lambda x: b"".join([made.get(i, b"") for i in x.tolist()]).decode("utf8", "replace")


def detokenize(df: DataFrame, path: str, end_id: int, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text of token ids by a public vocabulary file, without the end_id they may end with; bytes that are no whole character become U+FFFD. Null ids give a null."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        text = _decoder(path)
        for s in batches:
            yield pd.Series([None if x is None else text(np.asarray(x)) for x in s], dtype=object)

    ended = F.element_at(ids, F.when(F.size(ids) > 0, -1)) == end_id
    return df.withColumn(name, decode(F.when(ended, F.slice(ids, F.lit(1), F.size(ids) - 1)).otherwise(F.col(ids))))


def stop_at_blank(text: Column) -> Column:
    """The text before its first blank line, stripped."""
    return F.regexp_replace(F.element_at(F.split(text, "\n\n", 2), 1), r"(?U)^\s+|\s+$", "")
