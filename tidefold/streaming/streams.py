"""Structured Streaming: windowed counts with a watermark, and neurons with keyed state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import ship

#: Groups of keys whose state is kept together, and rows of an output batch.
BUCKETS, OUT_ROWS = 1024, 100_000


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of files; the time column is read in UTC and gets a zone, which a watermark needs."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # a file stream wants a folder: the one that holds the table, and only this table's files
    single = spark.read.parquet(f"{folder}/events.parquet").inputFiles()
    inside = any("/events.parquet/" in f for f in single)
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(f"{folder}/events.parquet") if inside else reader.option("pathGlobFilter", "events.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, event_type, n, total of tumbling windows; events later than the watermark allows are dropped."""
    out = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def _by_bucket(rows: DataFrame):
    """rows grouped by a hash of user_id: each group holds the rows of many keys, so a call of Python is not spent on each key. Rows without a user_id have a bucket of their own, -1."""
    ship(rows.sparkSession)
    bucket = F.when(F.col("user_id").isNotNull(), F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS))).otherwise(F.lit(-1).cast("bigint"))
    return rows.withColumn("__bucket", bucket).withColumn("user_id", F.coalesce("user_id", F.lit(0).cast("bigint"))).groupBy("__bucket")


def _feed(known: dict[int, float], users: np.ndarray, values: np.ndarray, tau: float, theta: float, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(spikes, voltages) of rows that lie key by key and in order; known holds each key's voltage before and, changed in place, after them."""
    spikes, volts = np.zeros(len(values), np.int32), np.zeros(len(values))
    borders = [0, *(np.flatnonzero(np.diff(users)) + 1).tolist(), len(users)] if len(users) else [0]
    for a, e in pairwise(borders):
        user = int(users[a])
        v = known.get(user, 0.0)
        for k, x in enumerate(values[a:e].tolist(), a):
            v = v + (x / scale - v) / tau
            if v >= theta:
                spikes[k], v = 1, 0.0
            volts[k] = v
        known[user] = v
    return spikes, volts


def _packed(known: dict[int, float]) -> tuple[bytes, bytes]:
    return np.fromiter(known.keys(), np.int64, len(known)).tobytes(), np.fromiter(known.values(), np.float64, len(known)).tobytes()


def _unpacked(users: bytes, volts: bytes) -> dict[int, float]:
    return dict(zip(np.frombuffer(users, np.int64).tolist(), np.frombuffer(volts, np.float64).tolist(), strict=True))


def _spiked(bucket: int, users: np.ndarray, events: np.ndarray, spikes: np.ndarray, volts: np.ndarray) -> Iterator[pd.DataFrame]:
    for a in range(0, len(users), OUT_ROWS):
        s = slice(a, a + OUT_ROWS)
        yield pd.DataFrame({"user_id": None if bucket < 0 else users[s], "event_id": events[s], "spike": spikes[s], "v": volts[s]})


def keyed_neuron(stream: DataFrame, tau: float = 2.0, theta: float = 1.0, scale: float = 100.0) -> DataFrame:
    """A leaky neuron for each user_id whose voltage is kept between micro-batches: user_id, event_id, spike, v.

    State is one number a key, kept for BUCKETS groups of keys; rows of a micro-batch are put in order before they are fed, and rows older than the last time fed are fed where they arrive."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = _unpacked(*state.get) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["user_id", "ts", "event_id"])
        users, events = rows["user_id"].to_numpy(), rows["event_id"].to_numpy()
        spikes, volts = _feed(known, users, rows["value"].to_numpy(), tau, theta, scale)
        state.update(_packed(known))
        yield from _spiked(key[0], users, events, spikes, volts)

    rows = _by_bucket(stream.select("user_id", "event_id", "ts", "value"))
    return rows.applyInPandasWithState(step, "user_id bigint, event_id bigint, spike int, v double", "u binary, v binary", "append", "NoTimeout")


def ordered_neuron(stream: DataFrame, late: str = "1 day", tau: float = 2.0, theta: float = 1.0, scale: float = 100.0) -> DataFrame:
    """keyed_neuron in event time: a row is fed only when the watermark (the latest time so far less ``late``) has passed it, and then in order of (ts, event_id).

    However rows fall into micro-batches, the result is the same, so long as none is later than ``late``; such rows are dropped. Rows that wait are state, that of
    BUCKETS groups of keys, as bytes: those of the last ``late`` and of one micro-batch at most (maxFilesPerTrigger bounds that); an event-time timeout feeds them when no new row comes.
    Rows that the watermark does not reach are not fed. A null value is no input; rows without a time are left out."""
    columns = {"user_id": np.int64, "__t": np.int64, "event_id": np.int64, "value": np.float64}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, parts = {}, [[np.zeros(0, k)] for k in columns.values()]
        if state.exists:
            old = state.get
            known, parts = _unpacked(*old[:2]), [[np.frombuffer(w, k)] for w, k in zip(old[2:], columns.values(), strict=True)]
        for b in batches:
            for part, (c, kind) in zip(parts, columns.items(), strict=True):
                part.append(b[c].to_numpy(kind, na_value=0))
        users, t, events, values = (np.concatenate(p) for p in parts)
        ready = t < state.getCurrentWatermarkMs() * 1000  # times before the watermark: none of them can come any more
        order = np.flatnonzero(ready)
        order = order[np.lexsort((events[order], t[order], users[order]))]
        spikes, volts = _feed(known, users[order], values[order], tau, theta, scale)
        state.update((*_packed(known), *(w[~ready].tobytes() for w in (users, t, events, values))))
        if len(order) < len(t):
            state.setTimeoutTimestamp(int(t[~ready].min() // 1000))
        yield from _spiked(key[0], users[order], events[order], spikes, volts)

    held = "known binary, v binary, u binary, t binary, e binary, x binary"
    timed = stream.where("ts is not null").withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("__t"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    return _by_bucket(timed).applyInPandasWithState(step, "user_id bigint, event_id bigint, spike int, v double", held, "append", "EventTimeTimeout")


def run_once(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a stream over what is there now into parquet files (exactly once, by its checkpoint) and reads them back.

    In complete mode the last micro-batch holds the whole result."""
    spark = stream.sparkSession
    base = folder or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="stream")
    at = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{at}/out").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
