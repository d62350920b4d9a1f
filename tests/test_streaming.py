"""A neuron in event time: the same result however rows are cut into micro-batches."""

import os
import random

from tidefold.streaming import streams

SCHEMA = "user_id bigint, event_id bigint, value double, ts timestamp"


def _run(spark, folder, name, batches, late="1 hour"):
    at = folder / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "user_id bigint, event_id bigint, value double, s double").selectExpr("user_id", "event_id", "value", "timestamp_micros(bigint(s * 1000000)) as ts").coalesce(1).write.parquet(f"{at}/w{k}")
        (part,) = (at / f"w{k}").glob("*.parquet")
        part.rename(at / f"{k:03d}.parquet")
        os.utime(at / f"{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken in the order of their times
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(at))
    out = streams.run_once(streams.ordered_neuron(stream, late), folder=f"file://{folder}/{name}-out").collect()
    assert len({r["event_id"] for r in out}) == len(out)
    return {(r["user_id"], r["event_id"]): (r["spike"], r["v"]) for r in out}


def _want(rows, late=3600):
    mark = int(max(r[3] for r in rows if r[3] is not None) * 1000) - late * 1000
    out, volts = {}, {}
    for user, event, value, s in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[3], r[1])):
        if s * 1000 < mark:
            v = volts.get(user, 0.0)
            v = v + ((value or 0.0) / 100 - v) / 2
            spike = int(v >= 1)
            volts[user] = 0.0 if spike else v
            out[user, event] = (spike, volts[user])
    return out


def test_any_cut_gives_the_same(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3]), k, rng.choice([None, 50.0, 250.0, 400.0]), 1_700_000_000 + 300.0 * k + rng.choice([0, 0.25])) for k in range(60)]
    rows += [(9, 100, 300.0, rows[0][3]), (9, 101, 100.0, rows[0][3]), (1, 102, 70.0, None)]  # ties; a key that never comes again; no time
    want = _want(rows)
    assert len(want) > 40 and any(s for s, _ in want.values())
    for name, size, mixed in (("one", 99, 0), ("few", 16, 0), ("late", 9, 8)):
        # arrival: each row up to ``mixed`` places away, which is under an hour
        arrived = sorted(rows, key=lambda r: (r[3] or 0) + rng.random() * 300 * mixed)
        assert _run(spark, tmp_path, name, [arrived[a : a + size] for a in range(0, len(arrived), size)]) == want, name


def test_keys_share_calls_and_state(spark, tmp_path, monkeypatch):
    """Python is called for a bucket of keys, not for each key; the voltages of keys, of no user too, stay apart."""
    monkeypatch.setattr(streams, "BUCKETS", 4)
    rng = random.Random(6)
    users = [None, *range(-3, 300)]
    rows = [(rng.choice(users), k, rng.choice([50.0, 250.0, 400.0]), 1_700_000_000 + 10.0 * k) for k in range(1500)]
    want = _want(rows)
    assert len({u for u, _ in want}) > 250 and any(s for s, _ in want.values())
    for name, size in (("one", 1500), ("some", 600)):
        assert _run(spark, tmp_path, name, [rows[a : a + size] for a in range(0, len(rows), size)]) == want, name
    calls = spark.sparkContext.accumulator(0)
    feed = streams._feed

    def counted(*args):
        calls.add(1)
        return feed(*args)

    monkeypatch.setattr(streams, "_feed", counted)
    stream = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "some"))
    out = streams.run_once(streams.keyed_neuron(stream), folder=f"file://{tmp_path}/keyed").collect()
    assert {(r["user_id"], r["event_id"]): (r["spike"], r["v"]) for r in out} == _want(rows, -1)
    assert 0 < calls.value <= 5
