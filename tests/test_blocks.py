"""Blocks, ranges and lockstep against plain loops: hot keys over many partitions, null keys, ties of length, windows of few rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.functions import blocks, ordered
from tidefold.operators import corpus, frames, lookups
from tidefold.operators import recurrences as rec


@pytest.fixture(scope="module")
def rows():
    """A hot key with most rows, small keys, a null key; inputs hold nulls."""
    rng = np.random.default_rng(3)
    out, n = [], 0
    for key, size in ((5, 700), (None, 40), (9, 1), (1, 90), (7, 200)):
        for t in np.sort(rng.integers(0, 4000, size)).tolist():
            x = None if rng.random() < 0.05 else float(rng.normal() + 0.5)
            out.append((key, t, n, x, int(rng.random() < 0.3), "same"))
            n += 1
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "sample bigint, t bigint, event_id bigint, x double, s int, __note string").repartition(6).cache()


def _by_key(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    return by


def _got(out, *names):
    return {r["event_id"]: tuple(r[c] for c in names) for r in out.collect()}


@pytest.mark.parametrize("hot", [0, 1 << 20])
def test_filters(df, rows, hot):
    w, u = -0.3, 0.2
    got = {
        "y": _got(rec.wkv(df, w, u, "x", "s", hot_rows=hot), "y", "__note"),
        "current": _got(rec.synapse(df, 5.0, "s", hot_rows=hot), "current"),
        "traces": _got(rec.traces(df, 4.0, 9.0, "s", "x", (1.0, -1.0), (0.1, -0.2), hot_rows=hot), "tr_pre", "tr_post", "weight"),
        "norm": _got(rec.normalised(df, 0.9, 0.1, 5, "s", "x", hot_rows=hot), "norm_out"),
        "ema": _got(rec.ema(df, 0.2, "x", hot_rows=hot), "ema"),
    }
    assert all(len(g) == len(rows) for g in got.values())
    for key_rows in _by_key(rows).values():
        p = q = i = a = b = z = 0.0
        o, weight, m = -1e38, 0.5, None
        for _, _, event, x, s, _ in key_rows:
            k, v = x or 0.0, float(s)
            top = max(o, u + k)
            y = (math.exp(o - top) * p + math.exp(u + k - top) * v) / (math.exp(o - top) * q + math.exp(u + k - top))
            top = max(w + o, k)
            p, q, o = math.exp(w + o - top) * p + math.exp(k - top) * v, math.exp(w + o - top) * q + math.exp(k - top), top
            i = i - (1 - s) * i / 5 + s
            a, b = a - a / 4 + s, b - b / 9 + k
            weight += ((1 - weight) * s + (0.1 - 0.2 * weight) * k) * 0.1
            z = 0.9 * z + 0.1 / 25 * k
            m = m if x is None else x if m is None else 0.8 * m + 0.2 * x
            assert got["y"][event] == (pytest.approx(y), "same") and got["current"][event][0] == pytest.approx(i)
            assert got["traces"][event] == pytest.approx((a, b, weight)) and got["norm"][event][0] == pytest.approx(s - 0.1 * z)
            assert got["ema"][event][0] == (None if m is None else pytest.approx(m))


def test_a_hot_key_lies_in_many_tasks(df):
    hot = df.where("sample = 5")
    parts = blocks.ranged(hot, ["sample"], ["t", "event_id"], 0).rows.groupBy("__part").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 300


def test_prefixes_by_doubling():
    rng = np.random.default_rng(1)
    a, b = rng.random(500), rng.random(500)
    fresh = rng.random(500) < 0.02
    got = blocks.prefixes((a, b), fresh, blocks.affine)
    h, want = 0.0, []
    for k in range(500):
        h = b[k] if fresh[k] or k == 0 else a[k] * h + b[k]
        want.append(h)
    assert got[1] == pytest.approx(np.array(want))


@pytest.mark.parametrize("window,lanes", [(1 << 16, 6), (64, 6), (64, 1), (150, 100)])
def test_lockstep_is_sequential(monkeypatch, spark, df, rows, window, lanes):
    monkeypatch.setattr(ordered, "WINDOW", window)
    monkeypatch.setattr(ordered, "LANES", lanes)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = _got(rec.neuron(df, rec.leaky(2.3)), "spike", "v", "out")
        back = _got(rec.bidirectional(df.withColumn("xs", F.array(F.coalesce("x", F.lit(0.0)), F.col("s").cast("double"))), rec.vanilla_cell, w_in=np.eye(2), w_hid=np.eye(2) * 0.5, bias=np.array([-0.4, -0.2])), "hs", "hs_back")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for key_rows in _by_key(rows).values():
        v = 0.0
        for _, _, event, x, _, _ in key_rows:
            v = v + ((x or 0.0) - v) / 2.3
            s = int(v >= 1)
            v = 0.0 if s else v
            assert got[event] == (s, v, float(s))
        for at, order in ((0, key_rows), (1, key_rows[::-1])):
            h = np.zeros(2)
            for _, _, event, x, s, _ in order:
                h = (np.array([x or 0.0, s]) + 0.5 * h + [-0.4, -0.2] >= 0).astype(float)
                assert back[event][at] == h.tolist()


def test_steps_on_no_rows(df):
    empty = df.where("false")
    assert rec.neuron(empty, rec.integrate()).count() == 0 and rec.wkv(empty, -1.0, 0.0, "x", "s", hot_rows=-1).count() == 0 and rec.ema(empty, value="x").count() == 0


@pytest.mark.parametrize("hot", [0, 1 << 20])
def test_ranges(df, rows, hot):
    number = _got(lookups.number_within(df, ["sample"], ["t", "event_id"], hot_rows=hot), "k")
    before = _got(corpus.time_shift(df, "x", hot_rows=hot), "before")
    first = _got(frames.first_spike(df, "s", hot_rows=hot), "first")
    kept = _got(frames.temporal_delete(df, 25, 3, hot_rows=hot), "pos")
    clusters = {}
    for r in frames.spike_clusters(df, "s", 20, hot_rows=hot).collect():
        clusters.setdefault(r["sample"], []).append((r["cluster"], r["first"], r["last"], r["n"]))
    for key, key_rows in _by_key(rows).items():
        assert [number[r[2]][0] for r in key_rows] == list(range(len(key_rows)))
        assert [before[r[2]][0] for r in key_rows] == [0.0, *[r[3] for r in key_rows[:-1]]]
        spikes = [r for r in key_rows if r[4]]
        assert [r[2] for r in key_rows if first[r[2]][0]] == [r[2] for r in spikes[:1]]
        mine = [kept[r[2]][0] for r in key_rows if r[2] in kept]
        assert mine == list(range(min(25, len(key_rows))))
        want: list[list[int]] = []
        for r in spikes:
            if not want or r[1] - want[-1][2] > 20:
                want.append([len(want), r[1], r[1], 0])
            want[-1][2], want[-1][3] = r[1], want[-1][3] + 1
        assert sorted(clusters.get(key, [])) == [tuple(c) for c in want]
    assert _got(frames.temporal_delete(df, 25, 3, hot_rows=0), "pos") == _got(frames.temporal_delete(df, 25, 3), "pos")


@pytest.mark.parametrize("duration", [0, 3, 25, 700, 100_000])
def test_anchored_frames_in_ranges(spark, df, rows, duration):
    even = [(11, 2 * k, 10_000 + k, None, 0, "even") for k in range(400)]  # openings from different events never meet
    both = df.unionByName(spark.createDataFrame(even, df.schema))
    got = _got(frames.anchored(both, duration, hot_rows=0), "frame", "__note")
    assert got == _got(frames.anchored(both, duration), "frame", "__note") and len(got) == len(rows) + 400
    for key_rows in _by_key([*rows, *even]).values():
        opened, k = None, -1
        for r in key_rows:
            if opened is None or r[1] - opened > duration:
                opened, k = r[1], k + 1
            assert got[r[2]][0] == k
