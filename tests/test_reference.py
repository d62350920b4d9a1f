"""Every registered query against DuckDB on the smallest tables, and hand-worked cases."""

import math
import os

import duckdb
import numpy as np
import pytest

from tidefold.functions import scalar
from tidefold.operators import corpus, decoding, encoding, frames, lookups, metrics, sampling
from tidefold.operators import recurrences as rec
from tidefold.plans import registry
from tidefold.sources import binary, indexed, text
from tidefold.streaming import streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _canon(df):
    def f(v):
        if isinstance(v, (list, np.ndarray)):
            return "[" + ",".join(f(x) for x in v) + "]"
        if v is None or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, (float, np.floating)):
            return repr(round(float(v), 6) + 0.0)
        return str(int(v)) if isinstance(v, (int, np.integer)) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(f(v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        want = con.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _canon(got) == _canon(want)
    else:
        assert len(got)


def _events(spark, ts, **cols):
    rows = [(1, k, t, *(c[k] for c in cols.values())) for k, t in enumerate(ts)]
    return spark.createDataFrame(rows, ["sample", "event_id", "t", *cols]) if rows else spark.createDataFrame([], "sample bigint, event_id bigint, t bigint")


def _sizes(df):
    return [r["n"] for r in df.groupBy("frame").count().withColumnRenamed("count", "n").orderBy("frame").collect()]


def test_frame_rules(spark):
    assert _sizes(frames.equal_count(_events(spark, range(10)), 4)) == [2, 2, 2, 4]
    assert _sizes(frames.equal_count(_events(spark, range(3)), 4)) == [3]
    six = _events(spark, [0, 1, 2, 5, 9, 10])
    assert _sizes(frames.equal_time(six, 2)) == [3, 3]
    assert _sizes(frames.equal_time(_events(spark, [7, 7, 7]), 3)) == [3]
    framed = frames.equal_time(six, 3).withColumns({"x": scalar.F.lit(0), "y": scalar.F.lit(0), "p": scalar.F.lit(0)})
    assert [r["n"] for r in frames.dense(frames.histogram(framed), 3).orderBy("frame").collect()] == [3, 1, 2]
    assert _sizes(frames.anchored(_events(spark, [0, 3, 5, 6, 11]), 5)) == [3, 2]
    assert frames.equal_time(_events(spark, []), 3).count() == 0


def test_histogram(spark):
    ev = _events(spark, range(4), x=[1, 2, 1, 1], y=[1, 1, 1, 2], p=[0, 1, 0, 1]).withColumn("frame", scalar.F.lit(0))
    got = {(r["channel"], r["y"], r["x"]): r["n"] for r in frames.histogram(ev).collect()}
    assert got == {(0, 1, 1): 2, (1, 1, 2): 1, (1, 2, 1): 1}


def test_neurons(spark):
    out = rec.neuron(_events(spark, range(4), x=[1.0, 1.0, 2.0, 0.0]), rec.leaky(2.0)).orderBy("t").collect()
    assert [r["spike"] for r in out] == [0, 0, 1, 0] and [r["v"] for r in out] == [0.5, 0.75, 0.0, 0.0]
    out = rec.neuron(_events(spark, range(3), x=[0.6, 0.6, 0.6]), rec.learnable(2.0), v_reset=None).orderBy("t").collect()
    assert [r["spike"] for r in out] == [0, 0, 1] and np.allclose([r["v"] for r in out], [0.6, 0.9, 0.05])
    out = rec.synapse(_events(spark, range(3), spike=[1, 0, 0]), 2.0).orderBy("t").collect()
    assert [r["current"] for r in out] == [1, 0.5, 0.25]
    assert rec.neuron(_events(spark, range(2), x=[None, 3.0]), rec.integrate()).orderBy("t").collect()[1]["spike"] == 1


def test_nucleus_rules(spark):
    dist = lambda ps: spark.createDataFrame([(1, i, p) for i, p in enumerate(ps)], "row int, item int, p double")
    ties = dist([0.4, 0.2, 0.2, 0.2])
    assert decoding.nucleus(ties, 0.5).count() == 2 and decoding.nucleus_cutoff(ties, 0.5).count() == 4
    whole = dist([0.5, 0.3, 0.15, 0.05])
    assert decoding.nucleus(whole, 1.0).count() == 4 and decoding.nucleus_cutoff(whole, 1.0).count() == 1


def test_encoders(spark):
    F = scalar.F
    row = spark.range(1).select(encoding.latency(F.lit(0.5), 18).alias("a"), encoding.weighted_phase(F.lit(192 / 256), 8).alias("b"), encoding.weighted_phase(F.lit(1 / 256), 8).alias("c"), encoding.weighted_phase(F.lit(1.0), 8).alias("d")).first()
    assert row["a"] == 8 and row["b"] == [1, 1, 0, 0, 0, 0, 0, 0] and row["c"] == [0] * 7 + [1] and row["d"] is None
    assert spark.range(1).select(scalar.unpack_bits(scalar.pack_bits(F.array(*[F.lit(k % 3 % 2) for k in range(11)])), F.lit(11)).alias("u")).first()["u"] == [k % 3 % 2 for k in range(11)]


def test_tempotron_reads_every_event(spark, tmp_path):
    rng = np.random.default_rng(4)
    kinds = sorted(("click", "error", "purchase", "signup", "view"))
    rows = [(u * 1000 + k, u, k, kinds[rng.integers(5)]) for u, n in ((1, 3), (2, 20), (3, 21), (4, 300)) for k in range(n)]
    e = spark.createDataFrame(rows, "event_id bigint, user_id bigint, k bigint, event_type string")
    e.selectExpr("event_id", "timestamp_micros(k) AS ts", "user_id", "event_type", "1.0D AS value", "'{\"k\":1}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    v0, t = encoding.psp_scale(), np.arange(50)
    want = {}
    for u in (1, 2, 3, 4):
        v = np.zeros(50)
        for _, _, k, kind in (r for r in rows if r[1] == u):
            s = (k + 1) % 40
            v += np.where(t >= s, np.exp(-(t - s) / 15.0) - np.exp(-(t - s) / 3.75), 0) * v0 * 0.1 * (kinds.index(kind) + 1)
        want[u] = (v.max(), int(v.argmax()))
    out = {r["sample"]: r for r in registry.QUERIES["tempotron"](spark, str(tmp_path)).collect()}
    assert set(out) == set(want)
    for u, (top, at) in want.items():
        assert math.isclose(out[u]["v_max"], top, abs_tol=2e-6) and out[u]["t_max"] == at and out[u]["spike"] == (at if top >= 1 else -at)
    loss = registry.QUERIES["tempotron_loss"](spark, str(tmp_path)).first()["loss"]
    assert math.isclose(loss, sum((top - 1) ** 2 for u, (top, _) in want.items() if (top >= 1) != u % 2) / 4, abs_tol=2e-6)


def test_cosine_transform_covers_every_block(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(5, 8, 8))
    rows = [(k, [float(e) for e in m.ravel()]) for k, m in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    a = np.array([[math.sqrt((1 if k == 0 else 2) / 4) * math.cos((i + 0.5) * math.pi * k / 4) for i in range(4)] for k in range(4)])
    want = np.zeros_like(x)
    for i in (0, 4):
        for j in (0, 4):
            want[:, i : i + 4, j : j + 4] = a @ x[:, i : i + 4, j : j + 4] @ a.T
    out = {r["vec_id"]: r["y"] for r in registry.QUERIES["cosine_transform"](spark, str(tmp_path)).collect()}
    assert len(out) == 5 and all(len(y) == 64 and np.allclose(np.reshape(y, (8, 8)), want[k], atol=1e-5) for k, y in out.items())


def test_threshold_margins_of_every_item(spark, tmp_path):
    rows = [(k, label, [0.0] * 64) for k, label in enumerate((3, 9, 10, 63))]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = {(r["row"], r["item"]): r["theta"] for r in registry.QUERIES["threshold_margins"](spark, str(tmp_path)).collect()}
    assert out == {(k, i): 1.1 if i == label else 0.9 for k, label, _ in rows for i in range(64)}


def test_alignment_and_log(spark):
    layers = lambda n: spark.createDataFrame([(i, i / 10) for i in range(n)], "layer int, mean double")
    got = [r["a_layer"] for r in metrics.align(layers(12), layers(18), 12, 18).orderBy("i").collect()]
    assert got[:4] == [0, 1, 1, 2] and len(got) == 18
    lines = spark.createDataFrame([("1 train 2.0 7.4 0.1 2024-01-01 00:00:00",), ("bad",), ("x train 1 2 3",), ("1 train 1.0 2.7 0.1 2024-01-02 00:00:00",)], "value string")
    assert [r["loss"] for r in text.parse_log(lines).orderBy("at").collect()] == [2.0, 1.0]


def test_stats_documents(spark, tmp_path):
    node = '{"mean": 0.5, "std": 0.1, "tau": 1.4, "threshold": 0.7}'
    (tmp_path / "s.json").write_text(f'{{"checkpoint": "c",\n"layers": {{"0": {{"lif1": {node}, "lif2": {node}}}, "10": {{"lif1": {node}, "lif2": {node}}}}}}}')
    rows = text.layer_rows(text.read_stats(spark, str(tmp_path / "s.json"))).collect()
    assert sorted({r["layer"] for r in rows}) == [0, 10] and len(rows) == 4


def test_first_spike_and_clusters(spark):
    ev = _events(spark, [0, 1, 2, 10, 11], spike=[0, 1, 1, 1, 0], v=[0.2, 1.0, 1.0, 1.0, 0.9])
    assert [r["first"] for r in frames.first_spike(ev, "spike").orderBy("t").collect()] == [0, 1, 0, 0, 0]
    clusters = frames.spike_clusters(ev, "spike", 2)
    assert sorted((r["first"], r["last"], r["n"]) for r in clusters.collect()) == [(1, 2, 2), (10, 10, 1)]
    peak = frames.peak_outside_clusters(ev, clusters, "v", 1.0).first()
    assert (peak["peak_t"], peak["smallest_end"]) == (11, 10)


def test_intervals_with_and_without_slots(spark):
    ev = spark.createDataFrame([("a", t) for t in range(0, 100, 3)], "k string, t bigint")
    iv = spark.createDataFrame([("a", 5, 50, 1), ("a", 40, 60, 2), ("b", 0, 99, 3), ("a", 9, 9, 4)], "k string, s bigint, e bigint, label int")
    plain = sorted(map(tuple, lookups.interval_join(ev, iv, "k", "t", "s", "e").select("t", "label").collect()))
    assert plain == sorted(map(tuple, lookups.interval_join(ev, iv, "k", "t", "s", "e", width=7).select("t", "label").collect()))
    assert plain == sorted([(t, 1) for t in range(0, 100, 3) if 5 <= t < 50] + [(t, 2) for t in range(0, 100, 3) if 40 <= t < 60])


def test_blank_filter_and_tokens(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, " \t\n"), (3, "　"), (4, " a ")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in corpus.not_blank(df).collect()] == [4]
    toks = spark.createDataFrame([(k, list(range(k % 4))) for k in range(9000, 9050)], "doc_id bigint, tokens array<int>")
    got = [r["token"] for r in corpus.flatten(toks, "doc_id", "tokens").orderBy("pos").collect()]
    assert got == [t for k in range(9000, 9050) for t in range(k % 4)]


def test_uniform_is_the_same_in_sql(spark):
    got = [r[0] for r in spark.range(50).select(sampling.uniform(3, scalar.F.col("id"))).collect()]
    want = [r[0] for r in duckdb.sql(f"SELECT {sampling.uniform_sql(3, 'id')} FROM (SELECT unnest(range(50)) AS id)").fetchall()]
    assert got == want and 0 <= min(got) < max(got) < 1


def test_surrogates_are_slopes_of_steps():
    for kind in ("piecewise_exp", "sigmoid", "soft_sign", "atan", "sign_log_abs", "squarewave_fourier"):
        for x in (-0.7, 0.3):
            f = lambda v, k=kind: duckdb.sql(f"SELECT {scalar.duck(scalar.smooth_step(k, 2.0))} FROM (SELECT {v}::DOUBLE AS x)").fetchall()[0][0]
            g = duckdb.sql(f"SELECT {scalar.duck(scalar.slope(kind, 2.0))} FROM (SELECT {x}::DOUBLE AS x)").fetchall()[0][0]
            assert math.isclose((f(x + 1e-5) - f(x - 1e-5)) / 2e-5, g, rel_tol=1e-3)


def test_binary_decoders(spark, tmp_path):
    x, y, p, t = [3, 200], [7, 9], [1, 0], [5, 70000]
    raw = b"".join(bytes([a, b, c << 7 | d >> 16, d >> 8 & 255, d & 255]) for a, b, c, d in zip(x, y, p, t))
    e = binary.atis40(raw)
    assert e["x"].tolist() == x and e["y"].tolist() == y and e["p"].tolist() == p and e["t"].tolist() == t
    words = np.array([5 << 17 | 6 << 2 | 1 << 1, 1000], "<u4").tobytes()
    head = np.array([1, 0], "<u2").tobytes() + np.array([8, 4, 1, 1, 1, 1], "<u4").tobytes()
    e = binary.aedat3(b"#!AER-DAT3.1\r\n#!END-HEADER\r\n" + head + words)
    assert (e["x"][0], e["y"][0], e["p"][0], e["t"][0]) == (5, 6, 1, 1000 | 1 << 31)
    e = binary.aedat2(b"#header\r\n" + np.array([10 << 1 | 20 << 8 | 1, 99], ">u4").tobytes())
    assert (e["x"][0], e["y"][0], e["p"][0], e["t"][0]) == (107, 117, 0, 99)
    td = np.array([100 | 3 << 32 | 4 << 41 | 1 << 49, 90, 120], "<u8").tobytes()
    e = binary.atis_td(b"% a\n% b\n" + bytes([0, 8]) + td)
    assert e["t"].tolist() == [0, 20] and (e["x"][0], e["y"][0], e["p"][0]) == (3, 4, 1)
    pn = binary.npz_bytes(pos=np.array([[1, 2, 30]]), neg=np.array([[3, 4, 10], [5, 6, 40]]))
    e = binary.pos_neg_npz(pn)
    assert e["t"].tolist() == [10, 30, 40] and e["x"].tolist() == [4, 2, 6] and e["p"].tolist() == [0, 1, 0]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin40").write_bytes(raw)
    assert binary.read_events(spark, str(tmp_path / "d"), "atis40").count() == 2
    items = [np.array([1, 2, 3]), np.array([], int), np.array([65535])]
    data, index = binary.write_index(items)
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "c.bin").write_bytes(data)
    (tmp_path / "i" / "c.idx").write_bytes(index)
    rows = indexed.read_indexed(spark, str(tmp_path / "i")).orderBy("item").collect()
    assert [r["tokens"] for r in rows] == [[1, 2, 3], [], [65535]]
    np.save(tmp_path / "t.npy", np.arange(5, dtype=np.uint16))
    assert [r["token"] for r in binary.read_npy(spark, str(tmp_path)).orderBy("pos").collect()] == [0, 1, 2, 3, 4]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "f.npz").write_bytes(binary.npz_bytes(frames=np.eye(3)[None, None].repeat(2, 1)))
    assert binary.read_frames(spark, str(tmp_path / "f")).count() == 6


def test_keyed_state_survives_batches(spark, tmp_path):
    for k in range(2):
        rows = spark.createDataFrame([(1, 10 * k + i, 100.0) for i in range(3)], "user_id bigint, event_id bigint, value double").withColumns({"ts": scalar.F.lit(f"2024-01-0{k + 1}").cast("timestamp"), "event_type": scalar.F.lit("a")})
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.run_once(streams.keyed_neuron(stream), folder=f"file://{tmp_path}/out")
    assert [r["v"] for r in out.orderBy("event_id").collect()] == [1 - 0.5**k for k in range(1, 7)]
    late = streams.tumbling_counts(stream)
    assert late.isStreaming


def test_training_log_round_trip(spark, tmp_path):
    log = spark.createDataFrame([(1, "train", 2.5, 12.1825, 0.0006, "2024-01-01 00:00:00")], "epoch int, split string, loss double, ppl double, lr double, at string")
    text.append_log(log, str(tmp_path / "log"))
    text.append_log(log, str(tmp_path / "log"))
    assert text.parse_log(spark.read.text(str(tmp_path / "log"))).count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_whole_rows_by_numpy(spark, con):
    """Neither query nor SQL may leave out events, items or components: both against numpy on whole rows."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    spikes, count = {}, {}
    for user, kind in con.execute("SELECT user_id, event_type FROM events ORDER BY user_id, ts, event_id").fetchall():
        count[user] = count.get(user, 0) + 1
        spikes.setdefault(user, []).append((count[user] % 40, 0.1 * (kinds.index(kind) + 1)))
    peak = {r["sample"]: r["v_max"] for r in registry.QUERIES["tempotron"](spark, SF).collect()}
    t = np.arange(50)
    for user, seen in spikes.items():
        v = sum(w * np.where(t >= at, np.exp(-(t - at) / 15) - np.exp(-(t - at) / 3.75), 0) for at, w in seen)
        assert math.isclose(peak[user], float(np.max(v)) * encoding.psp_scale(), abs_tol=2e-6)
    emb = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    a = np.array([[math.sqrt((1 if k == 0 else 2) / 4) * math.cos((i + 0.5) * math.pi * k / 4) for i in range(4)] for k in range(4)])
    got = {r["vec_id"]: r["y"] for r in registry.QUERIES["cosine_transform"](spark, SF).collect()}
    for k, v in emb:
        m = np.array(v, np.float64).reshape(8, 8)
        want = np.block([[a @ m[i : i + 4, j : j + 4] @ a.T for j in (0, 4)] for i in (0, 4)])
        assert np.allclose(got[k], want.ravel(), atol=2e-5)
    assert registry.QUERIES["threshold_margins"](spark, SF).count() == sum(len(v) for _, v in emb)


@pytest.mark.parametrize("hot", [0, 1000])
def test_hot_groups_are_ranked_in_parts(spark, monkeypatch, hot):
    monkeypatch.setattr(sampling, "PART_ROWS", 7)
    rng = np.random.default_rng(3)
    rows = [(int(g), k, int(rng.integers(0, 50))) for k, g in enumerate(rng.choice([1, 1, 1, 2, 3], 400))]
    df = spark.createDataFrame([(None if g == 3 else g, k, t) for g, k, t in rows], "sample bigint, event_id bigint, t bigint")
    by = {}
    for g, k, t in rows:
        by.setdefault(None if g == 3 else g, []).append((t, k))
    want = {k: place for g in by.values() for place, (_, k) in enumerate(sorted(g), 1)}
    assert {r["event_id"]: r["__k"] for r in sampling.ranked(df, "sample", ("t", "event_id"), hot).collect()} == want
    framed = {r["event_id"]: r["frame"] for r in frames.equal_count(df, 5, hot_rows=hot).collect()}
    size = {k: len(g) for g in by.values() for _, k in g}
    assert framed == {k: min((want[k] - 1) // (size[k] // 5), 4) for k in want}
    spans = {g: (min(v)[0], (max(v)[0] - min(v)[0]) // 4) for g, v in by.items()}
    assert {r["event_id"]: r["frame"] for r in frames.equal_time(df, 4).collect()} == {k: min((t - spans[g][0]) // spans[g][1], 3) for g, v in by.items() for t, k in v}
    kept = {r["event_id"] for r in sampling.subset(df, 0.3, 1, "sample", "event_id", randomly=False, hot_rows=hot).collect()}
    assert kept == {k for v in by.values() for k in sorted(k for _, k in v)[: int(0.3 * len(v))]}
    train = {r["event_id"]: r["is_train"] for r in sampling.stratified(df, 0.8, "sample", "event_id", seed=5, hot_rows=hot).collect()}
    assert set(train) == set(want) and all(sum(train[k] for _, k in v) == math.ceil(0.8 * len(v)) for v in by.values())
    assert sampling.subset(df.where("false"), 0.3, 1, "sample", "event_id", hot_rows=hot - 1).count() == 0 and frames.equal_count(df.where("false"), 3, hot_rows=hot - 1).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_tokens_are_the_librarys(spark, con):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    out = {r["doc_id"]: list(r["ids"]) for r in registry.QUERIES["tokenize_eos"](spark, SF).collect()}
    assert out == {k: [*lib.encode(t, add_special_tokens=False).ids, 50256] for k, t in texts.items() if t and not t.isspace()}


def test_decoded_tokens_are_the_text(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    texts = ["", "a", " two  spaces ", "日本語 naïve", "\t\n x", "<|endoftext|>", "long " * 30000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    out = corpus.detokenize(corpus.tokenize(df, path, 50256), path, 50256)
    assert {r["k"]: r["decoded"] for r in out.collect()} == dict(enumerate(texts))
    odd = spark.createDataFrame([(0, None), (1, []), (2, [50256])], "k int, ids array<int>")
    assert {r["k"]: r["decoded"] for r in corpus.detokenize(odd, path, 50256).collect()} == {0: None, 1: "", 2: ""}
    assert corpus.detokenize(odd.where("false"), path, 50256).count() == 0


def test_event_files_round_trip():
    rng = np.random.default_rng(1)
    e = {"t": np.sort(rng.integers(0, 2**33, 9000)), "x": rng.integers(0, 128, 9000), "y": rng.integers(0, 128, 9000), "p": rng.integers(0, 2, 9000)}
    back = binary.aedat3(binary.to_aedat3(e))
    assert all((back[k] == e[k]).all() for k in e)
    empty = {k: np.zeros(0, np.int64) for k in "txyp"}
    for kind in binary.ENCODERS:
        assert len(binary.DECODERS[kind](binary.ENCODERS[kind](empty))["t"]) == 0


def test_report_and_vocabulary_files(spark, tmp_path):
    lines = text.markdown(spark.createDataFrame([("b|c", None), ("a", "1")], "k string, v string"), "T", ["k"])
    text.write_markdown(lines, str(tmp_path / "r"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()] == ["# T", "", "| k | v |", "|-|-|", "| a | 1 |", "| b\\|c |  |"]
    vocabulary = spark.createDataFrame([('"', 0), ("\n", 1), ("日", 2)], "symbol string, id bigint")
    text.write_vocabulary(vocabulary, str(tmp_path / "v"))
    assert sorted(map(tuple, text.read_vocabulary(spark, str(tmp_path / "v")).collect())) == sorted(map(tuple, vocabulary.collect()))


def test_surrogate_fires_in_proportion(spark):
    out = rec.neuron(_events(spark, range(2), x=[1.0, 1.0]), rec.integrate(), fire=lambda u: 0.25).orderBy("t").collect()
    assert [r["out"] for r in out] == [0.25, 0.25] and [r["v"] for r in out] == [0.75, 1.3125]
    out = rec.neuron(_events(spark, [0], x=[1.0]), rec.integrate(), v_reset=None, fire=lambda u: 0.25).first()
    assert out["v"] == 0.75
