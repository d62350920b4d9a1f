"""MATLAB files by hand and by round trip; speech lists."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.sources import binary, datasets, matlab


@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("order", ["<", ">"])
def test_arrays_round_trip(compress, order):
    rng = np.random.default_rng(0)
    arrays = {"ts": rng.random(7), "x": np.arange(3, dtype=np.uint16), "m": np.arange(12, dtype=np.int32).reshape(3, 4), "b": np.array([1], np.uint8), "e": np.zeros(0), "long_name_of_it": np.array([2**40], np.int64)}
    got = matlab.read_arrays(matlab.write_arrays(arrays, compress, order))
    assert got.keys() == arrays.keys()
    for k, a in arrays.items():
        assert got[k].dtype == a.dtype and (got[k] == (a.reshape(-1, 1) if a.ndim < 2 else a)).all()


def test_doubles_stored_as_bytes_and_other_variables():
    """Whole doubles are stored in the smallest type that holds them; text and empty elements are skipped."""
    element = lambda kind, data: struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)
    small = lambda kind, data: struct.pack("<I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    head = b"by hand".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    ts = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", 1, 5)) + small(1, b"ts") + element(2, bytes([1, 2, 3, 4, 250]))
    note = element(6, struct.pack("<II", 4, 0)) + element(5, struct.pack("<ii", 1, 2)) + small(1, b"note") + small(4, b"h\0i\0")
    data = head + element(14, note) + struct.pack("<II", 15, len(z := zlib.compress(element(14, ts)))) + z
    got = matlab.read_arrays(data)
    assert list(got) == ["ts"] and got["ts"].dtype == np.float64 and got["ts"].tolist() == [[1, 2, 3, 4, 250]]
    for bad in (b"", b"x" * 200, data[:-3], head + struct.pack("<II", 14, 100)):
        with pytest.raises((ValueError, zlib.error)):
            matlab.read_arrays(bad)


def test_events_of_a_file():
    e = {"t": np.array([5, 2**33]), "x": np.array([1, 300]), "y": np.array([2, 0]), "p": np.array([0, 1])}
    got = binary.mat_events(binary.to_mat(e))
    assert all((got[k] == e[k]).all() for k in e)


def test_speech_lists(spark):
    paths = ["up/a_nohash_0.wav", "up/b_nohash_1.wav", "up/b_nohash_2.wav", "no/c_nohash_0.wav", "no/c_nohash_0.wav", "_background_noise_/x_nohash_0.wav", "no/plain.wav", "no/d_nohash_3.wav"]
    of = lambda rows: spark.createDataFrame([(p,) for p in rows], "path string")
    got = {r["path"]: r for r in datasets.speech(of(paths), of([paths[1], "gone"]), of([paths[7], paths[1]]), 4).collect()}
    assert {p: (r["label"], r["speaker"], r["utterance"], r["split"]) for p, r in got.items() if p} == {
        paths[0]: ("up", "a", 0, "train"), paths[1]: ("up", "b", 1, "test"), paths[2]: ("up", "b", 2, "train"), paths[3]: ("no", "c", 0, "train"), paths[7]: ("no", "d", 3, "test"),
    }
    # classes: up has two rows for training, no has one, silence four
    total = 1 / 2 + 1 + 1 / 4
    assert [got[p]["weight"] for p in (paths[0], paths[3], None, paths[1])] == pytest.approx([0.5 / total, 1 / total, 0.25 / total, None])
    assert datasets.speech(of([]), of([]), of([])).count() == 0


@pytest.mark.parametrize("kind,ending", [("atis40", "bin"), ("aedat2", "aedat"), ("aedat3", "aedat")])
@pytest.mark.parametrize("size", [1, 100, 1 << 20])
def test_ranges_of_files(spark, tmp_path, kind, ending, size):
    """Files read in ranges hold what the whole-file decoder finds; a first byte like that of a header, empty files and a cut last record do no harm."""
    from tidefold.sources import event_ranges

    rng = np.random.default_rng(1)
    want = {}
    for name, n in (("a", 57), ("b", 0), ("c", 9)):
        e = {"t": np.sort(rng.integers(0, 1 << 20, n)), "x": rng.integers(30, 40, n), "y": rng.integers(30, 40, n), "p": rng.integers(0, 2, n)}
        e = {k: v.astype(np.int64) for k, v in e.items()}
        data = binary.to_aedat3(e, 8) if kind == "aedat3" else binary.ENCODERS[kind](e)
        data += b"#x" if kind == "atis40" else b""
        (tmp_path / f"{name}.{ending}").write_bytes(data)
        got = binary.DECODERS[kind](data)
        want[name] = list(zip(*(got[k].tolist() for k in "txyp"), strict=True))
    out = event_ranges.read_ranges(spark, str(tmp_path), kind, f"*.{ending}", size)
    if size == 1:
        assert out.rdd.getNumPartitions() > 6
    rows = sorted((r["path"].rsplit("/", 1)[1][0], r["event_id"], r["t"], r["x"], r["y"], r["p"]) for r in out.collect())
    assert rows == sorted((name, k, *e) for name, events in want.items() for k, e in enumerate(events))
    with pytest.raises(Exception, match="no ranges"):
        event_ranges.read_ranges(spark, str(tmp_path), "npz").collect()


def test_small_ranges_share_tasks(spark, tmp_path):
    """Ranges far smaller than the files, and many small files, take a few tasks; files that hold no event are no task's harm."""
    from tidefold.sources import event_ranges

    e = {k: np.arange(40, dtype=np.int64) for k in "txyp"}
    e["p"] %= 2
    for k in range(60):
        (tmp_path / f"{k}.bin").write_bytes(binary.to_atis40(e) if k else b"")
    out = event_ranges.read_ranges(spark, str(tmp_path), "atis40", "*.bin", 5)
    assert out.rdd.getNumPartitions() < 60 < 59 * 40
    rows = out.groupBy("path").agg({"event_id": "max", "t": "sum"}).collect()
    assert len(rows) == 59 and all(r["max(event_id)"] == 39 and r["sum(t)"] == 780 for r in rows)


def _as_sql(spark, tmp_path, name):
    """Whether a query and its SQL agree in text, signs of zeros too, over vectors with numbers that round to zero."""
    import duckdb

    from tidefold.plans import registry, source_queries, vector_queries  # noqa: F401

    rows = [(k, 0, v.tolist()) for k, v in enumerate(np.random.default_rng(5).normal(0, 2e-6, (60, 64)))]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(registry.ORACLE_SQL[name]).fetchall())
    got = sorted((r[0], list(r[1])) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
    assert "-0.0" in repr(want) and repr(got) == repr([(k, list(v)) for k, v in want])


def test_transforms_keep_the_sign_of_zero(spark, tmp_path):
    _as_sql(spark, tmp_path, "cosine_transform")


def test_crops_keep_the_sign_of_zero(spark, tmp_path):
    _as_sql(spark, tmp_path, "silence_crop")


def test_pairs_meet_in_few_large_blocks(spark, monkeypatch):
    """Losses of all pairs whatever the blocks, unlabelled and null vectors apart; copies of a vector do not grow with the number of vectors."""
    from tidefold.functions import vectors

    rng = np.random.default_rng(4)
    m, label = rng.normal(size=(50, 6)), rng.integers(0, 3, 50)
    rows = [(k, v.tolist(), int(z)) for k, (v, z) in enumerate(zip(m, label, strict=True))] + [(50, m[0].tolist(), None), (51, None, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    x = m.astype(np.float32).astype(float)
    same, dot = (label[:, None] == label[None]).astype(float), x @ x.T
    cosine = dot / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None]
    for tile, most in ((512, 32 << 20), (7, 32 << 20), (3, 500)):
        monkeypatch.setattr(vectors, "BLOCK", tile)
        monkeypatch.setattr(vectors, "BLOCK_BYTES", most)
        got = {r["kernel"]: r for r in vectors.similarity_losses(df, {"linear": 1.0, "sigmoid": 2.0}).collect()}
        for kernel, s in (("linear", cosine), ("sigmoid", 1 / (1 + np.exp(-2 * dot)))):
            p = np.clip(s, 1e-6, 1 - 1e-6)
            want = (((s - same) ** 2).mean(), np.abs(s - same).mean(), -(same * np.log(p) + (1 - same) * np.log(1 - p)).mean())
            assert tuple(got[kernel])[1:] == pytest.approx(want)
    monkeypatch.setattr(vectors, "BLOCK", 512)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 32 << 20)
    many = spark.range(600_000).select(F.array(*[F.lit(0.0)] * 50).alias("embedding"))
    assert vectors.block_count(many, "embedding") == vectors.block_count(many.limit(60_000), "embedding") == 16


def test_ids_leave_in_bounded_batches(spark, monkeypatch):
    """However many texts come in a batch, the ids of a few are held; nulls, empty texts and other columns stay."""
    from tidefold.operators import corpus

    texts = [None, "", "aé", "\U0001f600b" * 5] * 20
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id bigint, text string, extra int").coalesce(1)
    symbols = {"a": 0, "b": 1, "\U0001f600": 2}
    vocabulary = spark.createDataFrame(list(symbols.items()), "symbol string, id int")
    assert corpus.IDS_BATCH * 4 <= 16 << 20
    for most in (1 << 20, 7):
        monkeypatch.setattr(corpus, "IDS_BATCH", most)
        rows = corpus.char_encode(df, vocabulary, -1).collect()
        assert [(r["doc_id"], r["extra"]) for r in rows] == [(k, k) for k in range(80)]
        assert [r["ids"] for r in rows] == [None if t is None else [symbols.get(c, -1) for c in t] for t in texts]


def test_tokens_by_words_and_bytes_are_the_librarys(spark, monkeypatch):
    """Cached words and joined bytes give what the library gives, of odd texts, broken characters and ids that no token has."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidefold.operators import corpus

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = ["", " ", "a  b\n\n c", "<|endoftext|> it's", "Grüße \U0001f600 日本", "x" * 300, None, "The end. 12,5"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    monkeypatch.setattr(corpus, "IDS_BATCH", 5)
    got = {r["doc_id"]: r["ids"] for r in corpus.tokenize(df, path, 7).collect()}
    assert got == {k: [*lib.encode(t or "", add_special_tokens=False).ids, 7] for k, t in enumerate(texts)}
    ids = np.random.default_rng(2).integers(0, 52_000, (200, 9))
    text = corpus._decoder(path)
    assert [text(x) for x in ids] == [lib.decode(x.tolist(), skip_special_tokens=False) for x in ids]


def test_large_groups_stay_where_they_are(spark, monkeypatch):
    """A few groups of many rows are cut without a join that brings a group to one task; many groups are joined, with the same result."""
    from tidefold.operators import sampling

    df = spark.range(5000).select("id", (F.col("id") % 3).alias("g"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = []
        for few in (100_000, 2):
            monkeypatch.setattr(sampling, "FEW_GROUPS", few)
            outs = [sampling.subset(df, 0.3, 7, "g", "id", hot_rows=10), sampling.stratified(df, 0.3, "g", "id", hot_rows=10)]
            plans = [o._jdf.queryExecution().executedPlan().toString() for o in outs]
            assert all(("SortMergeJoin" in p) == (few == 2) for p in plans)
            found.append([sorted(map(tuple, o.collect())) for o in outs])
        plain = [sampling.subset(df, 0.3, 7, "g", "id"), sampling.stratified(df, 0.3, "g", "id")]
        assert found[0] == found[1] == [sorted(map(tuple, o.collect())) for o in plain]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_moment_sums(spark):
    from tidefold.functions import vectors

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(30, 5)), rng.normal(size=(40, 5))
    df = lambda m: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id bigint, embedding array<double>")
    for args in (None, {"polynomial": 3.0}):
        got = {r["vec_id"]: r for r in vectors.kernel_sums(df(x), df(y), args=args).collect()}
        s = x @ y.T
        for k in range(30):
            assert (got[k]["linear"], got[k]["polynomial"]) == pytest.approx((s[k].sum(), (s[k] ** (3 if args else 2)).sum()))
            assert got[k]["gaussian"] == pytest.approx(np.exp(-((x[k] - y) ** 2).sum(1) / 2).sum())
    assert vectors.moment_sums(df(x), df(y).where("false")).agg({"linear": "sum"}).first()[0] == 0


def test_files_of_a_dataset_share_batches_and_are_opened_once(spark, tmp_path, monkeypatch):
    """Many small files go by few batches, both ways; framing, which reads the events several times, decodes each file once."""
    rows = [(f"c{k % 3}/s{k}.bin", 1000 * k + i, (i * 7) % 50, i % 5, k % 8, i % 2) for k in range(40) for i in range(k % 7 + 1)]
    df = spark.createDataFrame(rows, "name string, event_id bigint, t bigint, x int, y int, p int")
    want = {}
    for name, i, *e in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        want.setdefault(name, []).append(tuple(e))
    encoded = binary.encode_events(df, "name", "atis40")
    files = {r["name"]: bytes(r["content"]) for r in encoded.collect()}
    assert files == {n: binary.to_atis40({k: np.array(c) for k, c in zip("txyp", zip(*e, strict=True), strict=True)}) for n, e in want.items()}
    monkeypatch.setattr(binary, "FILE_BYTES", 1)
    assert {r["name"]: bytes(r["content"]) for r in binary.encode_events(df, "name", "atis40").collect()} == files
    binary.write_files(encoded, str(tmp_path / "raw"))
    got = {}
    for r in sorted(binary.read_events(spark, str(tmp_path / "raw"), "atis40").collect(), key=lambda r: (r["path"], r["event_id"])):
        got.setdefault("/".join(r["path"].split("/")[-2:]), []).append((r["t"], r["x"], r["y"], r["p"]))
    assert got == want
    opened = spark.sparkContext.accumulator(0)
    decode = binary.atis40

    def counted(data):
        opened.add(1)
        return decode(data)

    monkeypatch.setitem(binary.DECODERS, "atis40", counted)
    out = spark.read.parquet(datasets.build(spark, "n_mnist", str(tmp_path / "raw"), str(tmp_path), "count", 4))
    assert out.agg({"n": "sum"}).first()[0] == len(rows) and opened.value == 40
