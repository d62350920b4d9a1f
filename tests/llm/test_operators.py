"""Each operator against a brute-force version or an exact round trip, and on awkward inputs: nulls, empty and very long texts,
repeated rows, empty tables, extra columns whose names clash with the operator's own."""

import math
import os
import random
import zlib

import numpy as np
import pytest

from tidefold.llm import embeddup, graph, langid, mixing, neardup, packing, quality_gam, quality_rules, rangecoder, tokencount, tokenfile, urlfilter
from tidefold.llm.bpe import Encoder, vocabulary

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, `key` string, label int, `rank` int, x double, score double, kept boolean, epoch int"
AWKWARD = ["", None, "   \n\t ", "a", "One two three four five six.", "x" * 5000, "word " * 3000, "a\n b  c\n\nd", "it's <|endoftext|> ok", "日本語 テキスト。", "\x85　\x1c", "#*$% | <>"]


def _docs(spark, rows):
    full = [(i, t, lang, src, None if t is None else len(t), 1, "k", 0, 3, 0.5, 0.1, None, 2) for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def enc():
    return Encoder(vocabulary())


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(k, t, "en", "s" if k % 2 else None) for k, t in enumerate(AWKWARD)]
    return _docs(spark, [*rows, (3, "a", None, "s"), (3, "other text", "de", "s"), (None, "no id here", "en", None)])


@pytest.fixture(scope="module")
def empty(spark):
    return _docs(spark, [])


def _texts(n=300, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "on", "an", "in", "é", "ü"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(n)]


# tokens


def test_words_encode_like_the_whole_text(enc):
    for t in [t or "" for t in AWKWARD] + _texts(50):
        assert enc.encode(t) == enc.whole(t), repr(t[:50])


def test_prefix_counts(enc):
    c = tokencount.PrefixCounter(vocabulary())
    for t in ["", " a", "it's 'd we're  x", "a.\n\nB , c", "١٢ ½", "日本 語。 ", "don't.", " .", *[t[:200] for t in _texts(10)]]:
        p = c.prefixes(t)
        assert p == [len(enc.whole(t[:i])) // 4 for i in range(len(t) + 1)]
        for budget in (0, 1, 5, 50):
            assert c.longest_within(t, budget) == max(i for i, n in enumerate(p) if n <= budget)


def test_token_counts(spark, enc, awkward, empty):
    out = tokencount.token_counts(awkward, vocabulary(), 100).collect()
    assert len(out) == awkward.count()
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] != 3:
            t = AWKWARD[r["doc_id"]] or ""
            assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(enc.whole(t)) // 4) and r["over_limit"] == (r["n_tokens"] > 100)
    assert tokencount.token_counts(empty, vocabulary()).count() == 0


def test_sentencepiece_counts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = _texts(5)
    out = tokencount.token_counts(_docs(spark, [(k, t, None, None) for k, t in enumerate(texts)]), path).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in out} == {k: len(sp.encode(t)) for k, t in enumerate(texts)}


# range coder and files


@pytest.mark.parametrize("seed", range(3))
def test_coder_round_trip(seed):
    rng = np.random.default_rng(seed)
    for ids in (np.zeros(0), np.array([2**32 - 1]), rng.integers(0, 3, 5000), rng.zipf(1.3, 20000) % 50000, np.full(9000, 7), rng.integers(0, 2**32, 4097), rng.permutation(100_000)):
        ids = ids.astype(np.uint32)
        assert (rangecoder.decode(rangecoder.encode(ids)) == ids).all()


def test_coder_learns_and_blocks_are_checked():
    ids = np.tile(np.arange(100, dtype=np.uint32), 500)
    data = rangecoder.encode(ids)
    assert len(data) < len(ids) / 4
    for at in (30, len(data) - 5):
        bad = bytearray(data)
        bad[at] ^= 255
        with pytest.raises(ValueError):
            rangecoder.decode(bytes(bad))


def test_coder_knows_what_follows():
    """Each of 2,000 ids is followed by one of 8: about 3 bits an id, where the coder learned only one follower before."""
    rng = np.random.default_rng(5)
    after, now, walks = rng.integers(0, 2000, (2000, 8)), rng.integers(0, 2000, 100), []
    for _ in range(4000):
        walks.append(now)
        now = after[now, rng.integers(0, 8, 100)]
    ids = np.array(walks, np.uint32).T.ravel()
    data = rangecoder.encode(ids)
    assert len(data) * 8 < 5 * len(ids) and (rangecoder.decode(data) == ids).all()


def test_token_files(spark, enc, awkward, empty, tmp_path):
    out = tokenfile.token_files(awkward, vocabulary(), 2).collect()
    assert len(out) == awkward.count()
    start = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    for r in out:
        if r["doc_id"] not in (None, 3):
            data = enc.whole(AWKWARD[r["doc_id"]] or "") + b"\2\0\0\0"
            assert (r["n_tokens"], r["ids_crc32"]) == (len(data) // 4, zlib.crc32(data))
    assert tokenfile.token_files(empty, vocabulary()).count() == 0
    tokenfile.export(tokenfile.write_files(awkward, vocabulary(), 2), str(tmp_path / "files"))
    names = sorted(p for p in os.listdir(tmp_path / "files"))
    total = sum(len(tokenfile.unpack_file((tmp_path / "files" / n).read_bytes())[0]) for n in names)
    assert names and all(n.endswith(".tok") for n in names) and total == awkward.count()


# packing


def _check_packed(rows, most):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= most
    return len(by)


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    room = 256
    lengths = np.clip(rng.lognormal(3.5 + seed / 2, 1, 3000).astype(int), 1, room)
    counts = np.bincount(lengths, minlength=room + 1)
    starts, delta, offsets, bins = packing.plan(counts, room, 40)
    number = np.arange(counts.sum())
    k = np.searchsorted(starts, number, side="right") - 1
    size = np.repeat(np.arange(room + 1), counts)
    rows = [{"sequence_id": s, "offset": o, "length": n} for s, o, n in zip((number + delta[k]).tolist(), offsets[k].tolist(), size.tolist())]
    assert _check_packed(rows, room) == bins <= 1.02 * math.ceil(lengths.sum() / room) + 3


def test_pack(spark, enc, awkward, empty):
    out = packing.pack(awkward, vocabulary(), 512, 0).collect()
    _check_packed(out, 512)
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in awkward.collect()}
    for k, t in enumerate(AWKWARD):
        if k != 3:
            data = enc.whole(t or "") + b"\0\0\0\0"
            parts = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out if r["doc_id"] == k)
            assert [(p[1], p[2]) for p in parts] == packing.cut(len(data) // 4, 512)
            assert all(p[3] == zlib.crc32(data[4 * p[1] : 4 * (p[1] + p[2])]) for p in parts)
    assert packing.pack(empty, vocabulary()).count() == 0
    assert packing.cut(2048, 2048) == [(0, 2048)] and packing.cut(4097, 2048) == [(0, 1), (1, 2048), (2049, 2048)]


# urls


def test_urls(spark):
    urls = ["http://A.example.ORG/en/10?x=/es/", "https://example.org/es", "https://sub.example.org/es/1#f", "http://notexample.org/es/1", "http://x.com/de/1", "http://com/fr/", "http://x.net", "no scheme", None, "://", "http://x.com/fr", "mailto://a.com/de/", "http://b.com?u=http://a.com/de/"]
    df = spark.createDataFrame([(k, u, "h", "r", "v") for k, u in enumerate(urls)], "page_id bigint, url string, host string, rule string, verdict string")
    from tidefold.llm.queries import URL_RULES

    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(df, URL_RULES).collect()}
    assert got[0] == ("a.example.org", "/en/10", "example.org/en/1", "block")
    assert got[1] == ("example.org", "/es", "org/", "allow") and got[2][2:] == ("example.org/es/", "block")
    assert got[3][2:] == ("org/", "allow") and got[4][2:] == ("com/de/", "block") and got[5][2:] == ("com/fr/", "allow")
    assert got[6] == ("x.net", "", None, "allow") and got[7] == got[8] == ("", "", None, "allow") and got[9][:2] == ("", "")
    assert got[10][2] is None and got[11][2:] == ("com/de/", "block") and got[12] == ("b.com", "", None, "allow")
    assert urlfilter.judge_urls(df.where("false"), URL_RULES).count() == 0


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda k: len(k) % 3)
    path = str(tmp_path / "d")
    urlfilter.write_digests([("block", f"h{k}.com", "/p") for k in range(50)], path)
    file = urlfilter.DigestFile(path)
    assert file.find([f"h{k}.com/p" for k in range(60)]) == ["block"] * 50 + [None] * 10


# near duplicates


def _brute_components(ids, link):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and link(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for size in (5, 40, 2000):
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        b = np.concatenate([a[: size * 4 // 5], rng.integers(0, 2**63, size // 5).astype(np.uint64)])
        s = neardup.sketch([np.unique(a), np.unique(b)])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - j) < 0.15 and (s != 2**64 - 1).all()


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    base = _texts(30, 9)
    texts = list(base)
    for t in base[:12]:  # chains and stars of edited copies, near the threshold
        w = t.split()
        for _ in range(12):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(v) // 40))):
                v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v).upper() if rng.random() < 0.3 else " ".join(v))
    texts += [None, "", " ", "a b", "A  b", "a b c", "c", "c"]
    rng.shuffle(texts)
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    sets = {k: neardup.shingle_set(t) for k, t, _, _ in rows}
    want = _brute_components(list(sets), lambda a, b: len(sets[a]) > 0 and len(sets[b]) > 0 and neardup.similar(sets[a], sets[b]))
    for small in (neardup.SMALL, 2):  # also with every bucket handled by blocks
        was, neardup.SMALL, block, neardup.BLOCK = neardup.SMALL, small, neardup.BLOCK, 3 if small == 2 else neardup.BLOCK
        out = neardup.near_duplicates(_docs(spark, rows)).collect()
        neardup.SMALL, neardup.BLOCK = was, block
        assert {r["doc_id"]: r["component_id"] for r in out} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) and r["n_shingles"] == len(sets[r["doc_id"]]) for r in out)


def test_near_duplicates_awkward(spark, awkward, empty):
    out = neardup.near_duplicates(awkward).collect()
    assert len(out) == awkward.count()
    by = {r["doc_id"]: r for r in out}
    assert by[None]["kept"] and by[None]["component_id"] is None and by[0]["n_shingles"] == 0
    assert len({r["component_id"] for r in out if r["doc_id"] == 3}) == 1
    assert neardup.near_duplicates(empty).count() == 0


def test_keep_one_keeps_every_text(spark, awkward, empty):
    """Null and repeated ids, clashing columns: a row goes only if a similar one stays."""
    body = _texts(8, seed=9)
    rows = [(None, body[0]), (1, body[1]), (1, body[2]), (2, body[3]), (None, body[4]), (3, body[3]), (3, body[3] + " x"), (None, body[3]), (4, ""), (4, ""), (None, None)]
    df = spark.createDataFrame([(i, t, 1, 2, 3, "e") for i, t in rows], "doc_id bigint, text string, __id int, id int, row int, d0 string")
    got = sorted(map(tuple, neardup.keep_one(df).select("doc_id", "text").collect()), key=str)
    assert got == sorted([(None, body[0]), (1, body[1]), (1, body[2]), (2, body[3]), (None, body[4]), (4, ""), (4, ""), (None, None)], key=str)
    assert neardup.keep_one(df).columns == df.columns and neardup.keep_one(empty).count() == 0
    # by brute force over rows
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    sets = [neardup.shingle_set(t) for _, t in docs]
    alike = lambda a, b: len(a) and len(b) and neardup.similar(a, b)
    kept = [tuple(r) for r in neardup.keep_one(awkward).select("doc_id", "text").collect()]
    for (i, t), s in zip(docs, sets, strict=True):
        assert (i, t) in kept or any(alike(s, neardup.shingle_set(u)) for _, u in kept)
    held = [s for s in map(neardup.shingle_set, (u for _, u in kept)) if len(s)]
    assert not any(alike(held[a], held[b]) for a in range(len(held)) for b in range(a))


def test_block_products_equal_pairs():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    was, neardup.COLUMNS = neardup.COLUMNS, 16
    got = neardup._matches(sets[:15], sets[15:])
    neardup.COLUMNS = was
    assert (got == [[neardup.similar(a, b) for b in sets[15:]] for a in sets[:15]]).all()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10_000), 300)
    edges = [(ids[k], ids[k + 1]) for k in range(150)] + [(ids[200], ids[k]) for k in range(201, 260)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in ids[:151]} == {min(ids[:151])} and {got[i] for i in ids[200:260]} == {min(ids[200:260])} and len(got) == 211
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 64))
    rows = []
    for k in range(240):
        v = base[k % 12] + rng.normal(size=64) * (0.08 if k % 3 else 0.16)
        rows.append((k, v.tolist(), int(k % 12 % 2)))
    rows += [(500, rows[0][1], rows[0][2]), (501, rows[0][1], 1 - rows[0][2]), (502, [0.0] * 64, 0), (503, None, 0), (504, [float("nan")] * 64, 0), (505, rows[1][1], None), (506, [1.0, 2.0], 0), (507, [1.0, 2.0], 0), (508, [], 0), (509, [None] * 3, 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, label int, links int, d1 int")
    ok = {k: np.array(v) for k, v, lab in rows if v and None not in v and np.isfinite(v).all() and any(v) and lab is not None}
    label = {k: lab for k, _, lab in rows}

    def link(a, b):
        return a in ok and b in ok and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.98

    want = _brute_components([r[0] for r in rows], link)
    links = {a: sum(link(a, b) for b in label if b != a) for a in label}
    for side in (embeddup.SIDE, 4):
        was, embeddup.SIDE = embeddup.SIDE, side
        out = embeddup.near_vectors(df).collect()
        embeddup.SIDE = was
        assert {r["vec_id"]: r["n_links"] for r in out} == links and {r["vec_id"]: r["component_id"] for r in out} == want
    assert embeddup.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("width", [16, 64, 256])
def test_caps_find_close_pairs(width):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(3000, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    f = embeddup.Filters(width)
    lists = []
    for m in (a, b):
        row, name = f.decode(m)
        lists.append([set(name[row == k].tolist()) for k in range(len(m))])
    found = np.mean([not x.isdisjoint(y) for x, y in zip(*lists)])
    assert found > 0.995  # pairs exactly at the threshold


# language


def test_gradients_by_differences():
    net = langid.Net.new(["a", "b", "c"], 3)
    for k in ("wx", "wh", "wo", "bo"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 5, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 0])
    _, grads = net.gradients(x, y)
    for w, g in zip((net.wx, net.wh, net.wo, net.bo), grads, strict=True):
        for _ in range(5):
            i = tuple(int(rng.integers(0, d)) for d in w.shape)
            i = (i[0], i[1] % 5, i[2]) if w is net.wx else i
            was = w[i]
            w[i] = was + 1e-2
            up = net.gradients(x, y)[0]
            w[i] = was - 1e-2
            down = net.gradients(x, y)[0]
            w[i] = was
            assert abs((up - down) / 2e-2 - g[i]) < 2e-3


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_awkward(spark, awkward, empty):
    out = {r["doc_id"]: r for r in langid.identify(awkward).collect()}
    assert all(out[k]["lang_pred"] == "und" and out[k]["score"] == 0 for k in (0, 1, 2, 10, 11))
    assert out[4]["lang_pred"] in ("en", "de") and out[9]["lang_pred"] != "und"
    assert langid.identify(empty).count() == 0


# quality


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_quality_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = quality_gam.score_quality(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 40 and np.mean([r["predicted"] == r["quality"] for r in out]) > 0.93


def test_quality_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)] + [(4, None, 0), (None, 1, 0), (5, 7, 0)], "doc_id bigint, quality int, toxic int")
    out = quality_gam.score_quality(awkward, labels).collect()
    assert len(out) == awkward.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert quality_gam.score_quality(empty, labels).count() == 0
    assert quality_gam.score_quality(awkward, labels.where("false")).count() == awkward.count()


def test_interactions_are_learned():
    rng = np.random.default_rng(3)
    x = np.zeros((4000, len(quality_gam.FEATURES)))
    x[:, :3] = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality_gam.train(x, y)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.9


# quality rules


def _repeats(text):
    w = (text or "").split()
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(hit)


def test_rules_on_awkward_texts(spark, awkward, empty):
    out = {r["doc_id"]: r for r in quality_rules.judge(awkward).collect()}
    for k in (0, 1, 4, 6, 7, 11):
        t = AWKWARD[k] or ""
        assert out[k]["n_words"] == len(t.split()) and out[k]["n_repeat_words"] == _repeats(t) and out[k]["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
    assert out[6]["base_failed"] and not out[6]["kept"] and quality_rules.judge(awkward).count() == awkward.count()
    assert quality_rules.judge(empty).count() == 0


def test_repeated_words_by_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["a b c d e f g h " * 3]
    out = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.judge(_docs(spark, [(k, t, None, "s") for k, t in enumerate(texts)])).collect()}
    assert out == {k: _repeats(t) for k, t in enumerate(texts)}


def test_boilerplate_lines(spark):
    body = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(60)]
    notice = "All  Rights reserved in this place for all of us and so on and on with more words to make it count"
    rows = [(k, f"{t}\n{notice.upper() if k % 2 else notice}", None, "h1") for k, t in enumerate(body)]
    rows += [(100, "\n".join([notice, "one two three"]), None, "h1"), (101, notice, None, "h2")]
    rows += [(200 + k, "copy " * 3 + " ".join(f"c{j}" for j in range(20)), None, "h1") for k in range(50)]
    docs = _docs(spark, rows)
    out = {r["doc_id"]: r for r in quality_rules.judge(docs, witness="texts").collect()}
    n = len(notice.split())
    assert all(out[k]["n_common_words"] == n and out[k]["kept"] for k in range(60))
    assert out[100]["n_common_words"] == n and not out[100]["kept"] and not out[100]["base_failed"]
    assert out[101]["n_common_words"] == 0 and out[101]["kept"]
    assert all(out[200 + k]["kept"] for k in range(50))  # copies of one text are one witness
    counted = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert all(counted[k]["kept"] == (k < 100 or k == 101) and not counted[k]["base_failed"] for k in counted)  # each copy is a document
    with pytest.raises(ValueError):
        quality_rules.judge(docs, witness="hosts")
    clean = {r["doc_id"]: r["text"] for r in quality_rules.without_common_lines(docs).collect()}
    assert clean[0] == body[0] and clean[100] == "one two three" and clean[101] == notice


def test_line_rule_equals_sql(spark, tmp_path):
    """Hosts with boilerplate, copies, depleted documents and rests that fail: every branch of the rule is reached, and equals the SQL."""
    import duckdb

    rng = np.random.default_rng(12)
    notices = [" ".join(f"n{k}w{j}" for j in range(3 + 8 * k)) for k in range(5)]
    rows = []
    for k in range(400):
        lines = [" ".join(f"d{k}l{i}w{j}" for j in range(int(rng.integers(0, 14)))) for i in range(int(rng.integers(0, 6)))]
        lines += [notices[i].upper() if k % 3 else notices[i].replace(" ", " \t", 1) for i in rng.permutation(5)[: int(rng.integers(0, 4))]]
        rng.shuffle(lines)
        rows.append((k, None if k == 77 else "\n".join(lines), "en", [None, "a", "b"][int(rng.integers(0, 3))]))
    rows += [(1000 + k, "a text that has been copied\n" + " ".join(f"c{j}" for j in range(30)), "en", "a") for k in range(25)]  # over the limit only as documents
    docs = _docs(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(quality_rules.JUDGE_SQL).fetchall())
    got = quality_rules.judge(docs)
    assert sorted(map(tuple, got.collect())) == want
    rows = {r["doc_id"]: r for r in got.collect()}
    assert sum(not r["base_failed"] and not r["kept"] for k, r in rows.items() if k < 1000) > 10 and sum(r["kept"] and r["n_common_words"] > 0 for r in rows.values()) > 10
    assert not any(rows[1000 + k]["kept"] for k in range(25)) and all(r["kept"] for r in quality_rules.judge(docs, witness="texts").where("doc_id >= 1000").collect())


def test_long_lines_are_counted(spark):
    passage = " ".join(f"long{j}" for j in range(60))
    rows = [(k, f"{passage}\n" + " ".join(f"w{k}x{j}" for j in range(40)), None, "h1") for k in range(quality_rules.LINE_DOCS + 1)]
    rows += [(100, passage, None, "h1"), (101, passage, None, "h2")]
    docs = _docs(spark, rows)
    out = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert all(out[k]["n_common_words"] == 60 and out[k]["kept"] for k in range(quality_rules.LINE_DOCS + 1))
    assert out[100]["n_common_words"] == 60 and not out[100]["kept"] and out[101]["n_common_words"] == 0 and out[101]["kept"]
    below = {r["doc_id"]: r for r in quality_rules.judge(docs.where("doc_id < 20")).collect()}
    assert all(r["n_common_words"] == 0 for r in below.values())


def test_kept_texts_lose_boilerplate_and_short_rests_are_depleted(spark):
    notice = " ".join(f"n{j}" for j in range(42))
    rows = [(k, f"{notice}\n" + " ".join(f"w{k}x{j}" for j in range(40)), None, "h1") for k in range(30)]
    rows += [(100, f"{notice}\n" + " ".join(f"v{j}" for j in range(18)), None, "h1"), (101, f"{notice}\n" + "a b c d e f g h " * 2 + " ".join(f"u{j}" for j in range(16)), None, "h1")]
    docs = _docs(spark, rows)
    out = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert all(out[k]["kept"] for k in range(30))
    for k in (100, 101):  # 18 words are left, 30 % of 60; 32 words are left, half of them in repeated windows
        assert out[k]["n_common_words"] == 42 and not out[k]["base_failed"] and not out[k]["kept"]
    kept = {r["doc_id"]: r["text"] for r in quality_rules.keep(docs).collect()}
    assert kept == {k: t.split("\n")[1] for k, t, _, _ in rows[:30]}


def test_keep_known_rejects_only_unknown_languages(spark, monkeypatch):
    rows = [(1, "one text in two languages", "en", "s"), (2, "1234 5678", "en", "s"), (3, "ein Text", "de", "s")]
    unlabelled = _docs(spark, [(k, t, None, s) for k, t, _, s in rows])
    assert sorted(r["doc_id"] for r in langid.keep_known(unlabelled).collect()) == [1, 2, 3]
    monkeypatch.setattr(langid, "learn", lambda *a: "net")
    monkeypatch.setattr(langid, "predict", lambda net, texts: (["en"] * len(texts), np.full(len(texts), 0.4)))
    assert sorted(r["doc_id"] for r in langid.keep_known(_docs(spark, rows)).collect()) == [1, 3]


# mixing


def test_exponent(spark):
    tokens = [1_000_000, 10_000, 100]
    m = mixing.solve(tokens, repeats=4.0)
    reps = [m.budget * w / n for w, n in zip(m.weights, tokens)]
    assert math.isclose(max(reps), 4.0, rel_tol=1e-6) and math.isclose(min(reps), 1.0, rel_tol=1e-9)
    h = mixing.solve(tokens, target_entropy=0.5)
    assert math.isclose(mixing.entropy(h.weights), 0.5, rel_tol=1e-6)
    assert mixing.solve([5, 5], repeats=2.0).exponent == 0 and mixing.solve([7]).weights == [1.0]


def test_mixture(spark, enc, awkward, empty):
    rng = random.Random(3)
    texts = _texts(400)
    rows = [(k, t, None, "big" if rng.random() < 0.8 else rng.choice(["b", "c", None])) for k, t in enumerate(texts)]
    docs = _docs(spark, rows)
    out = mixing.mixture(docs, vocabulary()).collect()
    size = {k: len(enc.whole(t)) // 4 for k, t, _, _ in rows}
    per = {}
    for k, _, _, s in rows:
        per[s] = per.get(s, 0) + size[k]
    m = mixing.solve([per[s] for s in sorted(per, key=str)])
    uses = {}
    for r in out:
        uses.setdefault(r["doc_id"], []).append(r["epoch"])
    assert set(uses) == set(size) and all(sorted(v) == list(range(len(v))) for v in uses.values())
    for s, w in zip(sorted(per, key=str), m.weights):
        got = sum(size[k] * len(uses[k]) for k, _, _, x in rows if x == s)
        assert w * m.budget - 1 <= got <= w * m.budget + max(size.values())
    again = mixing.mixed(docs, vocabulary())
    assert again.columns == docs.columns and again.count() == len(out)
    assert mixing.mixture(awkward, vocabulary()).where("epoch = 0").count() == awkward.count() and mixing.mixture(empty, vocabulary()).count() == 0


def test_mixture_blocks_hold_every_share(spark):
    docs = _docs(spark, [(k, t, None, f"s{k % 3}") for k, t in enumerate(_texts(600))])
    was, mixing.BLOCK_TOKENS = mixing.BLOCK_TOKENS, 8000
    out = mixing.mixture(docs, vocabulary()).groupBy("block", "source").count().collect()
    mixing.BLOCK_TOKENS = was
    blocks = {r["block"] for r in out}
    assert len(blocks) > 4 and len(out) == 3 * len(blocks)


def test_boilerplate_lines_join_alike_by_broadcast_and_by_shuffle(spark, monkeypatch):
    notice = " ".join(f"n{j}" for j in range(42))
    rows = [(k % 25, f"{notice}\n" + " ".join(f"w{k}x{j}" for j in range(40)), "en", None) for k in range(30)] + [(None, f"{notice}\nmore", "en", None), (3, None, "en", None), (100, notice, "en", "h2")]
    docs = _docs(spark, rows).selectExpr("*", "1 as r_id", "2 as h", "3 as lines", "4 as r_common", "5 as d1", "6 as c")
    few = [sorted(map(str, f(docs).collect())) for f in (quality_rules.judge, quality_rules.keep, quality_rules.without_common_lines)]
    monkeypatch.setattr(quality_rules, "MOST_LINES", 0)
    assert few == [sorted(map(str, f(docs).collect())) for f in (quality_rules.judge, quality_rules.keep, quality_rules.without_common_lines)]
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and kept.count() == 31  # the other host has the notice once: not boilerplate there
    assert [r["doc_id"] for r in kept.where(f"text like '%{notice}%'").collect()] == [100]


def test_vectors_that_repeat_an_id(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 64))
    near = lambda v: (v + rng.normal(size=64) * 0.01).tolist()
    rows = [(1, a.tolist()), (1, b.tolist()), (2, near(a)), (3, near(b)), (4, near(b)), (5, (0.1 * b).tolist()), (5, (0.1 * b).tolist()), (None, a.tolist())]
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id bigint, embedding array<double>, label int")
    out = embeddup.near_vectors(df).collect()
    assert sorted(r["n_links"] for r in out if r["vec_id"] == 1) == [1, 4]
    assert {(r["vec_id"], r["component_id"], r["kept"]) for r in out} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 1, False), (None, None, True)}
    assert {r["n_links"] for r in out if r["vec_id"] in (2, 5)} == {1, 4} and all(r["n_links"] == 0 for r in out if r["vec_id"] is None)


def test_large_sets_are_compared_in_portions(monkeypatch):
    rng = np.random.default_rng(8)
    pool = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    sets = [np.unique(rng.choice(pool, rng.integers(1, 2900))) for _ in range(12)] + [pool, pool[:-100]]
    want = [[neardup.similar(a, b) for b in sets[7:]] for a in sets[:7]]
    monkeypatch.setattr(neardup, "PORTION", 700)
    assert (neardup._matches(sets[:7], sets[7:]) == want).all()
    assert neardup._portions([0, 1, 2, 3], [500, 300, 5000, 1]) == [[0], [1], [2], [3]] and neardup._portions([], []) == [[]]


def test_prefix_counts_of_mixed_pieces(enc):
    c = tokencount.PrefixCounter(vocabulary())
    rng = random.Random(4)
    parts = ["a", "b", "'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", ".", ",", "!!", "1", "23", "é", "ß", "日", "本", "。", "—", "“", "😀", "\x85", "　", "א", "ع", "The", " the", "<|", "endoftext", "<|endoftext|>", "don't"]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = [len(enc.whole(t[:i])) // 4 for i in range(len(t) + 1)]
        assert c.count(t) == want[-1]
        assert "<|endoftext|>" in t or c.prefixes(t) == want
        for budget in (0, 1, 3, 7):
            assert c.longest_within(t, budget) == max(i for i, n in enumerate(want) if n <= budget), repr(t)


@pytest.mark.parametrize("text", ["x" * 200_000, "日本語テキスト" * 10_000, "word " * 3000 + "<|endoftext|>" + "more words " * 3000, "a\n" * 20_000, " " * 50_000])
def test_long_texts_are_counted_in_one_pass(enc, text):
    c = tokencount.PrefixCounter(vocabulary())
    assert c.count(text) == len(enc.whole(text)) // 4
    fit = c.longest_within(text, 1000)
    assert c.count(text[:fit]) <= 1000 < c.count(text)


def test_texts_that_do_not_fit_a_sentencepiece_model(spark):
    import public_tokenizers

    out = {r["doc_id"]: r for r in tokencount.token_counts(_docs(spark, [(1, "one two", None, None), (2, "one two three " * 50, None, None)]), public_tokenizers.path("piece_bpe_32k.model"), 20).collect()}
    assert out[1]["fit_chars"] == 7 and out[2]["over_limit"] and out[2]["fit_chars"] is None


def test_blocks_hold_their_token_budget_of_each_source(spark, enc):
    rng = random.Random(6)
    texts = _texts(700)
    docs = _docs(spark, [(k, t, None, "big" if rng.random() < 0.7 else rng.choice(["b", None])) for k, t in enumerate(texts)])
    was, mixing.BLOCK_TOKENS = mixing.BLOCK_TOKENS, 6000
    out = mixing.mixture(docs, vocabulary()).collect()
    mixing.BLOCK_TOKENS = was
    blocks = 1 + max(r["block"] for r in out)
    assert blocks > 5
    for source in ("big", "b", None):
        own = [r for r in out if r["source"] == source]
        total, most = sum(r["n_tokens"] for r in own), max(r["n_tokens"] for r in own)
        for k in range(blocks):
            assert abs(sum(r["n_tokens"] for r in own if r["block"] == k) - total / blocks) <= most
        epochs = [r["epoch"] for r in sorted(own, key=lambda r: (r["block"], r["epoch"]))]
        assert epochs == sorted(epochs)  # one pass after the other


def test_windows_label_every_byte_once_with_its_neighbours():
    texts = [b"", b"abc", bytes(range(1, 201)), b"", b"x" * 128]
    x, owner = langid.windows(texts, 64, 8)
    assert x.shape == (80, len(owner)) and owner.tolist() == [1, 2, 2, 2, 2, 4, 4]
    for k, t in enumerate(texts):
        own = x[8:72, owner == k].T.ravel()
        assert own[own != 0].tobytes() == t
    assert x[:8, 2].tobytes() == bytes(range(57, 65))
    assert x[72:, 1].tobytes() == bytes(range(65, 73)) and not x[:8, [0, 1, 5]].any() and not x[72:, [0, 4, 6]].any()
    assert langid.windows([b""], 64, 8)[0].shape == (80, 0)


def test_windows_are_scored_at_their_own_bytes_alone():
    """The states are those of all steps, but no direction is stepped through the margin behind it."""
    net = langid.Net.new(["a", "b", "c"])
    x, _ = langid.windows([bytes(range(1, 201)) * 3, b"abc", bytes(255 - k for k in range(90))], 64, 8)
    want = np.stack([net.states(x, d)[8:72] for d in (0, 1)])
    assert (net.own_states(x, 8) == want).all()
    live = (x[8:72] != 0).astype(np.float32)
    assert np.allclose(net.summed(x, live, 8), np.einsum("tlk,tl->lk", net.probabilities(x)[8:72], live), atol=1e-4)
    changed = x.copy()
    changed[72:] = 1
    assert (net.own_states(changed, 8)[0] == want[0]).all() and (net.own_states(changed, 8)[1] != want[1]).any()


def test_rows_without_id_are_learned_from_and_rows_are_bounded(spark, monkeypatch):
    rows = [(None, "the cat and the dog " * 5 + str(k), "en", "s") for k in range(30)] + [(None, "der Hund und die Katze " * 5 + str(k), "de", "s") for k in range(20)] + [(None, "zzz qqq " * 9, "xx", "s")] * 40
    net = langid.learn(_docs(spark, rows))
    assert net.langs == ["de", "en", "xx"]  # a rare language is learned as well
    assert langid.predict(net, ["und der Hund die Katze", "and the dog the cat", "zzz qqq", None, ""])[0] == ["de", "en", "xx", "und", "und"]
    seen: list[list[str]] = []
    monkeypatch.setattr(langid, "train", lambda texts, labels: seen.append(labels))
    langid.learn(_docs(spark, rows))
    assert seen[-1].count("xx") == 1 and seen[-1].count("en") == 30  # rows alike count once
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 12)
    langid.learn(_docs(spark, rows))
    assert 0 < len(seen[-1]) < 40
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 2)
    langid.learn(_docs(spark, rows))
    assert len(seen[-1]) < 20


def test_more_languages_than_a_batch_holds():
    rng = random.Random(8)
    texts = {f"l{k:02d}": [bytes(rng.choice(bytes([97 + k // 2, 65 + k % 7 * 3 + k // 26, 32])) for _ in range(200)) for _ in range(3)] for k in range(48)}
    net = langid.train([t for v in texts.values() for t in v], [k for k, v in texts.items() for _ in v], rounds=120)
    assert len(net.langs) == 48
    right = sum(a == b for a, b in zip(langid.predict(net, [v[0].decode() for v in texts.values()])[0], texts, strict=True))
    assert right > 24


def test_scratch_of_a_stage_goes_with_it(spark):
    from tidefold.llm import runtime

    first = runtime.stored(spark, spark.range(3), "first")

    def make():
        inner = runtime.stored(spark, spark.range(5), "inner")
        return inner.where("id > 0")

    out = runtime.settled(spark, make, "outer")
    paths = [p for _, p in runtime._SCRATCH]
    assert out.count() == 4 and first.count() == 3 and out._stored_at in paths and not any("/inner-" in p for p in paths)


def test_sketches_rule_out_only_dissimilar_rows():
    rng = np.random.default_rng(12)
    base = [np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64)) for _ in range(3)]
    sets = [np.unique(np.concatenate([b[: 400 - cut], rng.integers(0, 2**64, cut, dtype=np.uint64)])) for b in base for cut in (0, 10, 40, 55)]
    mini = neardup.sketch(sets).astype(np.uint8)
    size, n = np.array([len(s) for s in sets]), len(sets)
    alone = np.arange(n)
    assert neardup._doubtful(size, alone, np.zeros(n, int), mini).tolist() == list(range(n))  # each has a similar one of another label
    assert neardup._doubtful(size, alone // 4, np.zeros(n, int), mini).tolist() == []  # other labels are other texts here
    side = (alone >= 8).astype(int)
    assert neardup._doubtful(size, alone, side, mini).tolist() == []
    assert neardup._doubtful(size, alone, (alone % 2).astype(int), mini).tolist() == list(range(n))
    assert neardup._doubtful(size * np.where(alone % 2, 2, 1), alone, (alone % 2).astype(int), mini).tolist() == []  # sizes too far apart
