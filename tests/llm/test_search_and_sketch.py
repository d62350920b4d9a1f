"""Hard negatives, fill-in-the-middle and document fingerprints against brute force, and on awkward inputs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.llm import fim, fingerprint, hardneg

EXTRA = "id bigint, `row` int, `n` int, form string, x double, score double, rank int, h1 int, need int, part int"
TEXTS = ["", None, "\n", "a", "a\n", "one\ntwo\r\nthree", "\n\n x \n", "é日本\n語\n" * 40, "<P> marked\nb", "same\nsame\nsame\n", "long\n" + "y" * 100_000, "line %d\n" * 3000]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "f", 0.5, 0.1, 4, 5, 6, 7) for i, t in rows], "doc_id bigint, text string, " + EXTRA)


# hard negatives


def _brute(rows, positives, negatives, low, high):
    """rows: (id, label, vector, anchor), distinct."""
    live = [(i, lab, [int(np.floor(256 * c)) for c in v], a) for i, lab, v, a in rows]
    out = []
    for i, lab, v, a in sorted(live, key=lambda r: (r[0], r[1])):
        if not a:
            continue
        score = [(sum(p * q for p, q in zip(v, w)), j, m) for j, m, w, _ in live if len(w) == len(v) and (j, m, w) != (i, lab, v)]
        near = sorted((-s, j) for s, j, m in score if m == lab)[:positives]
        for s, j in near:
            fit = sorted((-t, k) for t, k, m in score if m != lab and low * -s <= 100 * t <= high * -s)[:negatives]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("dim,kind", [(1, "normal"), (5, "normal"), (24, "ties"), (24, "decay"), (64, "normal")])
def test_hard_negatives(spark, monkeypatch, dim, kind):
    monkeypatch.setattr(hardneg, "LEAST_ROWS", 40)  # several blocks
    monkeypatch.setattr(hardneg, "BLOCK_NUMBERS", 40 * dim)
    monkeypatch.setattr(hardneg, "SUB_ROWS", 32)
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(250, dim)) * (1.0 / (1 + np.arange(dim)) if kind == "decay" else 1)
    v = np.round(v) if kind == "ties" else v
    rows = [(k * 3, int(k % 3 if k % 2 else 0), v[k].tolist(), k % 7 == 0) for k in range(250)]  # label 0 is hot
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id bigint, label int, embedding array<double>, anchor boolean, rank int")
    got = sorted(map(tuple, hardneg.hard_negatives(df, F.col("anchor")).collect()))
    assert got == _brute(rows, 5, 10, 30, 90) and (got or kind == "ties")


def test_bounds_discard_and_lose_nothing():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(3000, 32)) * 0.8 ** np.arange(32)).astype(np.int64)
    q = x[:40]
    turn = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    low, high = np.full((40, 1), -(1 << 62)), np.full((40, 1), 1 << 62)
    allowed = lambda a, r: np.ones((a.stop - a.start, r.stop - r.start), bool)
    counts: dict[str, int] = {}
    a, _, r, s = hardneg.top_rows(q, x, allowed, low, high, 7, turn, counts)
    assert counts["pairs"] == 40 * 3000 and counts["verified"] < counts["pairs"] / 4
    plain = hardneg.top_rows(q, x, allowed, low, high, 7)
    scores = q @ x.T
    for n in range(40):
        best = np.lexsort((np.arange(3000), -scores[n]))[:7]
        assert sorted(r[a == n]) == sorted(best) == sorted(plain[2][plain[0] == n])


def test_hard_negatives_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 2, [0.0, 1.0]), (1, 1, [2.0, 0.0]), (2, 3, [0.75, 0.0]), (3, 3, [0.75, 5.0]), (4, 3, [0.75, 0.0, 0.0])]
    rows += [(5, 1, None), (6, None, [1.0, 0.0]), (None, 1, [1.0, 0.0]), (7, 1, [nan, 0.0]), (8, 1, [inf, 0.0]), (9, 1, [None, 0.0]), (10, 1, []), (11, 3, [1e300, 0.0]), (12, 1, [1e15, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, label int, embedding array<double>, rank int, side int")
    got = sorted(map(tuple, hardneg.hard_negatives(df, F.col("vec_id") == 0).collect()))
    # the anchor 0 of label 1 has one positive; that of label 2 has none; two negatives tie
    assert got == [(0, 1, 1, 2, 131072, 49152), (0, 1, 2, 3, 131072, 49152)]
    assert hardneg.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0 and hardneg.hard_negatives(df.where("false"), F.lit(True)).count() == 0


# fill-in-the-middle


def test_rank_and_select():
    rng = np.random.default_rng(0)
    for size in (1, 63, 64, 65, 511, 512, 513, 5000):
        for part in (0.0, 0.01, 0.5, 1.0):
            ones = np.flatnonzero(rng.random(size) < part)
            b = fim.Boundaries(ones, size)
            at = np.arange(size + 1)
            assert (b.rank(at) == np.searchsorted(ones, at)).all()
            if len(ones):
                assert (b.select(np.arange(len(ones))) == ones).all()


def _lines(text):
    return text.splitlines(keepends=True) if "\r" not in text and "\x0b" not in text else [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text.split("\n")[-1] else [])


@pytest.mark.parametrize("rate,spm", [(100, 50), (50, 0), (0, 50), (100, 100)])
def test_fill_in_middle(spark, monkeypatch, rate, spm):
    monkeypatch.setattr(fim, "RUN_BYTES", 50_000)
    rng = random.Random(3)
    rows = [(k, TEXTS[k % len(TEXTS)] if k % 3 else "".join(rng.choice(["ab", "\n", "é", " "]) for _ in range(rng.randint(0, 60)))) for k in range(200)] + [(3, "twice\nthe\nid"), (None, "no\nid\nat all")]
    docs = _docs(spark, rows)
    out = fim.fill_in_middle(docs, rate=rate, spm=spm)
    got = sorted(map(tuple, out.withColumn("back", fim.restored("output", "form")).collect()), key=str)
    want = []
    for i, text in rows:
        text = text or ""
        units = _lines(text)
        n = len(units)
        d = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= rate:
            want.append((i, n, "plain", None, None, text, text))
        elif h[3] % 100 < spm:
            want.append((i, n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}", text))
        else:
            want.append((i, n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}", text))
    assert got == sorted(want, key=str)
    assert fim.fill_in_middle(docs.where("false")).count() == 0


def test_marks_that_overlap_are_refused(spark):
    for marks in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("<P>", ">S", "<M>"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(_docs(spark, []), marks=marks)


# fingerprints


def _paragraphs(text):
    return {x.strip(" \t\n\x0b\f\r") for x in (text or "").split("\n")} - {""}


def _near(a, b):
    a, b = _paragraphs(a), _paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def _edited(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + (after or "")[:half]


def test_fingerprints(spark):
    rng = random.Random(5)
    lines = [f"paragraph {k}" for k in range(4000)]
    texts = [*TEXTS, "\n".join(lines[:3000]), "\n".join(lines[500:]), *("\n".join(rng.choice(lines) for _ in range(rng.randint(0, 60))) for _ in range(60))]
    rows = [(7 * k - 100, t) for k, t in enumerate(texts)] + [(1_000_000, texts[3])]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(_docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True)
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        r, t, after = got[i], t or "", after or ""
        new = _edited(t, after)
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(_near(t, new)) and r["near_next"] == pytest.approx(_near(t, after))
    assert got[1_000_000]["fingerprint"] == got[7 * 3 - 100]["fingerprint"]
    assert len({r["fingerprint"] for r in got.values()}) == len({frozenset(_paragraphs(t)) for _, t in rows})


def test_fingerprints_awkward(spark):
    rows = [(None, "a\nb\nc"), (None, None), (5, "x\ny"), (5, "w\nz\nv"), (5, "x\ny"), (2, "k\nl\nm")]
    got = sorted(map(tuple, fingerprint.fingerprints(_docs(spark, rows)).select("doc_id", "n_chars", "edited_sha256", "near_next").collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(None, 5, sha("a\nb"), None), (None, 0, sha(""), None), (5, 3, sha("x\nk"), 0.0), (5, 3, sha("x\nk"), 0.0), (5, 5, sha("w\nzk\n"), 0.0), (2, 5, sha("k\nlw\n"), 0.0)]
    assert got == sorted(want, key=str)
    one = fingerprint.fingerprints(_docs(spark, [(1, "a\nb")])).collect()[0]
    assert one["near_next"] == 1.0 and fingerprint.fingerprints(_docs(spark, [])).count() == 0


def test_written_sketches_peel(spark):
    """Fingerprints alone give the digests that differ."""
    df = spark.createDataFrame([("a\nb\nc\nd", "b\nc\nd\ne\nf"), ("a", "a"), ("", "q")], "x string, y string")
    fp = lambda c: fingerprint.written(fingerprint.sketch(fingerprint.digests(F.col(c))))
    out = df.select(fp("x").alias("fx"), fp("y").alias("fy"), fingerprint.digests(F.col("x")).alias("dx"), fingerprint.digests(F.col("y")).alias("dy"))
    out = out.withColumn("p", fingerprint.peeled(fingerprint.subtracted(fingerprint.read(F.col("fx")), fingerprint.read(F.col("fy")))))
    for r in out.collect():
        assert r["p"]["ok"] and set(r["p"]["mine"]) == set(r["dx"]) - set(r["dy"]) and set(r["p"]["theirs"]) == set(r["dy"]) - set(r["dx"])
