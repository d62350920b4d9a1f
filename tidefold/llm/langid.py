"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text is cut into windows of STEPS bytes, read with MARGIN bytes more on either side so that words at a
border are seen whole. In each window one gated recurrent unit reads forwards and one backwards; at every
byte a softmax over both states gives language probabilities. A document's probabilities are the mean over
all bytes of its whole text, each labelled in the window that it belongs to. Training is backpropagation
through time with Adam on windows drawn from the whole texts of a bounded sample of the labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import held_out, ship

#: Bytes of a window and beside it, hidden units of each direction, windows handled together.
STEPS, MARGIN, HIDDEN, LANES = 64, 8, 12, 2048
#: The training sample: about so many labelled documents in all, as many of each language; their whole texts are learned from.
SAMPLE_DOCS = 6000
#: Steps of training, windows of a batch, least windows of a language in it, and the rate.
ROUNDS, BATCH, LEAST, RATE = 180, 384, 16, 0.02
#: 0 fills the end of the last window and is not counted.
PAD = 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Net:
    """wx: a row of 3 * HIDDEN gate inputs (update, reset, candidate) for each byte and direction; wh: recurrent weights; wo, bo: the softmax."""

    langs: list[str]
    wx: np.ndarray  # 2, 256, 3H
    wh: np.ndarray  # 2, H, 3H
    wo: np.ndarray  # 2H, L
    bo: np.ndarray  # L

    @staticmethod
    def new(langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Net:
        rng = np.random.default_rng(seed)
        draw = lambda s, *d: rng.normal(0, s, d).astype(np.float32)
        return Net(langs, draw(0.3, 2, 256, 3 * hidden), draw(0.3, 2, hidden, 3 * hidden), draw(0.3, 2 * hidden, len(langs)), np.zeros(len(langs), np.float32))

    def states(self, x: np.ndarray, d: int, keep: list | None = None) -> np.ndarray:
        """States (steps, lanes, H) of direction d over bytes x (steps, lanes), stored at the position of their byte."""
        steps, lanes = x.shape
        n = self.wh.shape[1]
        out, h = np.empty((steps, lanes, n), np.float32), np.zeros((lanes, n), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a, u = self.wx[d].take(x[t], 0), h @ self.wh[d]
            gates = _sigmoid(a[:, : 2 * n] + u[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(a[:, 2 * n :] + r * u[:, 2 * n :])
            if keep is not None:
                keep.append((t, h, z, r, c, u[:, 2 * n :]))
            h = c + z * (h - c)
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(steps, lanes, languages): a label for every position."""
        n = self.wh.shape[1]
        logits = self.states(x, 0) @ self.wo[:n] + self.states(x, 1) @ self.wo[n:] + self.bo
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def own_states(self, x: np.ndarray, margin: int = MARGIN) -> np.ndarray:
        """States (2, steps, lanes, H) of windows x (margin + steps + margin, lanes) at their own bytes, as states() gives them.

        A direction is not stepped through the margin behind it. Gates lie one after the other, so that each step works in place on whole arrays."""
        n, lanes, end = self.wh.shape[1], x.shape[1], len(x) - margin
        at = x.astype(np.intp)
        out = np.empty((2, end - margin, lanes, n), np.float32)
        a, u = np.empty((2, 3, lanes, n), np.float32)
        spare = np.empty((2, lanes, n), np.float32)
        for d in (0, 1):
            wx, wh = (np.ascontiguousarray(w[d].reshape(-1, 3, n).transpose(1, 0, 2)) for w in (self.wx, self.wh))
            wx[:2] *= 0.5  # the half in _sigmoid
            wh[:2] *= 0.5
            h = np.zeros((lanes, n), np.float32)
            gates, c = a[:2], a[2]
            for t in range(end) if d == 0 else range(len(x) - 1, margin - 1, -1):
                np.take(wx, at[t], 1, out=a, mode="clip")
                np.matmul(h, wh, out=u)
                gates += u[:2]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                u[2] *= gates[1]
                c += u[2]
                np.tanh(c, out=c)
                after = out[d, t - margin] if margin <= t < end else spare[t & 1]
                np.subtract(h, c, out=after)
                after *= gates[0]
                after += c
                h = after
        return out

    def summed(self, x: np.ndarray, live: np.ndarray, margin: int = MARGIN) -> np.ndarray:
        """(lanes, languages): probabilities() of windows, added up over their own bytes where live (steps, lanes) is 1."""
        n = self.wh.shape[1]
        h = self.own_states(x, margin).reshape(2, -1, n)
        p = self.wo[:n].T @ h[0].T
        p += self.wo[n:].T @ h[1].T
        p += self.bo[:, None]
        p -= p.max(0)
        np.exp(p, out=p)
        p *= live.ravel() / p.sum(0)
        return p.reshape(-1, *live.shape).sum(1).T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over positions that are not padding, and its gradients by backpropagation through time."""
        n = self.wh.shape[1]
        kept: list[list] = [[], []]
        h = [self.states(x, d, kept[d]) for d in (0, 1)]
        logits = h[0] @ self.wo[:n] + h[1] @ self.wo[n:] + self.bo
        logits -= logits.max(-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(-1, keepdims=True)
        live = (x != PAD).astype(np.float32)
        total = max(float(live.sum()), 1.0)
        at = np.broadcast_to(y, x.shape)
        loss = float(-(np.log(np.take_along_axis(p, at[..., None], 2)[..., 0] + 1e-9) * live).sum() / total)
        delta = p
        np.put_along_axis(delta, at[..., None], np.take_along_axis(delta, at[..., None], 2) - 1, 2)
        delta *= (live / total)[..., None]
        g_wx, g_wh, g_wo = np.zeros_like(self.wx), np.zeros_like(self.wh), np.zeros_like(self.wo)
        flat = delta.reshape(-1, delta.shape[-1])
        for d in (0, 1):
            part = slice(d * n, d * n + n)
            g_wo[part] = h[d].reshape(-1, n).T @ flat
            from_out = delta @ self.wo[part].T
            back = np.zeros((x.shape[1], n), np.float32)
            inputs = np.empty((*x.shape, 3 * n), np.float32)
            for t, before, z, r, c, u in reversed(kept[d]):
                g = from_out[t] + back
                dc = g * (1 - z) * (1 - c * c)
                dz = g * (before - c) * z * (1 - z)
                dr = dc * u * r * (1 - r)
                inputs[t] = np.concatenate([dz, dr, dc], 1)
                rec = np.concatenate([dz, dr, dc * r], 1)
                g_wh[d] += before.T @ rec
                back = g * z + rec @ self.wh[d].T
            order = x.ravel()
            for k in range(3 * n):
                g_wx[d][:, k] = np.bincount(order, inputs[..., k].ravel(), 256)
        return loss, [g_wx, g_wh, g_wo, flat.sum(0)]


def windows(texts: list[bytes], steps: int = STEPS, margin: int = MARGIN) -> tuple[np.ndarray, np.ndarray]:
    """(bytes (margin + steps + margin, windows), owner of each window) of whole texts; margins hold the neighbouring bytes."""
    counts = np.array([-(-len(t) // steps) for t in texts], np.int64)
    gap = bytes(margin)
    flat = np.frombuffer(b"".join(gap + t + bytes(-len(t) % steps) + gap for t in texts if t), np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    rank = np.arange(len(owner))
    texts_before = np.cumsum(counts > 0)[owner] - 1 if len(owner) else rank
    start = rank * steps + 2 * margin * texts_before
    return flat[start[None, :] + np.arange(steps + 2 * margin)[:, None]], owner


def train(texts: list[bytes], labels: list[str], rounds: int = ROUNDS, batch: int = BATCH, seed: int = 7) -> Net | None:
    """A net for the languages seen; None without a labelled text. Batches draw each language alike; of many languages, each batch takes some in turn."""
    langs = sorted(set(labels))
    if not langs:
        return None
    net = Net.new(langs)
    if len(langs) == 1:
        return net
    x, owner = windows(texts)
    y = np.array([langs.index(v) for v in labels])[owner]
    groups = [np.flatnonzero(y == k) for k in range(len(langs)) if (y == k).any()]
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in (net.wx, net.wh, net.wo, net.bo)]
    for i in range(1, rounds + 1):
        turn = groups if len(groups) <= batch // LEAST else [groups[k] for k in rng.permutation(len(groups))[: batch // LEAST]]
        pick = np.concatenate([g[rng.integers(0, len(g), batch // len(turn))] for g in turn])
        _, grads = net.gradients(np.ascontiguousarray(x[:, pick]), y[pick])
        rate = RATE * min(1, i / 10) * (1 - i / (rounds + 1)) ** 0.5
        for w, g, (m, v) in zip((net.wx, net.wh, net.wo, net.bo), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return net


def predict(net: Net | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, pooled probability) of whole texts, by bytes; texts without a byte get "und" and 0."""
    data = [(t or "").encode() for t in texts]
    score = np.zeros(len(texts))
    if net is None:
        return ["und"] * len(texts), score
    x, owner = windows(data)
    sums, seen = np.zeros((len(texts), len(net.langs))), np.zeros(len(texts))
    own = slice(MARGIN, MARGIN + STEPS)
    for a in range(0, x.shape[1], LANES):
        part = np.ascontiguousarray(x[:, a : a + LANES])
        live = (part[own] != PAD).astype(np.float32)
        np.add.at(sums, owner[a : a + LANES], net.summed(part, live))
        np.add.at(seen, owner[a : a + LANES], live.sum(0))
    pooled = sums / np.maximum(seen, 1)[:, None]
    best = pooled.argmax(1)
    lang = [net.langs[k] if n else "und" for k, n in zip(best.tolist(), seen.tolist(), strict=True)]
    return lang, np.where(seen > 0, np.clip(pooled[np.arange(len(texts)), best], 0, 1), 0.0)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Net | None:
    """Learns from documents that are not held out. The sample is bounded in rows only: about SAMPLE_DOCS documents, as many of each language (all, where there are
    fewer; of all alike, where there are more languages than that); their whole texts come along. Rows alike in id, text and language count once."""
    ship(docs.sparkSession)
    usable = docs.where(~F.coalesce(held_out(id_col), F.lit(False)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    usable = usable.select(F.col(id_col).alias("id"), F.col(text_col).alias("x"), F.col(lang_col).cast("string").alias("y"))
    counts = usable.groupBy("y").agg(F.count("*").alias("n"))
    langs, total = counts.agg(F.count("*"), F.sum("n")).first()
    if not langs:
        return None
    draw = F.pmod(F.xxhash64(F.lit(11), "id", "x"), F.lit(1 << 30)) / F.lit(float(1 << 30))  # rows without id differ by text
    if langs <= SAMPLE_DOCS:
        # at most SAMPLE_DOCS rows are broadcast: texts stay where they are
        share = counts.select(F.col("y").alias("of"), (F.lit(SAMPLE_DOCS / langs) / F.col("n")).alias("share"))
        drawn = usable.join(F.broadcast(share), F.col("y") == F.col("of")).where(draw < F.col("share"))
    else:
        drawn = usable.where(draw < SAMPLE_DOCS / total)
    rows = sorted(drawn.select("y", "x", "id").distinct().select("y", "x").collect())  # the same net whatever order the rows came in
    return train([r["x"].encode() for r in rows], [r["y"] for r in rows])


def _letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", net: Net | None = None) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    Only the text enters a prediction. lang_pred is "und" with score 0 where the text is null or has no letter, and everywhere if nothing
    is labelled. Rows without an id are not held out and are learned from; repeated rows are each judged alone. Other columns are not read. Scoring has no shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    net = net or learn(docs, id_col, text_col, lang_col)
    shipped = spark.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            letters = b.column(3).to_pylist()
            lang, score = predict(shipped.value, [t if ok else None for t, ok in zip(b.column(1).to_pylist(), letters, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(id_col, text_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held"), _letters(F.col(text_col)).alias("letters"))
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", rename: bool = False) -> DataFrame:
    """docs whose language is known: not "und". All columns stay as they are; with rename, lang_col is the language predicted from the text, for stages that follow.
    If nothing is labelled, no language can be told and docs pass through."""
    spark = docs.sparkSession
    net = learn(docs, id_col, text_col, lang_col)
    if net is None:
        return docs
    shipped = spark.sparkContext.broadcast(net)

    @F.pandas_udf("string")
    def predicted(texts: pd.Series) -> pd.Series:
        return pd.Series(predict(shipped.value, texts.tolist())[0], dtype=object)

    lettered = docs.where(_letters(F.col(text_col)))
    if not rename:
        return lettered.where(predicted(F.col(text_col)) != "und")
    once = predicted.asNondeterministic()  # else the filter below would predict a second time
    named = lettered.withColumn("__lang", once(F.col(text_col))).where(F.col("__lang") != "und")
    return named.select(*[F.col("__lang").cast(docs.schema[c].dataType).alias(c) if c == lang_col else F.col(c) for c in docs.columns])
