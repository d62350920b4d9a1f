"""Text quality by a generalised additive model with pairwise interactions.

Features of whole texts are binned; each feature has a look-up table with one value a bin, each chosen
pair of features a small table with one value a cell. Tables are learned by cyclic boosting: round after
round every feature in turn gets a shallow tree (at most three cuts) fitted to the current gradients; then
the pairs whose best quadrant split promises most get the same treatment. A score is the logistic of a sum of look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import held_out, ship, stored

#: Most labelled rows that a model is learned from (about; drawn by a hash of the id).
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, SMOOTH = 120, 60, 0.1, 5.0
FEATURES = (
    "log_words", "log_bytes", "word_bytes", "upper", "digit", "sign", "pipe", "stop", "comma", "other_mark",
    "not_ascii", "line_words", "dup_line", "unique_word", "short_word", "long_word", "next_repeat", "sentence_words", "mark_word", "top_word",
)


def _classes() -> np.ndarray:
    """256 x 8: which bytes are upper case, digits, signs, pipes, full stops, commas, other marks, not ASCII."""
    m = np.zeros((256, 8))
    for k, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>@^~{}[]\\/=+_", "|", ".", ",", "!?;:\"'()-")):
        m[list(chars.encode()), k] = 1
    m[128:, 7] = 1
    return m


_CLASSES = _classes()


def features(text: str | None) -> list[float]:
    """The features of one whole text; zeros for a null or empty one."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    upper, digit, sign, pipe, stop, comma, mark, high = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES).tolist()
    lens = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    total = int(lens.sum())
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    marked = sum(1 for w in words if w[-1] in b"#*$%&|<>")
    return [
        np.log1p(n), np.log1p(len(data)), total / n, upper / total, digit / total, sign / total, pipe / n, stop / n, comma / n, mark / total,
        high / total, n / len(lines), 1 - len(set(lines)) / len(lines), len(distinct) / n, float((lens <= 3).mean()), float((lens >= 12).mean()),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, n / (stop + 1), marked / n, max(distinct.values()) / n,
    ]


@dataclass
class Gam:
    base: float
    cuts: list[np.ndarray]  # bin borders of each feature
    tables: np.ndarray  # features x bins
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    cells: np.ndarray  # pairs x PAIR_BINS x PAIR_BINS

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: bins are looked up and added."""
        out = np.full(len(x), self.base)
        for f, c in enumerate(self.cuts):
            out += self.tables[f][np.searchsorted(c, x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_cuts[f], x[:, f], side="right") for p in self.pairs for f in p}
        for k, (a, b) in enumerate(self.pairs):
            out += self.cells[k][coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _borders(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(x) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SMOOTH)


def _tree(g: np.ndarray, h: np.ndarray, cuts: int = 3) -> np.ndarray:
    """Leaf values by bin of a tree with so many cuts at most, each cut where it gains most."""
    ends = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(cuts):
        best = (1e-9, -1)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = _gain(cg[m] - cg[a], ch[m] - ch[a]) + _gain(cg[b] - cg[m], ch[b] - ch[m]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(m[k])))
        if best[1] < 0:
            break
        ends = sorted([*ends, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + SMOOTH)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values by cell) of the best split of a pair's cells into four quadrants."""
    cg, ch = (np.pad(v, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for v in (g, h))
    i = np.arange(1, len(g))
    parts = []
    for c in (cg, ch):
        at, right, low, all_ = c[np.ix_(i, i)], c[i, -1][:, None], c[-1, i][None, :], c[-1, -1]
        parts.append((at, right - at, low - at, all_ - right - low + at))
    gain = sum(_gain(a, b) for a, b in zip(*parts, strict=True)) - _gain(cg[-1, -1], ch[-1, -1])
    r, c = divmod(int(np.argmax(gain)), len(i))
    value = [float(a[r, c] / (b[r, c] + SMOOTH)) for a, b in zip(*parts, strict=True)]
    out = np.empty_like(g)
    out[: r + 1, : c + 1], out[: r + 1, c + 1 :], out[r + 1 :, : c + 1], out[r + 1 :, c + 1 :] = value
    return float(gain[r, c]), out


def train(x: np.ndarray, y: np.ndarray) -> Gam:
    """Learns from features x and labels y (0 or 1). Without rows, or with one label only, every score is the prior's."""
    n, d = x.shape
    prior = (float(y.sum()) + 0.5) / (n + 1)
    base = float(np.log(prior / (1 - prior)))
    cuts, pair_cuts = [_borders(x[:, f], BINS) for f in range(d)], [_borders(x[:, f], PAIR_BINS) for f in range(d)]
    model = Gam(base, cuts, np.zeros((d, BINS)), [], pair_cuts, np.zeros((0, PAIR_BINS, PAIR_BINS)))
    if n == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(cuts[f], x[:, f], side="right") for f in range(d)]
    logit = np.full(n, base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(d):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[f], g, BINS), np.bincount(bins[f], h, BINS))
            model.tables[f] += step
            logit += step[bins[f]]
    coarse = [np.searchsorted(pair_cuts[f], x[:, f], side="right") for f in range(d)]
    size = PAIR_BINS * PAIR_BINS
    shape = (PAIR_BINS, PAIR_BINS)
    g, h = slopes()
    ranked = sorted(((-_quadrants(np.bincount(i := coarse[a] * PAIR_BINS + coarse[b], g, size).reshape(shape), np.bincount(i, h, size).reshape(shape))[0], a, b) for a in range(d) for b in range(a + 1, d)))
    model.pairs = [(a, b) for gain, a, b in ranked[:PAIRS] if gain < 0]
    model.cells = np.zeros((len(model.pairs), *shape))
    at = [coarse[a] * PAIR_BINS + coarse[b] for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, i in enumerate(at):
            g, h = slopes()
            step = RATE * _quadrants(np.bincount(i, g, size).reshape(shape), np.bincount(i, h, size).reshape(shape))[1]
            model.cells[k] += step
            logit += step.ravel()[i]
    return model


def with_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for b in batches:
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=[id_col, "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, x array<double>")


def learn(made: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Gam:
    """A model from made(id, x) and labels; rows that are held out, or whose label is neither 0 nor 1, are not used."""
    usable = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).cast("int").alias("y"))
    n = usable.count()
    part = F.pmod(F.xxhash64(F.lit(21), id_col), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_ROWS / max(n, 1)))
    rows = sorted((tuple(r["x"]), r["y"]) for r in made.join(usable.where(part), id_col).select("x", "y").collect())
    return train(np.array([r[0] for r in rows]).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], float))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Features come from the whole text alone; a null or empty text has all features 0 and is scored like any other. Null ids are not held out;
    repeated rows are each scored. Other columns are not read. Texts are read once: features are stored, then used to learn and to score.
    """
    spark = docs.sparkSession
    ship(spark)
    made = stored(spark, with_features(docs, id_col, text_col), "features")
    shipped = spark.sparkContext.broadcast(learn(made, labels, id_col, label_col))

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            s = shipped.value.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return made.select(id_col, "x", F.coalesce(held_out(id_col), F.lit(False)).alias("held")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
