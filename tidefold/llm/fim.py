"""Fill-in-the-middle by succinct rank and select over unit boundaries.

The bytes of a batch of texts lie one after the other. A packed bitvector has a one at the last byte of every unit (a line with its line end,
or what follows the last line end). A directory holds the number of ones before every block of 512 bits. rank adds the popcounts of part of
a block to the directory's entry; select finds the block in the directory by binary search, then the 64-bit word by its popcounts, then the bit.
The total popcount of a text is its number of units, and select on two ranks gives the byte where the prefix and the middle end.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ship

#: Marks of prefix, suffix and middle; production settings: seed, percent of the texts that are rearranged, and of these in suffix-first form.
MARKS, SEED, RATE, SPM = ("<P>", "<S>", "<M>"), 7, 100, 50
#: 64-bit words of a block of the directory.
WORDS = 8
#: Bytes of texts under one bitvector, about: a batch's texts are cut into runs of so many.
RUN_BYTES = 8 << 20


class Boundaries:
    """A packed bitvector with rank and select."""

    def __init__(self, ones: np.ndarray, size: int):
        """ones: sorted places of the set bits below size."""
        words = -(-size // 64) or 1
        blocks = -(-words // WORDS)
        packed = np.zeros(blocks * WORDS * 64, bool)
        packed[ones] = True
        self.words = np.packbits(packed, bitorder="little").view("<u8")
        self.counts = np.bitwise_count(self.words).astype(np.int64).reshape(blocks, WORDS)
        self.directory = np.concatenate([[0], np.cumsum(self.counts.sum(1))])
        self.inside = np.cumsum(self.counts, axis=1) - self.counts  # ones before a word, within its block

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones there are before each place; a place may be the size."""
        word = np.minimum(at >> 6, len(self.words) - 1)
        bits = at - (word << 6)  # 64 where the place ends the last word
        low = np.where(bits < 64, (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
        return self.directory[word // WORDS] + self.inside.reshape(-1)[word] + np.bitwise_count(self.words[word] & low)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """The place of the one that has ``rank`` ones before it."""
        block = np.searchsorted(self.directory, rank, side="right") - 1
        left = rank - self.directory[block]
        word = (self.inside[block] <= left[:, None]).sum(1) - 1  # the last word with no more before it
        left = left - self.inside[block, word]
        value = self.words[block * WORDS + word]
        bit = np.zeros(len(rank), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count((value >> bit.astype(np.uint64)) & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= low
            left, bit = np.where(up, left - low, left), np.where(up, bit + half, bit)
        return (block * WORDS + word) * 64 + bit


def cuts(texts: list[bytes], h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, x, y) of each text: its units, and the bytes of the prefix and of prefix and middle, which end after the smaller and the larger of h1 % (n + 1) and h2 % (n + 1) units."""
    n, x, y = (np.zeros(len(texts), np.int64) for _ in range(3))
    if not texts:
        return n, x, y
    size = np.array([len(t) for t in texts], np.int64)
    runs = np.flatnonzero(np.diff((np.cumsum(size) - size) // RUN_BYTES)) + 1
    for start, end in pairwise([0, *runs.tolist(), len(texts)]):
        ends = np.cumsum(size[start:end])
        begin = ends - size[start:end]
        ones = np.flatnonzero(np.frombuffer(b"".join(texts[start:end]), np.uint8) == 10)
        bits = Boundaries(np.union1d(ones, ends[ends > begin] - 1), int(ends[-1]))  # the last byte of a text ends a unit
        before = bits.rank(begin)
        units = bits.rank(ends) - before
        a, b = h1[start:end] % (units + 1), h2[start:end] % (units + 1)

        def byte(k, before=before, begin=begin, bits=bits):
            some = k > 0
            out = np.zeros(len(k), np.int64)
            out[some] = bits.select(before[some] + k[some] - 1) + 1 - begin[some]
            return out

        n[start:end], x[start:end], y[start:end] = units, byte(np.minimum(a, b)), byte(np.maximum(a, b))
    return n, x, y


def _checked(marks: tuple[str, str, str]) -> None:
    """A mark must not arise where a text meets a mark: no mark may begin as another (or itself) ends, or lie in one."""
    for a in marks:
        for b in marks:
            if not a or (a is not b and a in b) or any(a[:k] == b[-k:] for k in range(1, min(len(a), len(b)))):
                raise ValueError("marks overlap")
    if len(set(marks)) < 3:
        raise ValueError("marks must differ")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """One row per document: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    Draws come from sha-256 of seed, a colon and the decimal id (nothing for a null id), so they do not depend on order; rows that repeat an id get the same draws,
    each on its own text. A null text is empty. Empty texts, texts that hold a mark, and those not drawn by ``rate`` stay plain. A text is cut whole, however long
    it is. Other columns are not read.
    """
    ship(docs.sparkSession)
    _checked(marks)
    p, s, m = marks
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).select("id", "text", *h)

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            h1, h2, h3, h4 = (b.column(k).to_numpy() for k in range(2, 6))
            n, x, y = cuts(texts, h1, h2)
            forms, prefix, middle, out = [], [], [], []
            for t, i, j, drawn, first in zip(texts, x.tolist(), y.tolist(), (h3 % 100 < rate).tolist(), (h4 % 100 < spm).tolist(), strict=True):
                if not t or not drawn or any(k in t for k in raw):
                    forms.append("plain"), prefix.append(None), middle.append(None), out.append(t)
                    continue
                a, c, d = t[:i], t[i:j], t[j:]
                forms.append("spm" if first else "psm"), prefix.append(len(a.decode())), middle.append(len(c.decode()))
                out.append(b"".join((raw[1], d, raw[0], a, raw[2], c) if first else (raw[0], a, raw[1], d, raw[2], c)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    raw = [k.encode() for k in (p, s, m)]
    kind = docs.schema[id_col].dataType.simpleString()
    made = chosen.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return made.select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column | str, form: Column | str, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that fill_in_middle() made an output of: its parts between the marks, in the order of the text."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = marks
    part = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)  # noqa: E731  between mark a and mark b
    last = F.substring_index(output, m, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(p, s), last, part(s, m))).when(form == "spm", F.concat(part(p, m), last, part(s, p)))


#: DuckDB SQL for op12 over the table documents, for ids that are not null.
FILL_IN_MIDDLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || doc_id::VARCHAR) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l, {", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))} FROM d),
c AS (SELECT *, len(l)::BIGINT AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN text = '' OR {" OR ".join(f"contains(text, '{k}')" for k in MARKS)} OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(l[1:a], '') AS x, array_to_string(l[a + 1:b], '') AS y, array_to_string(l[b + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{MARKS[0]}' || x || '{MARKS[1]}' || z || '{MARKS[2]}' || y ELSE '{MARKS[1]}' || z || '{MARKS[0]}' || x || '{MARKS[2]}' || y END) AS output_sha256, sha256(text) AS restored_sha256 FROM f
"""
