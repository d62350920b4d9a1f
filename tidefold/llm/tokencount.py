"""Exact token counts at every prefix of a text, by dynamic programming.

In byte-pair encoding the last token of an encoded prefix is unique: it is the token t
ending there for which (last token of the prefix before t, t) is itself an encoded pair.
So one pass over a piece gives the count at each of its bytes:
count[end] = count[end - len(t)] + 1. The counts at every prefix of a word are stored for the
words of a bounded dictionary. Truncation ("the longest prefix within a budget") and budget
questions add the words' last counts up and read the counts of the word that is cut.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import LONGEST_WORD, MOST_WORDS, PIECES, SETTLED, Encoder, _Memo, words
from .runtime import ship

#: Most pairs whose validity a worker remembers.
MOST_PAIRS = 2_000_000


def _packed(counts: list[int]) -> bytes | list[int]:
    """One byte a count where they fit."""
    return bytes(counts) if max(counts) < 256 else counts


class _Counts(dict):
    """word -> tokens of lead + word; beside it, in tables, the counts at every prefix of that.

    A sentence end after letters is a piece of its own: such a word's counts are its stem's and one more."""

    def __init__(self, make, lead: str, marks: dict | None = None):
        super().__init__()
        self.make, self.lead, self.marks, self.tables = make, lead, marks, {}

    def _stem(self, word: str) -> bool:
        return self.marks is not None and word[-1:] in (".", ",") and word[:-1].isalpha() and (word.isascii() or max(word) < SETTLED)

    def __missing__(self, word):
        if self._stem(word):
            n = self[word[:-1]] + self.marks[word[-1]]
            if len(self) < MOST_WORDS and len(word) <= LONGEST_WORD:
                self[word] = n
            return n
        table = self.make(self.lead + word)
        if len(self) < MOST_WORDS and len(word) <= LONGEST_WORD:
            self[word], self.tables[word] = table[-1], table
        return table[-1]

    def table(self, word: str) -> bytes | list[int]:
        found = self.tables.get(word)
        if found is not None:
            return found
        if self._stem(word):
            return _packed([*self.table(word[:-1]), self[word]])
        return self.make(self.lead + word)


class PrefixCounter:
    """Counts for a rank-ordered byte-level BPE vocabulary file of the tokenizers library (.json),
    or, without prefix tables, for a sentencepiece model (.model)."""

    def __init__(self, path: str):
        self.path = path
        self.model = None
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        self.enc = Encoder(path)
        if not self.enc.byte_level:
            return
        self.added_ids = {self.enc.lib.token_to_id(a) for a in self.enc.added}
        back = {ord(c): b for b, c in self.enc.letters.items()}
        raw = lambda s: s.translate(back).encode("latin-1")
        spec = json.load(open(path, encoding="utf8"))["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["merges"]]
        # tokens are numbered in the order in which merges make them: single bytes, then one a merge
        number = {raw(c): n for n, c in enumerate(sorted(self.enc.letters.values()))}
        self.parts: list[tuple[int, int]] = [(n, n) for n in range(len(number))]
        self.joined: dict[int, int] = {}
        for a, b in merges:
            left, right = raw(a), raw(b)
            pair = (number[left], number[right])
            if left + right not in number:
                number[left + right] = len(self.parts)
                self.parts.append(pair)
            self.joined.setdefault(pair[0] << 20 | pair[1], number[left + right])
        self.number, self.longest = number, max(map(len, number))
        self.fits: dict[int, bool] = {}
        self.first = _Counts(self._word, "")
        self.rest = _Counts(self._word, " ", self.first)
        self.piece = _Memo(lambda p: _packed(self._by_characters(p, self.table(p))), "")

    def _stands(self, a: int, b: int) -> bool:
        """Whether a, b beside each other stay two tokens: undo merges, latest first, and look for one that would have joined across."""
        key = a << 20 | b
        bound, out = len(self.parts), True
        while True:
            made = self.joined.get(a << 20 | b)
            if made is not None and made < bound:
                out = False
                break
            if a > b:
                bound, a = a, self.parts[a][1]
                if a == bound:  # a single byte; then b, made earlier, is one too
                    break
            else:
                bound, b, was = b + 1, self.parts[b][0], b
                if b == was:
                    if self.parts[a][1] == a:
                        break
                    bound, a = a, self.parts[a][1]
        if len(self.fits) < MOST_PAIRS:
            self.fits[key] = out
        return out

    def table(self, piece: str) -> list[int]:
        """Tokens of each prefix of one pre-tokenizer piece, by bytes (0 first)."""
        data = piece.encode()
        n = len(data)
        count, last = [0] * (n + 1), [-1] * (n + 1)
        number, reach, fits = self.number.get, self.longest, self.fits.get
        for end in range(1, n + 1):
            # shortest token first: only one stands, and it is short more often than not
            for start in range(end - 1, max(-1, end - reach - 1), -1):
                token = number(data[start:end])
                if token is None:
                    continue
                if start:
                    before = last[start]
                    ok = fits(before << 20 | token)
                    if ok is None:
                        ok = self._stands(before, token)
                    if not ok:
                        continue
                last[end], count[end] = token, count[start] + 1
                break
        return count

    def _pieces(self, word: str) -> list[str]:
        """The pre-tokenizer's pieces; where Unicode tables may differ, the library's own."""
        if max(word) < SETTLED:
            return PIECES.findall(word)
        return [word[a:b] for _, (a, b) in self.enc.lib.pre_tokenizer.pre_tokenize_str(word)]

    def _counts(self, word: str) -> list[int]:
        """Tokens of word[:1], word[:2], .. word.

        A cut inside a piece leaves the pieces before it as they are and the rest a piece, but for two cases, within the first three characters of
        a piece: a contraction is not one yet, and white space at the end of a text falls into other pieces. There the last two pieces are cut again."""
        if (word[1:] if word[0] == " " else word).isalpha() and max(word) < SETTLED:
            return self._by_characters(word, self.table(word))
        out: list[int] = []
        done, before, sure = 0, "", 0  # tokens before the last piece; the last piece; its tokens
        for piece in self._pieces(word):
            counts, again = self.piece[piece], 0
            if piece[0] == "'" or before and piece[0].isspace():
                again = min(3, len(piece))
                for k in range(1, again + 1):
                    parts = self._pieces(before + piece[:k])
                    out.append(done + sum(sure if p == before else self.piece[p][-1] for p in parts))
            base = done + sure
            out += [base + c for c in counts[again:]]
            done, before, sure = base, piece, counts[-1]
        return out

    @staticmethod
    def _by_characters(piece: str, table: list[int]) -> list[int]:
        if piece.isascii():
            return table[1:]
        return [table[end] for end in accumulate(len(c.encode()) for c in piece)]

    def _word(self, word: str) -> bytes | list[int]:
        """The counts at every prefix of a word, with its leading space if it has one."""
        if not word:
            return b"\0"
        if len(word) < 256 and word.isascii() and (word[1:] if word[0] == " " else word).isalpha():
            return bytes(self.table(word)[1:])
        return _packed(self._counts(word))

    def _special(self, text: str) -> list[tuple[str, str]]:
        """(text before, added token) in order, with an empty token at the end."""
        found = self.enc.lib.encode(text, add_special_tokens=False)
        out, at = [], 0
        for t, (a, b) in zip(found.ids, found.offsets, strict=True):
            if t in self.added_ids:
                out.append((text[at:a], text[a:b]))
                at = b
        return [*out, (text[at:], "")]

    def _lasts(self, text: str) -> tuple[list[str], list[int]]:
        """The words of a text without added tokens, and the tokens of each."""
        head, *tail = words(text)
        return [head, *tail], [self.first[head], *map(self.rest.__getitem__, tail)]

    def _holds_added(self, text: str) -> bool:
        return any(a in text for a in self.enc.added)

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        if self.model is not None:
            return len(self.model.encode(text))
        if not self.enc.byte_level:
            return len(self.enc.whole(text)) // 4
        if self._holds_added(text):
            return sum(sum(self._lasts(before)[1]) + bool(token) for before, token in self._special(text))
        return sum(self._lasts(text)[1])

    def prefixes(self, text: str) -> list[int]:
        """Tokens of text[:i] for i = 0 .. len(text): the stored table. Byte-level vocabularies, texts without added tokens."""
        out, base = [0], 0
        for k, w in enumerate(words(text)):
            counts = (self.rest if k else self.first).table(w)
            out += [base + c for c in counts] if w or k else []
            base = out[-1]
        return out

    def longest_within(self, text: str, budget: int) -> int | None:
        """Characters of the longest prefix that has at most budget tokens; None for vocabularies that have no prefix tables."""
        if self.model is not None or not self.enc.byte_level:
            return None
        if not self._holds_added(text):
            return self._fit(text, budget)
        at = 0
        for before, token in self._special(text):
            n = sum(self._lasts(before)[1]) + bool(token)
            if n > budget or not token:
                # a cut inside an added token leaves plain text
                return at + self._fit(before + token[:-1], budget)
            at, budget = at + len(before) + len(token), budget - n

    def _fit(self, text: str, budget: int) -> int:
        """longest_within() of a text without added tokens. Words have one token at least, so it ends within the word after the last one that fits whole."""
        found, lasts = self._lasts(text)
        sums = list(accumulate(lasts))
        fit = bisect_right(sums, budget)  # words that fit whole
        if fit == len(found):
            return len(text)
        kept, used = sum(map(len, found[:fit])) + max(0, fit - 1), sums[fit - 1] if fit else 0
        counts = (self.rest if fit else self.first).table(found[fit])
        return kept + max((k for k, c in enumerate(counts, 1) if used + c <= budget), default=0)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit, fit_chars.

    fit_chars is the length of the longest prefix of at most ``limit`` tokens (the whole text if it fits; null if it does not and the
    vocabulary is not a byte-level one, which has no prefix tables).
    A null text counts as empty: no bytes, no tokens. Ids may be null or repeat: each row is counted for itself.
    Other columns are not read. Each row is handled alone, without a shuffle; memory is one Arrow batch and the word dictionary.
    """
    ship(docs.sparkSession)

    def run(batches):
        c = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [c.count(t) for t in texts]
            fits = [len(t) if k <= limit else c.longest_within(t, limit) for t, k in zip(texts, n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n]), pa.array(fits, pa.int64())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint")
