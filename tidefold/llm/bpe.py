"""Exact byte-level BPE of whole texts, one cached word at a time.

A text is cut before every space that follows a non-space character. The byte-level
pre-tokenizer never joins characters across such a place and never looks past it, so
the ids of a text are the ids of its words in order. Words repeat, so most of them come
from a bounded dictionary. Only words not in it go to the tokenizers library.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A space that may not be cut at: it follows white space.
_ODD = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")
#: The pieces of the byte-level pre-tokenizer (fixed values): contractions, letters, numbers, other signs, white space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Below this character all Unicode tables agree on what is a letter or a number; words beyond go to the library whole.
SETTLED = "\u0530"
#: Most entries in a word dictionary, and the longest word kept there.
MOST_WORDS, LONGEST_WORD = 800_000, 64


def words(text: str) -> list[str]:
    """The words of a text; each but the first has lost one leading space."""
    return text.split(" ") if not _ODD.search(text) else _CUT.split(text)


class _Memo(dict):
    """word -> what make(lead + word) returns."""

    def __init__(self, make, lead: str):
        super().__init__()
        self.make, self.lead = make, lead

    def __missing__(self, word):
        out = self.make(self.lead + word)
        if len(self) < MOST_WORDS and len(word) <= LONGEST_WORD:
            self[word] = out
        return out


class Encoder:
    """ids of whole texts as little-endian unsigned 32-bit integers, equal to the library's."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model  # each look at this property makes an object
        spec = json.load(open(path, encoding="utf8"))
        self.byte_level = _is_byte_level(spec)
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        self.letters = byte_letters()
        self.first, self.rest = _Memo(self._word, ""), _Memo(self._spaced, " ")
        self.pieces = _Memo(self._piece, "")

    def whole(self, text: str) -> bytes:
        return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Letters with at most one leading space are one piece: the library's model takes it as it is."""
        if not word:
            return b""
        if max(word) >= SETTLED:
            return self.whole(word)
        if not (word[1:] if word[0] == " " else word).isalpha():
            return b"".join(map(self.pieces.__getitem__, PIECES.findall(word)))
        return self._piece(word)

    def _piece(self, piece: str) -> bytes:
        mapped = "\u0120" + piece[1:] if piece[0] == " " and piece.isascii() and piece[1:].isalpha() else piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _spaced(self, word: str) -> bytes:
        """A sentence end after letters is a piece of its own: the stem is looked up first."""
        if word[-2:-1].isalpha() and word[-1] in ".," and word[1:-1].isalpha():
            return self.rest[word[1:-1]] + self.first[word[-1]]
        return self._word(word)

    def encode(self, text: str) -> bytes:
        if not self.byte_level or any(a in text for a in self.added):
            return self.whole(text)
        head, *tail = words(text)
        return self.first[head] + b"".join(map(self.rest.__getitem__, tail))


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a printable Latin-1 byte as itself, the others in order as U+0100 and up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _is_byte_level(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE"


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
