"""Token ids of whole texts by the tokenizers library, through a cache of words.

Both vocabularies split a text at white space before any merge, so the ids of a text are those of its words, one after
the other. Words repeat, so each worker encodes a word once. A text with white space of which the rule does not hold
for certain, or with the beginning of a special token, goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

END_ID = 2
CACHED_WORDS = 300_000
LONGEST_CACHED = 64
_EXOTIC = re.compile(r"[^\S \n\t\r]")
_UNSURE = re.compile(r"[^\S \n]|\s[ \n]|\x00|^[ \n]")
#: The printable characters that stand for bytes in byte-level vocabularies: a byte that prints stands for itself, the others follow from U+0100.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įıĴ-ɏ]+")
_SIGNS = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-įıĴ-ɏ]+)([!-&(-/:-@\[-`{-~]+)")
_CODERS: dict[tuple[str, str], Coder] = {}


class Words(dict):
    """From a piece to its ids, packed; fills itself. old: the generation before, so that a bounded cache keeps what is in use."""

    def __init__(self, kind: str, tokenizer, old: dict[str, bytes]):
        super().__init__({"": b""})
        self.spaced, self.tokenizer, self.tokenize, self.old = kind == "byte", tokenizer, tokenizer.model.tokenize, old

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.new(word)
        if len(word) <= LONGEST_CACHED:
            self[word] = found
        return found

    def new(self, word: str) -> bytes:
        """A run of plain letters is one token run, which needs no normaliser; ASCII signs after one are another run."""
        bare = word[1:] if self.spaced and word[0] == " " else word
        if not bare.isalpha():
            if m := _SIGNS.fullmatch(word):
                return self[m[1]] + self[m[2]]
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if not bare.isascii():
            if not _LATIN.fullmatch(bare):
                return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            bare = (bare if self.spaced else bare.lower()).encode().decode("latin-1").translate(_BYTE_CHARS)
        elif not self.spaced:
            bare = bare.lower()
        return array("I", [x.id for x in self.tokenize("Ġ" + bare if self.spaced and word[0] == " " else bare)]).tobytes()


class Coder:
    """kind 'word': white space is dropped. kind 'byte': one space belongs to the word after it."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.kind, self.tokenizer = kind, Tokenizer.from_file(path)
        self.special = tuple({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.words = Words(kind, self.tokenizer, {})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pieces(self, text: str) -> list[str] | None:
        """Parts that are encoded apart, or None if the text must be encoded whole."""
        if any(x in text for x in self.special):
            return None
        if self.kind == "word":
            return None if _EXOTIC.search(text) else text.split()
        if _UNSURE.search(text):
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids and the end id, as little-endian unsigned 32-bit integers."""
        end = np.array([END_ID], "<u4").tobytes()
        if len(self.words) > CACHED_WORDS:
            self.words.old = {}
            self.words = Words(self.kind, self.tokenizer, self.words)
        get = self.words.__getitem__
        split = map(self.pieces, texts)
        return [(self.whole(t) if p is None else b"".join(map(get, p))) + end for t, p in zip(texts, split, strict=True)]


def coder(path: str, kind: str) -> Coder:
    """One coder for each worker process and vocabulary."""
    if (path, kind) not in _CODERS:
        _CODERS[path, kind] = Coder(path, kind)
    return _CODERS[path, kind]
