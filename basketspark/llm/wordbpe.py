"""Whole texts to ids of a word-level BPE, word by word with a memory of words seen.

In this vocabulary's scheme no pre-token crosses white space and every pre-token is encoded
by itself, so the ids of a text are those of its words in order, and a word that was met
before needs no second encoding. Texts with characters beyond Latin scripts, control
characters or a special token's string go through the tokenizer as a whole.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from array import array

import numpy as np

SPLIT = re.compile(r"[^\W\d_]+|\d|'s|'t|'re|'ve|'m|'ll|'d|(?:[^\s\w]|_)+")
WHOLE = re.compile("[^\t\n\x0b\x0c\r -~\x85-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞₠-₿]|<\\|(?:start|end)oftext\\|>")
REMEMBERED = 1_000_000


class Words(dict):
    """Lower-case word -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        table = {b: chr(b) for b in shown}
        self.shown = table | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in table)}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if word.isalpha():
            out = array("I", [t.id for t in self.model.tokenize(word if word.isascii() else self.show(word))]).tobytes()
        elif word[:-1].isalpha() and word[-1] in ".,!?:;":
            out = self[word[:-1]] + self[word[-1]]
        else:
            out = b"".join(array("I", [t.id for t in self.model.tokenize(self.show(part))]).tobytes() for part in SPLIT.findall(word))
        self[word] = out
        return out

    def show(self, part: str) -> str:
        return "".join(map(self.shown.__getitem__, part.encode()))

    def encode(self, text: str) -> bytes:
        if WHOLE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return b"".join(map(self.__getitem__, text.lower().split()))


@functools.lru_cache(1)
def words(path: str) -> Words:
    return Words(path)
