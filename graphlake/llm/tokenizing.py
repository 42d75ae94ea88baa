"""Token ids of the public word-level BPE, through a cache of words.

The tokenizer splits a normalised text into words and encodes each by itself, so
a word's ids are computed once a worker and looked up afterwards.  Texts with
characters whose normalisation or class this module does not know for certain
(beyond Latin letters, or that spell a special token) go to the tokenizer whole.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

from graphlake.llm.common import Remembered

# White space, printable ASCII and the Latin letters up to U+017F without U+0130, whose lower case is two characters.
_UNKNOWN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ſ]")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
# The tokenizer's own split, with its classes spelled out for the characters above.
_LETTER = "a-zªµºß-öø-ÿā-ſ"
_DIGIT = "0-9²³¹¼½¾"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 and up, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Encoder:
    """Ids of a normalised word, found by the tokenizer's model alone."""

    def __init__(self, model) -> None:
        self.model, self.letters = model, _byte_letters()

    def __call__(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return tokenizer, Remembered(_Encoder(tokenizer.model))


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, without special tokens; null is empty."""
    tokenizer, known = _tokenizer(path)
    out: list[bytes] = []
    for text in texts:
        if not text:
            out.append(b"")
        elif _UNKNOWN.search(text) or _SPECIAL.search(text):
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            out.append(np.asarray(ids, "<u4").tobytes())
        else:
            out.append(b"".join(map(known.__getitem__, _WORDS.findall(text.lower()))))
    return out


def forget(path: str) -> None:
    """Let go of remembered words, at the end of a task."""
    _tokenizer(path)[1].clear()
