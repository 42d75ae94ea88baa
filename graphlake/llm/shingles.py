"""Sets of hashed word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

from graphlake.llm.common import Remembered

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


_WORDS = Remembered(xxhash.xxh3_64_intdigest)


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """The distinct hashed shingles of a text, sorted; words are split at ASCII blanks, A-Z lower-cased.

    A text of fewer words than ``width`` has its whole sequence as one shingle; a
    text without words has none.
    """
    words = text.lower().split() if text else ()  # bytes: ASCII only, both
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(width, len(own))
    out = own[: len(own) - width + 1].copy()
    for k in range(1, width):
        out *= _MIX
        out += own[k : len(own) - width + 1 + k]
        out ^= out >> _SHIFT
    out += np.uint64(width)
    return np.unique(out)


def forget() -> None:
    """Let go of remembered words, at the end of a task."""
    _WORDS.clear()
