"""Word hashes of whole texts and hashed n-grams, a batch at a time."""

from __future__ import annotations

import re
import zlib

import numpy as np

#: Words a worker remembers.
REMEMBERED = 500_000
_KNOWN: dict[str, int] = {}
_WORD = re.compile(r"\w+|[^\w\s]+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of word characters, and runs of other signs."""
    return _WORD.findall(text.lower()) if text else []


def word_hashes(found: list[str]) -> np.ndarray:
    """A 64-bit hash of each word, equal on every machine."""
    if len(_KNOWN) > REMEMBERED:
        _KNOWN.clear()
    for w in set(found).difference(_KNOWN):
        raw = w.encode()
        _KNOWN[w] = zlib.crc32(raw) | zlib.crc32(raw, 0x9E3779B9) << 32
    return np.fromiter(map(_KNOWN.__getitem__, found), "u8", len(found))


def _slot(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - bits)).astype("i4")


def grams(h: np.ndarray, bits: int) -> np.ndarray:
    """Hashed words, bigrams, and skip-grams over one and two words."""
    out = [_slot(h, 1, bits)]
    for kind, gap in ((2, 1), (3, 2), (4, 3)):
        if len(h) > gap:
            out.append(_slot(h[:-gap] * np.uint64(0x632BE59BD9B4E019) + h[gap:], kind, bits))
    return np.concatenate(out)
