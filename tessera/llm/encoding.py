"""Whole-text token ids through the ``tokenizers`` library, fast on word tails.

The library spends most of its time on bookkeeping per word, so a text is cut
where its pre-tokenizer always cuts, and each distinct piece goes through the
library once per worker. The ids equal those of encoding the whole text.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Pieces a worker remembers; beyond it pieces are encoded again when met.
REMEMBERED = 1_200_000
_LOADED: dict[tuple[str, str], "PieceEncoder"] = {}
#: Python splits at these and the vocabularies' patterns do not.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_STOPS = ".,;:"
#: Neighbours of white space, white space but blanks and line ends, and the mark used below.
_PAIRS, _UNUSUAL = ("  ", "\n\n", " \n", "\n "), "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x01"
_WIDE = re.compile(f"[{_UNUSUAL}\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def odd(text: str) -> bool:
    """Whether a text (not empty) has neighbouring or unusual white space, or some at its ends."""
    if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _PAIRS):
        return True
    return any(x in text for x in _UNUSUAL) if text.isascii() else _WIDE.search(text) is not None


class PieceEncoder:
    """``split``: "byte" cuts before single spaces and around single line ends
    (other texts: the vocabulary's own pattern); "word" cuts at white space,
    which that vocabulary drops."""

    def __init__(self, path: str, split: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.split = split
        self.mark, self.glue = ("\n", "\n") if split == "byte" else ("|", " | ")
        if split == "byte":
            import public_tokenizers
            import regex

            self.pattern = regex.compile(public_tokenizers.PATTERN)
        marks = self._whole(self.mark)
        self.mark_id = int(marks[0]) if len(marks) == 1 else None
        self.known: dict[str, bytes] = {"": b""}
        self.stops: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def pieces(self, text: str) -> list[str]:
        if self.split == "word":
            return text.split(" ") if _SEPARATORS.search(text) else text.split()
        if odd(text):
            return self.pattern.findall(text)
        return text.replace("\n", "\x01\n\x01").replace(" ", "\x01 ").split("\x01")

    def _learn(self, new: list[str], into: dict[str, bytes]) -> None:
        words, stopped = {}, []
        for x in new:
            if x[-1] in _STOPS and (word := x.rstrip(_STOPS)) and word[-1].isalpha():
                stopped.append((x, word))  # a stop after a letter is always a pre-token of its own
                if word in self.known:
                    continue
                x = word
            words[x] = None
        each = [x for x in words if not x[-1].isspace()]  # white space would join the glue's run
        if self.mark_id is not None:
            for i in range(0, len(each), 512):
                groups = [each[j : j + 16] for j in range(i, min(i + 512, len(each)), 16)]
                found = self.tokenizer.encode_batch_fast([self.glue.join(g) for g in groups], add_special_tokens=False)
                for group, ids in zip(groups, found, strict=True):
                    ids = np.array(ids.ids, dtype="<u4")
                    raw, cuts = ids.tobytes(), (ids == self.mark_id).nonzero()[0].tolist()
                    if len(cuts) == len(group) - 1:  # else a piece holds the mark itself
                        start = 0
                        for x, end in zip(group, [*cuts, len(ids)], strict=True):
                            into[x] = raw[4 * start : 4 * end]
                            start = end + 1
        for x in words:
            if x not in into:
                into[x] = self._whole(x).tobytes()
        for x, word in stopped:
            into[x] = into[word] + self._stop(x[len(word) :])

    def _stop(self, text: str) -> bytes:
        if text not in self.stops:
            self.stops[text] = self._whole(text).tobytes()
        return self.stops[text]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty."""
        cut = [self.pieces(t) if t else [] for t in texts]
        known = self.known
        own = set().union(*cut)
        new = list(own.difference(known))
        if new:
            if len(self.stops) > 10_000:
                self.stops.clear()
            if len(known) + 2 * len(new) <= REMEMBERED:
                self._learn(new, known)
            else:
                known = _Both(known)
                self._learn(new, known)
        # A small table of this batch's pieces: each occurrence is looked up in it.
        get = {p: known[p] for p in own}.__getitem__
        return [b"".join(map(get, c)) for c in cut]


class _Both(dict):
    """Pieces of this batch, and behind them those that are remembered."""

    def __init__(self, behind: dict[str, bytes]):
        super().__init__()
        self.behind = behind

    def __missing__(self, key: str) -> bytes:
        return self.behind[key]

    def __contains__(self, key: object) -> bool:
        return super().__contains__(key) or key in self.behind


def encoder(path: str, split: str) -> PieceEncoder:
    """One per worker process and vocabulary."""
    if (path, split) not in _LOADED:
        _LOADED[path, split] = PieceEncoder(path, split)
    return _LOADED[path, split]
