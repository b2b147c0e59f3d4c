"""Texts as units whose tokens don't depend on their neighbours, and a store of those tokens.

The pre-tokenisers used here never join a word to what follows the next blank, so where
every blank stands between two other characters, the tokens of a text are those of its
first word and then of each blank with its word, one after the other.  A text with other
white space beside a blank, or a blank at an end, is one unit.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = re.compile(r"\s[ ]|[ ]\s|\A[ ]|[ ]\Z|[\x1c-\x1f]")
_ODD_ASCII = [x for c in " \t\n\v\f\r" for x in (c + " ", " " + c)] + ["\x1c", "\x1d", "\x1e", "\x1f"]
_WIDE = [c for c in map(chr, range(128, 0x3001)) if c.isspace()]


def odd(text: str) -> bool:
    if text.isascii() or not any(c in text for c in _WIDE):
        return text[0] == " " or text[-1] == " " or any(x in text for x in _ODD_ASCII)
    return _ODD.search(text) is not None


def split(text: str) -> list[str]:
    """Keys of the units: a word stands for a blank and the word; a blank and a string for the string."""
    if not text:
        return []
    if odd(text):
        return [" " + text]
    keys = text.split(" ")
    keys[0] = " " + keys[0]
    return keys


def unit(key: str) -> str:
    return key[1:] if key[0] == " " else " " + key


class Store:
    """Token ids by unit.  ``encode`` maps a list of units to (flat ids, ids per unit).

    Beyond ``most`` units, those asked for only once go; should the rest be more than half
    of ``most``, all go.  So memory is bounded, and what goes is encoded again if needed.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 250_000):
        self.encode, self.most = encode, most
        self.at = defaultdict(count().__next__)  # numbers keys in the order in which they are first asked for
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(1, np.int64)
        self.asked = np.zeros(0, np.int32)

    def _forget(self) -> None:
        keep = np.flatnonzero(self.asked > 1)
        if len(keep) > self.most // 2:
            keep = keep[:0]
        keys = list(self.at)
        self.at = defaultdict(count(len(keep)).__next__, ((keys[k], n) for n, k in enumerate(keep.tolist())))
        self.flat, ends = take(self.flat, self.start[keep], self.start[keep + 1])
        self.start = np.append(0, ends)
        self.asked = np.ones(len(keep), np.int32)

    def _numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(units, bounds): the numbers of the units of :func:`split` of each text.

        Arrow splits the texts and finds the different words of all of them; only those are asked for."""
        whole = np.fromiter(map(odd, (t or "." for t in texts)), bool, len(texts))
        empty = np.fromiter((not t for t in texts), bool, len(texts))
        pieces = pc.split_pattern(pa.array(("" if w else t for w, t in zip(whole.tolist(), texts)), pa.large_string()), " ")
        bounds = np.asarray(pieces.offsets).astype(np.int64)  # an empty string is one piece
        words = pieces.flatten().dictionary_encode()
        codes = words.indices.to_numpy().astype(np.int64)
        first = np.zeros(len(codes), bool)
        first[bounds[:-1]] = True
        asked = np.zeros(len(words.dictionary), bool)
        asked[codes[~first]] = True
        used = np.flatnonzero(asked)
        numbers = np.zeros(len(words.dictionary), np.int64)
        numbers[used] = np.fromiter(map(self.at.__getitem__, words.dictionary.take(pa.array(used)).to_pylist()), np.int64, len(used))
        which = numbers[codes]
        filled = np.flatnonzero(~empty)
        starts = (" " + (texts[i] if whole[i] else texts[i].split(" ", 1)[0]) for i in filled.tolist())
        which[bounds[filled]] = np.fromiter(map(self.at.__getitem__, starts), np.int64, len(filled))
        gone = np.zeros(len(codes), bool)
        gone[bounds[:-1][empty]] = True
        return which[~gone], bounds - np.append(0, np.cumsum(empty))

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, bounds): text i has ids[bounds[i]:bounds[i + 1]]."""
        if len(self.at) > self.most:
            self._forget()
        known = len(self.at)
        which, bounds = self._numbered(texts)
        if len(self.at) > known:
            keys = list(islice(self.at, known, None))
            flat, sizes = self.encode([unit(k) for k in keys])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, flat])
            self.asked = np.concatenate([self.asked, np.zeros(len(keys), np.int32)])
        self.asked += np.bincount(which, minlength=len(self.asked)).astype(np.int32)
        ids, ends = take(self.flat, self.start[which], self.start[which + 1])
        return ids, np.append(0, ends)[bounds]


def take(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans flat[start:end] one after the other, and where each of them ends."""
    sizes = end - start
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - sizes), sizes) + np.arange(total)], ends
