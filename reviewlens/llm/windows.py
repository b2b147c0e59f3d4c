"""Runs of byte windows that share a minimiser.

Of the K-byte strings in a window of ``width`` bytes, the one with the smallest hash (the
first of equals) is the window's minimiser.  Equal windows have equal minimisers, so a
window whose minimiser occurs in no other run can't occur elsewhere.  Consecutive
windows with one minimiser position form a run; a run is stored as its first byte and its
number of windows.
"""

from __future__ import annotations

import numpy as np

from reviewlens.llm import textbatch as tb

K = 56


def runs(data: np.ndarray, offs: np.ndarray, width: int):
    """(row, start in the row, windows, minimiser's place in the run, its hash, run hash) of each run."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    spans = tb.Spans(data)
    at = np.arange(n - K + 1)
    hashes = tb.mix(spans.raw(at, at + K))
    bits = np.uint64(max(24, int(n).bit_length()))
    key = (hashes >> bits << bits) | at.astype(np.uint64)
    steps, have = width - K + 1, 1
    while have * 2 <= steps:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < steps:
        key = np.minimum(key[:-(steps - have)], key[steps - have:])
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # of window i's minimiser
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:len(place)]
    inside = np.arange(len(place)) + width <= offs[1:][row]
    new = inside.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1] | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    # a run ends before the next one, or with the text's last window
    last = np.minimum(np.append(first[1:], len(place)), offs[1:][row[first]] - width + 1)
    count = last - first
    whole = spans.hash(first, last - 1 + width)
    return row[first], first - offs[row[first]], count, place[first] - first, hashes[place[first]], whole
