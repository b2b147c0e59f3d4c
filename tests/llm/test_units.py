"""Numbers of units against a plain dictionary, and how often words are asked for."""

import random

import numpy as np

from reviewlens.llm import units as U


def encode(units):
    lists = [list(map(ord, u)) for u in units]
    return np.array([x for y in lists for x in y], np.uint32), np.array([len(x) for x in lists], np.int64)


def test_tokens_of_odd_texts_equal_those_of_their_units():
    draw = random.Random(1)
    letters = ["a", "b", " "] * 4 + ["\n", "\t", "é", "　", "\x1c", "\xa0", "\x85", "﻿", "\U0001d4b3"]
    store = U.Store(encode, most=20)
    for _ in range(300):
        texts = ["".join(draw.choices(letters, k=draw.randint(0, 9))) for _ in range(draw.randint(0, 6))]
        ids, bounds = store.tokens(texts)
        assert ["".join(map(chr, ids[a:b])) for a, b in zip(bounds, bounds[1:])] == texts
    for c in U._WIDE:
        assert U.odd(f"é{c} x") and U.odd(f"é {c}x") and not U.odd(f"é{c}x")


def test_a_batch_asks_for_each_different_word_once():
    store, asked = U.Store(encode), []

    class Seen(type(store.at)):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    store.at = Seen(store.at.default_factory)
    store.tokens(["x word word", "y word other", "", "z word"])
    assert sorted(asked) == [" x", " y", " z", "other", "word"]
