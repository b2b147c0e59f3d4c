"""Collocations against a brute-force count, with heads, tiles and batches of any size."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest


def brute(rows, longest, least, top, share=100):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    often = {g: a for g, a in f.items() if a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) < 2:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(la == lang and len(q) > len(p) and 100 * b >= share * a
                     and any(q[i:i + len(p)] == p for i in range(len(q))) for (la, q), b in often.items())
        if not inside:
            out[lang].append((score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    rows = []
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        rows += [(lang, i, p, a, lo, r, m, s) for i, (s, a, p, lo, r, m) in enumerate(found[:top], 1)]
    return sorted(rows)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "é", "Aa", "\x01", "x y", "'"]
    weights = [1 / (i + 1) for i in range(len(words))]
    fixed = ["alpha beta gamma delta", "new york city", "the the the", "w1 w2"]
    rows = []
    for _ in range(n):
        out = []
        for _ in range(rng.randrange(0, 60)):
            out.append(rng.choice(fixed) if rng.random() < 0.15 else rng.choices(words, weights)[0])
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\r", ";", "!?", "\x0b"]))
        rows.append((rng.choice(["en", "de", None, "und"]), "".join(out)))
    return rows + [("en", None), ("en", ""), (None, "one"), ("fr", " .,; ")] + [("en", "Same text here")] * 40


@pytest.mark.parametrize("seed,least,share,sizes", [
    (1, 8, 100, {}),
    (2, 5, 100, {"HEAD": 16, "TILE": 4, "PAIRS": 500, "LISTED": 300, "WORDS": 20, "DENSE_TILES": 2, "BLOCK": 50, "BAND": 4}),
    (3, 5, 60, {"HEAD": 64, "TILE": 8, "PAIRS": 100, "LISTED": 200, "BLOCK": 7, "BAND": 16, "RANGE_BITS": 2, "DENSE_SHARE": 64, "FAN_IN": 2}),
])
def test_equals_brute_force(spark, monkeypatch, seed, least, share, sizes):
    """Workers import the module themselves, so the sizes are set there too while a task runs."""
    from reviewlens.llm import collocations
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, lang, text, "k", 1) for i, (lang, text) in enumerate(rows)],
                                 "doc_id long, lang string, text string, key string, run int").repartition(7)
    if sizes:
        def resized(make):
            def run(batches):
                usual = {k: getattr(collocations, k) for k in sizes}
                vars(collocations).update(sizes)
                try:
                    yield from make(batches)
                finally:
                    vars(collocations).update(usual)
            return run
        real = type(docs).mapInArrow
        monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: real(self, resized(f), *a, **b))
        for k, v in sizes.items():
            monkeypatch.setattr(collocations, k, v)
    got = collocations.ranked(collocations.mine(docs, least=least, share=share, longest=4), top=50)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()) \
        == brute(rows, 4, least, 50, share)


def test_exact_beyond_64_bits(spark):
    """1000 * a * n passes 64 bits."""
    from pyspark.sql import functions as F

    from reviewlens.llm import collocations
    big = 3_000_000_000
    level = spark.createDataFrame([("en", 1, 2, 3, big, "a b", "b", [big + 7, big], [big + 1, big])],
                                  "lang string, key long, left long, right long, a long, phrase string, last string, heads array<long>, tails array<long>")
    totals = spark.createDataFrame([("en", 40 * big)], "lang string, n long")
    words = level.limit(0)
    real = collocations.phrases
    collocations.phrases = lambda *a, **b: ([words, level], totals)
    try:
        r = collocations.mine(level.select(F.col("phrase").alias("text"), "lang")).first()
    finally:
        collocations.phrases = real
    assert r.score == 1000 * big * 40 * big // ((big + 7) * (big + 1)) and (r.l, r.r) == (big + 7, big + 1)


def test_blocks_come_back_whole():
    from reviewlens.llm import collocations as col
    rng = np.random.default_rng(0)
    left, right = rng.integers(0, 60_000, 30_000), rng.integers(0, 60_000, 30_000)
    near = col.Near.of(left, right)
    near.counts[5] = (1 << 40) + 3
    back = col.Near.merged([col.Near.unpacked(pa.scalar(b)) for _, _, b in near.blocks()])
    assert np.array_equal(back.key, near.key) and np.array_equal(back.counts, near.counts)
    assert all(f == col.Near.unpacked(pa.scalar(b)).key[0] and b_ == f >> 16 >> 7 for b_, f, b in near.blocks())
    far = col.Far.merged([col.Far(left, right, np.ones(len(left))), col.Far(left[:9], right[:9], np.full(9, 1 << 33))])
    back = col.Far.merged([col.Far.unpacked(pa.scalar(b)) for _, _, b in far.blocks()])
    assert all(np.array_equal(getattr(back, c), getattr(far, c)) for c in ("left", "right", "counts"))
    assert far.counts.sum() == len(left) + 9 * (1 << 33)


def test_nothing_to_find(spark):
    from reviewlens.llm import collocations
    for rows in ([], [("en", None)], [("en", "just a few words")]):
        docs = spark.createDataFrame(rows, "lang string, text string")
        assert collocations.ranked(collocations.mine(docs)).collect() == []


def test_long_text_and_repeated_rows(spark):
    from reviewlens.llm import collocations
    rows = [("en", "deep blue sea " * 100_000), ("en", "deep blue sea"), ("en", "deep blue sea")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = collocations.ranked(collocations.mine(docs)).collect()
    assert [tuple(r) for r in got] == brute(rows, 5, 100, 2000)
