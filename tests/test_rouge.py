"""ROUGE and cosine goldens on the original demo strings (FIXTURES §4)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.functions import vectors as V
from reviewlens.operators import rouge as RG


def _scores(spark, hyp, ref):
    pairs = spark.createDataFrame([("k", hyp, ref)], "asin string, hyp string, ref string")
    rows = RG.rouge_all(pairs, "asin").collect()
    return {r["rouge_type"]: (r["f"], r["p"], r["r"]) for r in rows}


def test_rouge_demo(spark):
    s = _scores(spark, "the cat ate the rat", "the fat cat ate the rat")
    assert s["rouge-1"][0] == pytest.approx(.9091, abs=1e-4)
    assert s["rouge-2"][0] == pytest.approx(.6667, abs=1e-4)
    assert s["rouge-3"][0] == pytest.approx(.5714, abs=1e-4)
    assert s["rouge-4"][0] == pytest.approx(.4, abs=1e-4)
    assert s["rouge-l"][1] == pytest.approx(1.0) and s["rouge-l"][2] == pytest.approx(5 / 6)
    assert s["rouge-w"][1] == pytest.approx(.924, abs=1e-3)
    assert s["rouge-w"][2] == pytest.approx(.770, abs=1e-3)


def test_rouge_identical_is_one(spark):
    s = _scores(spark, "Summaries are useful, summaries are short.", "summaries are useful summaries are short")
    for t in RG.ROUGE_TYPES:
        assert s[t][0] == pytest.approx(1.0)


def test_cosine_demo(spark):
    df = spark.createDataFrame([([1.0, 2.0, 7.0, 5.0, 6.0], [3.0, 5.0, 4.0, 0.0, 6.0])], "a array<double>, b array<double>")
    assert df.select(V.cosine("a", "b")).first()[0] == pytest.approx(.774270, abs=1e-6)


def test_triplet_margin(spark):
    # d_pos = .2, d_neg = .1 as squared distances along one axis
    df = spark.createDataFrame([([0.0], [0.2 ** .5], [0.1 ** .5])], "a array<double>, p array<double>, n array<double>")
    assert df.select(V.triplet_margin("a", "p", "n")).first()[0] == pytest.approx(.11)


def test_common_lengths_equal_a_cell_by_cell_table():
    rng = np.random.default_rng(0)
    n, m = rng.integers(0, 9, 200), rng.integers(0, 12, 200)
    h, r = np.full((200, 8), -1), np.full((200, 11), -2)
    for k in range(200):
        h[k, :n[k]], r[k, :m[k]] = rng.integers(0, 3, n[k]), rng.integers(0, 3, m[k])
    got = RG.common_lengths(h, r, n, m, 1.2)
    for k in range(200):
        length, weight, run = (np.zeros((n[k] + 1, m[k] + 1)) for _ in range(3))
        for i in range(1, n[k] + 1):
            for j in range(1, m[k] + 1):
                if h[k, i - 1] == r[k, j - 1]:
                    x = run[i - 1, j - 1]
                    length[i, j], run[i, j] = length[i - 1, j - 1] + 1, x + 1
                    weight[i, j] = weight[i - 1, j - 1] + (x + 1) ** 1.2 - x ** 1.2
                else:
                    length[i, j] = max(length[i - 1, j], length[i, j - 1])
                    weight[i, j] = max(weight[i - 1, j], weight[i, j - 1])
        assert got[0][k] == length[-1, -1] and got[1][k] == pytest.approx(weight[-1, -1])


def test_empty_sides_score_nothing(spark):
    for hyp, ref in (("", "a cat"), ("a cat", ""), ("", "")):
        assert all(v == (0, 0, 0) for v in _scores(spark, hyp, ref).values())
