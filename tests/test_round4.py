"""Round 4: whole results and searches that scale, against brute force on rows of their own."""

import math

from pyspark.sql import functions as F

from reviewlens.plans import queries_search as QS


def test_encoded_sentences_come_with_their_vectors(spark, tmp_path):
    long = "the quick brown fox jumps over the lazy dog {}"
    docs = [(0, f"{long.format('again')}.{long.format('twice twice')}", "en", "s"), (1, long.format("alone"), None, "s"),
            (2, None, "en", "s"), (3, "short. text", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i, "view") for i in range(4)], "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    rows = QS.q_encode_sentences(spark, str(tmp_path)).collect()
    assert sorted((r.grp or "", r.sidx) for r in rows) == [("", 0), ("s-en", 0), ("s-en", 1)]
    assert all(r.dims == len(r.vec) == 300 for r in rows)
    assert all(math.isclose(math.sqrt(sum(x * x for x in r.vec)), r.norm, abs_tol=1e-6) for r in rows)
    assert len({tuple(r.vec) for r in rows}) == 3  # other words, other vectors
    kept = QS.candidate_sentences(spark, str(tmp_path)).select("grp", "sidx").collect()
    assert sorted(map(tuple, kept)) == [("s-en", 0), ("s-en", 1)]


def test_nearest_words_skip_runs_that_cannot_hold_one(spark):
    import numpy as np
    from reviewlens.operators import soft_cosine as SC
    rng = np.random.default_rng(5)
    n, n_best = 6000, 5
    v = rng.normal(size=(n, 3))
    v[1000:1040] = v[1000]  # equal vectors: the smallest numbers are kept
    v /= np.linalg.norm(v, axis=1)[:, None]
    order = np.lexsort((v[:, 0] > 0, v[:, 1] > 0, v[:, 2] // .1))
    best, met, plain = SC._Best((0, 0), n_best, 0.5), [0], SC._Best._pass

    def counted(self, ids, part, rows):
        met[0] += len(rows) * len(ids)
        plain(self, ids, part, rows)

    SC._Best._pass = counted
    try:
        best.own(order, v[order])
        best.others(order, v[order])
        got = best.rows().to_pandas()
    finally:
        SC._Best._pass = plain
    assert met[0] < n * n / 3
    cos = np.round(np.stack([(x * v).sum(1) for x in v]), 9)
    np.fill_diagonal(cos, -2)
    want = {(a, b) for a in range(n) for b in np.lexsort((np.arange(n), -cos[a]))[:n_best] if cos[a, b] >= 0.5}
    assert set(zip(got.a, got.b)) == want and len(got) == len(want)
    assert set(got[got["last"]].groupby("a").size()) == {1}


def test_a_bag_looks_up_stop_words_in_a_set(spark, capsys):
    from reviewlens.operators import soft_cosine as SC
    df = spark.createDataFrame([(1, "the cat The  cat"), (2, "the"), (3, None)], "doc long, text string")
    bag = SC.bags(df, "text", ["doc"])
    assert sorted(map(tuple, bag.collect())) == [(1, "The", 1), (1, "cat", 2)]
    bag.explain()
    assert "INSET" in capsys.readouterr().out


def test_a_block_of_topics_is_gathered_and_spread_without_python_words():
    import numpy as np
    import pyarrow as pa
    from reviewlens.operators import topics as P
    rows = pa.table({"label": [1] * 5, "block": [0] * 5, "doc": [9, 7, 9, 7, 8], "word": ["b", "z", "a", "a", "b"],
                     "n": [1, 2, 3, 4, 5], "p0": [.1, .2, .3, .4, .5]})
    got = P._gather(2)(rows)
    one = got.to_pylist()[0]
    assert (one["label"], one["block"], one["docs"], one["words"]) == (1, 0, [7, 8, 9], ["a", "z", "b"])
    assert (one["doc_of"], one["word_of"], one["n"], one["p"]) == ([0, 0, 1, 2, 2], [0, 1, 2, 0, 2], [4, 2, 5, 3, 1], [.4, .2, .5, .3, .1])
    back = P._spread(2)(got).to_pandas()
    assert sorted(zip(back.doc, back.word, back.n, back.p0)) == sorted(zip(*(rows.column(c).to_pylist() for c in ("doc", "word", "n", "p0"))))
    assert np.allclose(back.p0 + back.p1, 1)
