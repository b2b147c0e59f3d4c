"""Queries that must do their whole job: rows of their own, far beyond the samples and tiles of earlier forms."""

from pyspark.sql import functions as F


def written(spark, folder, **frames):
    for name, df in frames.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_clean_text_expands_the_contractions_of_its_phrases(spark, tmp_path):
    from reviewlens.plans import catalog
    catalog.load_all()
    docs = spark.createDataFrame([(i, f"Café {i}. End", "web", "en") for i in range(4)],
                                 "doc_id long, text string, source string, lang string")
    events = spark.createDataFrame([(1, 1, "view")], "event_id long, user_id long, event_type string")
    sf = written(spark, tmp_path, documents=docs, events=events)
    got = {r.doc_id: r for r in catalog.QUERIES["clean_text"](spark, sf).collect()}
    assert got[1].tail == " End I would say he is fine"
    assert all(len(got[i].tail) > len(" End ") and "n't" not in got[i].tail for i in got)
    assert all(r.clean_chars == len(f"Cafe {i}.") + len(r.tail) for i, r in got.items())


def test_quality_learns_from_every_label(spark, monkeypatch):
    import numpy as np
    from reviewlens.llm import quality
    monkeypatch.setattr(quality, "LABELLED", 20, raising=False)
    rows = [(i, ("fine words here " if i % 3 else "bad stuff there ") * 20 + f"row{i}") for i in range(21_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    target = np.zeros(quality.BUCKETS)
    data, offs = quality.tb.utf8(quality.pa.array([t for i, t in rows if i % 3]))
    target += np.bincount(quality._cells(data, offs)[0], minlength=quality.BUCKETS)
    raw = target + np.bincount(quality._cells(*quality.tb.utf8(quality.pa.array([t for i, t in rows if not i % 3])))[0],
                               minlength=quality.BUCKETS)
    want = np.log((target + 1) / (target.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    assert np.allclose(model["ratio"], want)


def test_threshold_is_the_best_cut(spark):
    import numpy as np
    from reviewlens.llm import quality
    rng = np.random.default_rng(4)
    rows = [(bool(g), float(round(rng.normal(g), 1))) for g in rng.integers(0, 2, 300)]
    values = sorted({s for _, s in rows})
    good, bad = ([sum(1 for g, s in rows if g == k and s <= v) for v in values] for k in (True, False))
    gain = np.array(bad) / bad[-1] - np.array(good) / good[-1]
    i = int(np.argmax(gain))
    got = quality._threshold(spark.createDataFrame(rows, "good boolean, score double"))
    assert got == (values[i] + values[min(i + 1, len(values) - 1)]) / 2
    assert quality._threshold(spark.createDataFrame(rows, "good boolean, score double").filter("good")) == float("-inf")


def _vectors(spark, n=90, seed=5):
    import numpy as np
    rng = np.random.default_rng(seed)
    rows = [(int(i % 3), i, rng.normal(size=6).tolist()) for i in range(n)]
    rows += [(0, 900, [0.0] * 6), (1, 901, None), (2, 902, rows[2][2]), (2, 903, rows[2][2]), (7, 950, rows[0][2])]
    return spark.createDataFrame(rows, "label long, vec_id long, vec array<double>")


def test_cosine_statistics_equal_those_of_single_pairs(spark, monkeypatch):
    from reviewlens.functions import vectors as V
    from reviewlens.operators import diagnostics as D
    monkeypatch.setattr(D, "BLOCK", 7)
    monkeypatch.setattr(D, "AT_ONCE", 16)
    monkeypatch.setattr(D, "pair_scores", lambda *a: 1 / 0)  # no table of pairs
    df = _vectors(spark)
    got = D.pair_score_stats(df, "label", "vec_id", "vec").orderBy("label").collect()
    low = D.pair_score_examples(df, "label", "vec_id", "vec", bins=16).orderBy("label", "zone", "rank", "a", "b").collect()
    monkeypatch.undo()
    plain = lambda a, b: V.cosine(a, b)
    want = D.pair_score_stats(df, "label", "vec_id", "vec", plain).orderBy("label").collect()
    assert len(got) == len(want) == 4
    for g, w in zip(got, want):
        for k, x in w.asDict().items():
            assert g[k] == x if not isinstance(x, float) else abs(g[k] - x) < 1e-9, (k, g, w)
    high = D.pair_score_examples(df, "label", "vec_id", "vec", plain, bins=16).orderBy("label", "zone", "rank", "a", "b").collect()
    assert low and [r[:5] for r in low] == [r[:5] for r in high]


def test_dbscan_needs_no_table_of_pairs(spark, monkeypatch):
    import numpy as np
    from reviewlens.operators import clustering as C
    rng = np.random.default_rng(8)
    rows = [(f"g{i % 2}", i, (rng.uniform(size=2) * 5).tolist()) for i in range(120)]
    pts = spark.createDataFrame(rows, "grp string, id long, vec array<double>")
    params = spark.createDataFrame([("g0", 0.55, 3), ("g1", 0.5, 2)], "grp string, eps double, min_samples int")
    pairs = C.cut_lineage(C.neighbour_pairs(pts, params, ["grp"], "id", tile_rows=9))
    want = sorted(C.dbscan(pts, params, ["grp"], "id", pairs=pairs).collect())
    monkeypatch.setattr(C, "neighbour_pairs", lambda *a: 1 / 0)
    monkeypatch.setattr(C, "AT_ONCE", 32)
    got = sorted(C.dbscan(pts, params, ["grp"], "id", tile_rows=9).collect())
    assert got == want
    assert len({r.label for r in got}) > 3


def test_similar_words_put_out_n_best_once_a_group(spark):
    import numpy as np
    from reviewlens.operators import soft_cosine as SC
    rng = np.random.default_rng(3)
    batches, held = [], 0
    v = rng.normal(size=(300, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    for side in (0, 1):
        for at in range(0, 300, 50):
            ids = np.arange(at, at + 50)
            batches.append(SC.pa.RecordBatch.from_arrays(
                [SC.pa.array(np.zeros(50, int)), SC.pa.array(np.zeros(50, int)), SC.pa.array(np.full(50, side)), SC.pa.array(ids),
                 SC.pa.array(v[ids].tolist())], ["i", "g", "side", "id", "v"]))
    got = SC.pa.Table.from_batches(list(SC._best_of_blocks(5, 0.0)(batches))).to_pandas()
    cos = np.round(v @ v.T, 9)
    np.fill_diagonal(cos, -2)
    want = {(a, b) for a in range(300) for b in sorted(range(300), key=lambda b: (-cos[a, b], b))[:5] if cos[a, b] >= 0}
    assert len(got) == len(want) and set(zip(got.a, got.b)) == want
