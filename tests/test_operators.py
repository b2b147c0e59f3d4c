"""Operator checks against brute force on the small fixture, and guards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import clustering as C
from reviewlens.operators import training_set as TS
from reviewlens.plans.queries_vectors import vectors
from reviewlens.sources.tables import reviews

SF001 = "/root/testdata/sf0.001"


def _dbscan_numpy(ids, X, eps, ms):
    """The pinned rule, by brute force: cores, components by BFS over core-core
    links, numbered by smallest core id, border -> lowest neighbouring cluster."""
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    nb = d <= eps
    core = nb.sum(1) >= ms
    comp = -np.ones(len(ids), dtype=int)
    order = np.argsort(ids)
    roots = []
    for s in order:
        if not core[s] or comp[s] >= 0:
            continue
        stack, comp[s] = [s], len(roots)
        while stack:
            u = stack.pop()
            for w in np.nonzero(nb[u] & core)[0]:
                if comp[w] < 0:
                    comp[w] = comp[s]
                    stack.append(w)
        roots.append(s)
    label = comp.copy()
    for p in np.nonzero(~core)[0]:
        cl = comp[nb[p] & core]
        label[p] = cl.min() if len(cl) else -1
    return dict(zip(ids.tolist(), label.tolist())), dict(zip(ids.tolist(), core.tolist()))


def _whole_table(spark, eps, ms):
    """All vectors as one group, and its parameters."""
    v = vectors(spark, SF001).withColumn("grp", F.lit("all"))
    return v, spark.createDataFrame([("all", eps, ms)], "grp string, eps double, min_samples int")


@pytest.mark.parametrize("eps,ms,tile", [(1.15, 3, 4096), (1.10, 2, 16), (1e-6, 2, 16)])
def test_dbscan_matches_brute_force(spark, eps, ms, tile):
    v, params = _whole_table(spark, eps, ms)
    got = {r.vec_id: (r.label, r.is_core)
           for r in C.dbscan(v, params, ["grp"], "vec_id", tile_rows=tile).collect()}
    rows = v.select("vec_id", "vec").collect()
    ids = np.array([r.vec_id for r in rows])
    X = np.array([r.vec for r in rows], dtype=float)
    want_label, want_core = _dbscan_numpy(ids, X, eps, ms)
    assert {k: v[0] for k, v in got.items()} == want_label
    assert {k: v[1] for k, v in got.items()} == want_core


def test_blocks_are_bounded_and_pruned(spark):
    """No block is larger than the tile in one hot group on a line, and far blocks don't meet."""
    pts = spark.range(1000).select(F.lit("hot").alias("grp"), "id",
                                   F.array(F.col("id").cast("double"), F.lit(0.0)).alias("v"))
    params = spark.createDataFrame([("hot", 2.0)], "grp string, eps double")
    placed = C.blocks(pts, ["grp"], 50)
    assert max(r["count"] for r in placed.groupBy("block").count().collect()) == 50
    pairs = {(r.i, r.j) for r in C.block_pairs(placed, params, ["grp"]).collect()}
    assert pairs == {(i, j) for i in range(20) for j in (i, i + 1) if j < 20}
    found = C.neighbour_pairs(pts, params, ["grp"], "id", "v", tile_rows=50)
    assert {(r.a, r.b) for r in found.collect()} == {
        (i, i + d) for i in range(1000) for d in (1, 2) if i + d < 1000}


def test_autotune_returns_the_parameters_of_its_labels(spark):
    v = vectors(spark, SF001).withColumn("grp", F.pmod("vec_id", F.lit(3)).cast("string"))
    labels, params = C.autotune(v, ["grp"], "vec_id", eps=1.0, min_samples=3, min_clusters=5, max_clusters=8, max_iterations=3)
    got = {(r.grp, r.vec_id): r.label for r in labels.collect()}
    used = {r.grp: r for r in params.collect()}
    assert set(used) == {"0", "1", "2"}
    rows = v.collect()
    for grp, p in used.items():
        own = [r for r in rows if r.grp == grp]
        ids, X = np.array([r.vec_id for r in own]), np.array([r.vec for r in own])
        eps, ms, n, i = 1.0, 3, 0, 0
        while n < 5 - i or n > 8:
            i += 1
            last = eps, ms
            want, _ = _dbscan_numpy(ids, X, eps, ms)
            seen = list(want.values())
            if n < 5 and max(sorted(set(seen)), key=seen.count) == -1:
                ms, eps = max(2, ms - 1), eps / 0.85
            elif n < 5:
                eps *= 0.6
            else:
                ms, eps = ms + 1, eps * 0.85
            n = len(set(seen)) - 1
            if i == 3:
                break
        assert (p.eps, p.min_samples, p.num_clusters, p.iteration) == (pytest.approx(last[0]), last[1], n, i)
        assert {k: got[grp, k] for k in want} == want


def test_mk2_class_guard(spark):
    # .5 / .8 bands at sf0.01: 48 unhelpful vs 16 helpful rows -> the guard fails
    with pytest.raises(ValueError, match="class guard"):
        TS.make_dataset_mk2(reviews(spark, "/root/testdata/sf0.01"), bad_ratio=.5, good_ratio=.8)


def test_group_rank_and_dense_index_are_stable(spark):
    """Distributed ranks equal a window row_number, on every re-evaluation."""
    from pyspark.sql import Window

    from reviewlens.operators import votes
    from reviewlens.operators.common import dense_index, group_rank
    from reviewlens.operators.text_ops import dot_sentences
    r = reviews(spark, "/root/testdata/sf0.01")
    s = dot_sentences(votes.positive_product_reviews(r).select("asin", "doc_id", "review_text"),
                      "review_text", ["asin", "doc_id"], min_chars=30)
    g = group_rank(s, ["asin"], ["doc_id", "pos"], name="sidx")
    d = dense_index(s, ["asin", "doc_id", "pos"], name="gidx")
    w = s.withColumn("sidx2", F.row_number().over(Window.partitionBy("asin").orderBy("doc_id", "pos")) - 1) \
        .withColumn("gidx2", F.row_number().over(Window.orderBy("asin", "doc_id", "pos")) - 1)
    j = g.join(d.select("asin", "doc_id", "pos", "gidx"), ["asin", "doc_id", "pos"]) \
        .join(w.select("asin", "doc_id", "pos", "sidx2", "gidx2"), ["asin", "doc_id", "pos"])
    for _ in range(2):
        assert j.filter("sidx <> sidx2 OR gidx <> gidx2").count() == 0
    assert j.count() == s.count()


def test_review_dicts_keep_every_text(spark, tmp_path):
    """Quotes, None, escapes and line ends come back; a bad line stops the read or is kept."""
    from reviewlens.sources import formats as FM
    texts = ["it's \"so\" 'so'", "None True \\x41 \\ \\'", "a\nb\r\n\tc\x07\xe9\u2028\U0001f600", "", None]
    rows = [("0005019281", i, [i, 2], 1.0, t, None) for i, t in enumerate(texts)]
    schema = "asin STRING, doc_id BIGINT, helpful ARRAY<BIGINT>, overall DOUBLE, reviewText STRING, reviewerName STRING"
    FM.write_review_dicts(spark.createDataFrame(rows, schema), str(tmp_path / "a"))
    back = FM.read_review_dicts(spark, str(tmp_path / "a"), schema)
    assert sorted((tuple(r) for r in back.collect()), key=lambda r: r[1]) == rows
    (tmp_path / "b").write_text("{'asin': 'x', 'reviewerName': None, 'reviewText': '\\xe9'}\n\n{'asin': oops()}\n")
    kept = {r.asin: r for r in FM.read_review_dicts(spark, str(tmp_path / "b"), mode="PERMISSIVE").collect()}
    assert kept["x"].reviewText == "\xe9" and kept[None]._corrupt_record == "{'asin': oops()}"
    with pytest.raises(Exception, match="not a review record"):
        FM.read_review_dicts(spark, str(tmp_path / "b")).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 12])
def test_pair_score_examples_on_ties_and_small_clusters(spark, n):
    """Equal vectors: all scores tie, so ids decide; ranks outside a small cluster are left out."""
    from itertools import combinations

    from reviewlens.operators import diagnostics as D
    df = spark.range(n).select(F.lit(0).alias("label"), "id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    pairs = list(combinations(range(n), 2))
    m = len(pairs)
    want = {("low", 1)} | {("mid", r) for r in (m // 2 - 1, m // 2, m // 2 + 1)} | {("high", m - 2)}
    want = {(z, r, *pairs[r]) for z, r in want if 0 <= r < m}
    got = D.pair_score_examples(df, "label", "id", "v", tile_rows=4).collect()
    assert sorted((r.zone, r["rank"], r.a, r.b) for r in got) == sorted(want)


def test_running_total_over_any_partitions(spark):
    from reviewlens.operators.common import running_total
    rows = [(k * 7 % 101, k % 4) for k in range(101)]
    df = spark.createDataFrame(rows, "k long, n int").repartition(6)
    for parts in (1, 5, 40):
        got = {r.k: r.before for r in running_total(df, "k", "n", "before", parts).collect()}
        total = 0
        for k, n in sorted(rows):
            assert got[k] == total
            total += n


def test_numbered_sentences(spark):
    from reviewlens.operators.text_ops import numbered_sentences
    docs = spark.createDataFrame([(5, "long enough one. no. long enough two"), (1, "long enough three."), (3, "no"), (4, ""), (2, None)],
                                 "doc_id long, text string")
    got = [tuple(r) for r in numbered_sentences(docs, "text", "doc_id", 8).orderBy("sentence_id").collect()]
    assert got == [(1, 0, "long enough three", 0), (5, 0, "long enough one", 1), (5, 2, "long enough two", 2)]


def test_index_maps_and_a_missing_index(spark):
    from reviewlens.operators import text_ops as X
    from reviewlens.operators.common import new_path
    r = spark.createDataFrame([("p", 4, "first sentence. x"), ("p", 2, "short"), ("q", 9, "second sentence here. third sentence")],
                              "asin string, doc_id long, review_text string")
    base = new_path(spark, "maps")
    X.write_index_maps(r, "asin", "doc_id", "review_text", base, min_chars=8)
    prod, sents = X.read_index_maps(spark, base, "asin STRING, place BIGINT, idx BIGINT")
    assert sorted(map(tuple, prod.collect())) == [("p", 0, 2), ("p", 1, 4), ("q", 0, 9)]
    got = sorted(map(tuple, X.sentences_of_products(prod, sents, "asin").collect()))
    assert got == [("p", 1, 4, 0, "first sentence"), ("q", 0, 9, 0, "second sentence here"), ("q", 0, 9, 1, "third sentence")]
    with pytest.raises(Exception, match="no sentences for review 4"):
        X.sentences_of_products(prod, sents.filter("idx <> 4"), "asin").collect()


def test_training_csv_keeps_texts(spark):
    from reviewlens.operators.common import new_path
    from reviewlens.operators.training_set import write_training_csv
    from reviewlens.sources.formats import read_csv
    texts = ["  a b  ", 'say "x", then\nnext', "é, ,"]
    df = spark.createDataFrame([(t, i / 4, "train" if i else "val") for i, t in enumerate(texts)], "review_text string, label double, split string")
    path = new_path(spark, "csv")
    write_training_csv(df, path)
    back = {r.reviewText: r.label for s in ("train", "val") for r in read_csv(spark, f"{path}_{s}", "reviewText STRING, label DOUBLE").collect()}
    assert back == {t: i / 4 for i, t in enumerate(texts)}


def test_mean_cosine_without_pairs(spark):
    from reviewlens.functions import vectors as V
    from reviewlens.operators import diagnostics as D
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 3), (rng.normal(size=4) * (1 + i)).tolist()) for i in range(30)] + [(90, 0, [0.0] * 4), (91, 7, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, label long, vec array<double>")
    means = {r.label: r.avg_score for r in D.cosine_means(df, "label", "vec").collect()}
    assert set(means) == {0, 1, 2}
    one = D.pair_score_stats(df, "label", "vec_id", "vec", V.cosine).orderBy("label").collect()
    two = D.pair_score_stats(df, "label", "vec_id", "vec", V.cosine, means=D.cosine_means(df, "label", "vec")).orderBy("label").collect()
    for x, y in zip(one, two):
        assert x.label == y.label and x.near_avg_a == y.near_avg_a and x.near_avg_b == y.near_avg_b
        assert (x.avg_score is None) == (x.label == 7) and (x.avg_score is None or abs(means[x.label] - x.avg_score) < 1e-12)
