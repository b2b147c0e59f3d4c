"""The variational mixture: bound, statistics and recovered components."""

import numpy as np
import pytest

from reviewlens.operators import mixture as X
from reviewlens.operators import models as M


def data(n=600, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [8, 0, 1], [0, 9, -3]], float)
    at = rng.integers(0, 3, n)
    return centres[at] + rng.normal(size=(n, 3)) * [1, .5, .8], at, centres


def test_digamma():
    assert X.digamma(np.array([1.0])) == pytest.approx(-0.5772156649015329)
    assert X.digamma(np.array([.5])) == pytest.approx(-1.9635100260214235)


def test_finds_components_and_the_bound_rises(spark):
    x, at, centres = data()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<double>").repartition(5)
    df = M.kmeans_labels(df, "vec", 6).withColumnRenamed("label", "start")
    bounds = []
    model = X.fit(df, "vec", 6, start="start", alpha=.01, max_iter=40, tol=1e-7, bounds=bounds)
    assert len(bounds) > 3 and all(b - a > -1e-6 * abs(a) for a, b in zip(bounds, bounds[1:]))
    strong = np.flatnonzero(model.weights > .05)
    assert len(strong) == 3 and model.weights[strong].sum() > .97
    for c in centres:
        assert np.abs(model.mean[strong] - c).max(1).min() < .3
    rows = X.assign(df, "vec", model, "vec_id").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.label, []).append(at[r.vec_id])
    assert sum(max(g.count(k) for k in range(3)) for g in map(list, groups.values())) > .98 * len(x)
    comps = X.components(spark, model).collect()
    assert sum(r.weight for r in comps) == pytest.approx(1) and {len(r.mean) for r in comps} == {3}


def test_statistics_are_sums_over_all_tasks(spark):
    x, _, _ = data(100)
    parts = [x[i::9] for i in range(9)]
    r = [np.eye(2)[np.arange(len(p)) % 2] for p in parts]
    rows = [(i, k, X._sums(p, q, None)[k].tolist()) for i, (p, q) in enumerate(zip(parts, r)) for k in range(2)]
    got = X.add_up(spark.createDataFrame(rows, X._STATS), fan_in=2).collect()
    want = sum(X._sums(p, q, None) for p, q in zip(parts, r))
    assert len(got) == 2
    for row in got:
        assert np.allclose(row.stats, want[row.label])


def test_one_component_is_the_normal_posterior(spark):
    x, _, _ = data(50)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>")
    model = X.fit(df, "vec", 1, max_iter=2)
    assert np.allclose(model.mean[0], x.mean(0)) and model.nu[0] == 53
    cov = np.cov(x.T, bias=True)
    assert np.allclose(model.scale[0], cov * 51, rtol=1e-4, atol=1e-4)
    with pytest.raises(ValueError):
        X.fit(df.limit(0), "vec", 2)
