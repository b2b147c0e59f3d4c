"""Registered DBSCAN queries (J4, M1, M2, M3, A6, A7) over ``embeddings``.

Each product is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.operators import clustering as C
from reviewlens.plans.catalog import register
from reviewlens.plans.queries_vectors import E_SQL, vectors

EPS, MIN_SAMPLES = 1.3, 3
# The eps sweep of the original notebook, min_samples 5.
SWEEP = (0.75, 0.80, 0.85, 0.9, 0.95, 1.0, 1.1)


def dbscan_sql(values: tuple[float, ...], min_samples: int) -> str:
    """``labels``: sweep, grp, vec_id, label, is_core for each eps and product."""
    sweep = ", ".join(f"({i}, {eps}::DOUBLE)" for i, eps in enumerate(values))
    return f"""
WITH RECURSIVE sweep(sweep, eps) AS (VALUES {sweep}),
e AS (SELECT sweep, eps, grp, vec_id, vec AS v FROM {E_SQL} x, sweep),
pairs AS (SELECT a.sweep, a.grp, a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b
          ON a.sweep = b.sweep AND a.grp = b.grp AND a.vec_id <> b.vec_id AND list_distance(a.v, b.v) <= a.eps),
core AS (SELECT e.sweep, e.grp, e.vec_id AS id FROM e
         LEFT JOIN pairs p ON p.sweep = e.sweep AND p.grp = e.grp AND p.a = e.vec_id
         GROUP BY e.sweep, e.grp, e.vec_id HAVING 1 + count(p.b) >= {min_samples}),
cce AS (SELECT p.* FROM pairs p JOIN core x ON x.sweep = p.sweep AND x.grp = p.grp AND x.id = p.a
        JOIN core y ON y.sweep = p.sweep AND y.grp = p.grp AND y.id = p.b),
reach(sweep, grp, id, root) AS (
  SELECT sweep, grp, id, id FROM core
  UNION SELECT c.sweep, c.grp, c.b, r.root FROM reach r
        JOIN cce c ON c.sweep = r.sweep AND c.grp = r.grp AND c.a = r.id),
comp AS (SELECT sweep, grp, id, min(root) AS root FROM reach GROUP BY sweep, grp, id),
num AS (SELECT sweep, grp, id, dense_rank() OVER (PARTITION BY sweep, grp ORDER BY root) - 1 AS cl FROM comp),
border AS (SELECT p.sweep, p.grp, p.a AS id, min(n.cl) AS cl FROM pairs p
           JOIN num n ON n.sweep = p.sweep AND n.grp = p.grp AND n.id = p.b GROUP BY p.sweep, p.grp, p.a),
labels AS (SELECT e.sweep, e.eps, e.grp, e.vec_id,
                  CAST(coalesce(num.cl, border.cl, -1) AS BIGINT) AS label, num.cl IS NOT NULL AS is_core
           FROM e LEFT JOIN num ON num.sweep = e.sweep AND num.grp = e.grp AND num.id = e.vec_id
           LEFT JOIN border ON border.sweep = e.sweep AND border.grp = e.grp AND border.id = e.vec_id),
per AS (SELECT sweep, eps, grp, label, count(*) AS n FROM labels GROUP BY sweep, eps, grp, label),
summary AS (
  SELECT sweep, grp, eps, count(*) - 1 AS n_clusters_minus_one, count(*) FILTER (WHERE label >= 0) AS n_clusters,
         CAST(coalesce(sum(n) FILTER (WHERE label = -1), 0) AS BIGINT) AS n_noise,
         first(label ORDER BY n DESC, label) = -1 AS noise_is_mode
  FROM per GROUP BY sweep, grp, eps)
"""


DBSCAN_SQL = dbscan_sql((EPS,), MIN_SAMPLES)


def _dbscan_fixed(spark, sf_dir, eps: float = EPS):
    v = vectors(spark, sf_dir)
    params = v.select("grp").distinct().select(
        "grp", F.lit(eps).alias("eps"), F.lit(MIN_SAMPLES).alias("min_samples"))
    return C.dbscan(v, params, ["grp"], "vec_id", "vec")


@register("dbscan_fixed", DBSCAN_SQL + "SELECT grp, vec_id, label, is_core FROM labels")
def q_dbscan_fixed(spark, sf_dir):
    return _dbscan_fixed(spark, sf_dir).select("grp", "vec_id", "label", "is_core")


@register("dbscan_summary", DBSCAN_SQL + "SELECT * EXCLUDE (sweep, eps) FROM summary")
def q_dbscan_summary(spark, sf_dir):
    return C.cluster_summary(_dbscan_fixed(spark, sf_dir), ["grp"])


@register("dbscan_sweep", dbscan_sql(SWEEP, 5) + """
SELECT sweep::BIGINT AS sweep, grp, eps, n_clusters_minus_one, n_clusters, n_noise, noise_is_mode FROM summary
""")
def q_dbscan_sweep(spark, sf_dir):
    """M3: one DBSCAN per eps value of the sweep, all in the same jobs (the
    sweep index is part of the group key)."""
    # every point once per sweep value (7 fixed values: bounded replication)
    pts = vectors(spark, sf_dir).withColumn(
        "sweep", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(len(SWEEP))])))
    eps = F.element_at(F.array(*[F.lit(e) for e in SWEEP]), (F.col("sweep") + 1).cast("int"))
    params = pts.select("sweep", "grp").distinct().select(
        "sweep", "grp", eps.alias("eps"), F.lit(5).alias("min_samples"))
    labels = C.dbscan(pts, params, ["sweep", "grp"], "vec_id", "vec")
    return C.cluster_summary(labels, ["sweep", "grp"]).join(
        params.select("sweep", "grp", "eps"), ["sweep", "grp"])


@register("dbscan_autotune")
def q_dbscan_autotune(spark, sf_dir):
    """M2: self-tuning DBSCAN (target 5..40 clusters) starting at eps 1.0, ms 2."""
    v = vectors(spark, sf_dir)
    labels, params = C.autotune(v, ["grp"], "vec_id", eps=1.0, min_samples=2,
                                min_clusters=5, max_clusters=40)
    return labels.join(params, "grp").select("grp", "vec_id", "label", "is_core", "eps",
                                             "min_samples", "num_clusters", "iteration")
