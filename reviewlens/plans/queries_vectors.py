"""Registered vector / cluster queries over ``embeddings`` (A4, A5, A8, A9, A12,
J2, J3, J5, J9, J10, M13, M14, R7, U3, U5, W2-W5, F11, F12, F21).

A vector belongs to the product of the document with its id (modulo the number of
documents).  Second labeling for drift: ``vec_id % 7``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.functions import vectors as V
from reviewlens.functions.hashing import sql_hash32
from reviewlens.operators import diagnostics as D
from reviewlens.operators import vectors_ops as VO
from reviewlens.operators.text_ops import numbered_sentences
from reviewlens.plans.catalog import normalise, register
from reviewlens.sources.tables import table


def vectors(spark, sf_dir):
    """grp (product), vec_id, vec, label."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang")
    n = docs.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("_n"))
    product = docs.select("doc_id", F.concat("source", F.lit("-"), "lang").alias("grp"))
    return (e.join(F.broadcast(n))  # one row
            .withColumn("doc_id", F.col("vec_id") % F.col("_n")).join(product, "doc_id")
            .select("grp", "vec_id", F.col("embedding").cast("array<double>").alias("vec"),
                    F.col("label").cast("bigint").alias("label")))


E_SQL = """(SELECT d.source || '-' || d.lang AS grp, vec_id, embedding::DOUBLE[] AS vec, label::BIGINT AS label
 FROM embeddings JOIN documents d ON d.doc_id = vec_id % (SELECT count(*) FROM documents))"""
CENT_SQL = f"""
cd AS (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM {E_SQL} e),
cent AS (SELECT label, list(x ORDER BY dim) AS centroid
         FROM (SELECT label, dim, avg(x) AS x FROM cd GROUP BY label, dim) GROUP BY label),
dist AS (SELECT e.label, e.vec_id, list_distance(e.vec, c.centroid) AS dist
         FROM {E_SQL} e JOIN cent c USING (label))
"""


# the centres of each product's clusters, and all pairs of a product's vectors and centres
PRODUCT_SQL = f"""
pd AS (SELECT grp, label, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM {E_SQL} e),
pc AS (SELECT grp, label, list(x ORDER BY dim) AS centroid
       FROM (SELECT grp, label, dim, avg(x) AS x FROM pd GROUP BY grp, label, dim) GROUP BY grp, label),
s AS (SELECT c.grp, c.label AS centre, e.vec_id, list_cosine_similarity(e.vec, c.centroid) AS sim
      FROM {E_SQL} e JOIN pc c USING (grp))
"""


@register("cluster_centroids", f"""
SELECT label, CAST(dim - 1 AS BIGINT) AS dim, round(avg(x), 6) AS value, count(*) AS size
FROM (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM {E_SQL} e)
GROUP BY label, dim
""")
def q_cluster_centroids(spark, sf_dir):
    c = VO.centroids(vectors(spark, sf_dir), ["label"], "vec")
    return normalise(c.select("label", F.posexplode("centroid").alias("dim", "value"), "size")
                     .withColumn("dim", F.col("dim").cast("bigint")))


@register("cluster_sizes_weights", f"""
SELECT grp, label, count(*) AS size, round(count(*) / sum(count(*)) OVER (PARTITION BY grp), 6) AS weight,
       CAST(row_number() OVER (PARTITION BY grp ORDER BY label) - 1 AS BIGINT) AS label_order
FROM {E_SQL} e GROUP BY grp, label
""")
def q_cluster_sizes_weights(spark, sf_dir):
    s = VO.cluster_sizes(vectors(spark, sf_dir), ["grp", "label"])
    # Distinct labels in sorted order (a window over the label list only)
    from pyspark.sql import Window
    s = s.withColumn("label_order",
                     (F.row_number().over(Window.partitionBy("grp").orderBy("label")) - 1)
                     .cast("bigint"))
    return normalise(s.select("grp", "label", "size", "weight", "label_order"))


@register("cosine_to_centres", f"""
WITH {PRODUCT_SQL.strip()}
SELECT grp, centre, vec_id, round(sim, 6) AS sim FROM s
""")
def q_cosine_to_centres(spark, sf_dir):
    v = vectors(spark, sf_dir)
    cents = VO.centroids(v, ["grp", "label"], "vec").withColumnRenamed("label", "centre")
    s = VO.similarity_to_centres(v, cents, "grp", "vec_id", "vec")
    return normalise(s.select("grp", "centre", "vec_id", "sim"))


@register("nearest_sentence_per_centre", f"""
WITH {PRODUCT_SQL.strip()}
SELECT grp, centre, first(vec_id ORDER BY round(sim, 9) DESC, vec_id) AS vec_id, round(max(sim), 6) AS sim
FROM s GROUP BY grp, centre
""")
def q_nearest_sentence_per_centre(spark, sf_dir):
    v = vectors(spark, sf_dir)
    cents = VO.centroids(v, ["grp", "label"], "vec").withColumnRenamed("label", "centre")
    s = VO.similarity_to_centres(v, cents, "grp", "vec_id", "vec")
    return normalise(VO.nearest_per_centre(s, "grp", "centre", "vec_id")
                     .select("grp", "centre", "vec_id", "sim"))


@register("nearest_members", f"""
WITH {CENT_SQL.strip()}
SELECT label, vec_id, round(dist, 6) AS dist, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS BIGINT) AS rank
  FROM dist) WHERE rank <= 3
""")
def q_nearest_members(spark, sf_dir):
    n = VO.nearest_members(vectors(spark, sf_dir), ["label"], "vec_id", 3, "vec")
    return normalise(n.select("label", "vec_id", "dist", "rank"))


@register("near_mid_far", f"""
WITH {CENT_SQL.strip()},
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) - 1 AS BIGINT) AS rank,
             count(*) OVER (PARTITION BY label) AS n FROM dist)
SELECT label, vec_id, round(dist, 6) AS dist, rank, n, zone FROM (
  SELECT *, 'near' AS zone FROM r WHERE rank < 3
  UNION ALL SELECT *, 'mid' FROM r WHERE rank >= n // 2 - 1 AND rank < n // 2 + 2
  UNION ALL SELECT *, 'far' FROM r WHERE rank >= n - 3)
""")
def q_near_mid_far(spark, sf_dir):
    z = VO.near_mid_far(vectors(spark, sf_dir), ["label"], "vec_id", 3, "vec")
    return normalise(z.select("label", "vec_id", "dist", "rank", "n", "zone"))


@register("cluster_report", f"""
WITH {CENT_SQL.strip()},
near AS (SELECT label, vec_id, 'near' AS kind,
                CAST(row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS BIGINT) AS rank
         FROM dist QUALIFY rank <= 3),
rest AS (SELECT label, vec_id FROM {E_SQL} e
         WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.label = e.label AND n.vec_id = e.vec_id))
SELECT * FROM near
UNION ALL
SELECT label, vec_id, 'random' AS kind, rank FROM (
  SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label
         ORDER BY {sql_hash32("'7'", 'vec_id')}, vec_id) AS BIGINT) AS rank FROM rest)
WHERE rank <= 2
""")
def q_cluster_report(spark, sf_dir):
    r = VO.cluster_report(vectors(spark, sf_dir), ["label"], "vec_id", 3, 2, seed=7, vec="vec")
    return r.select("label", "vec_id", "kind", "rank")


@register("candidate_sample", f"""
WITH {PRODUCT_SQL.strip()},
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp, centre ORDER BY round(sim, 9) DESC, vec_id) AS BIGINT) AS rank
      FROM s)
SELECT grp, centre, vec_id, round(sim, 6) AS sim, rank
FROM r JOIN (SELECT grp, count(*) AS n FROM pc GROUP BY grp) USING (grp) WHERE rank <= ceil(25 / n)
""")
def q_candidate_sample(spark, sf_dir):
    v = vectors(spark, sf_dir)
    c = VO.candidate_sample(v, v, "grp", "vec_id", 25, "vec")
    return normalise(c.select("grp", "centre", "vec_id", "sim", "rank"))


@register("cluster_drift", """
WITH j AS (SELECT vec_id, label::BIGINT AS l1, vec_id % 7 AS l2 FROM embeddings),
p AS (SELECT l1, l2, count(*) AS c, min(vec_id) AS first FROM j GROUP BY l1, l2)
SELECT l1, min(first) AS first_member, CAST(sum(c) AS BIGINT) AS size,
       count(*) AS n_other_clusters, max(c) AS largest_overlap,
       round(max(c) / sum(c), 6) AS ratio
FROM p GROUP BY l1
""")
def q_cluster_drift(spark, sf_dir):
    v = vectors(spark, sf_dir)
    b = v.select("vec_id", (F.col("vec_id") % 7).alias("label"))
    return normalise(VO.cluster_drift(v, b, "vec_id"))


@register("encoder_shift", f"""
SELECT vec_id, round(list_distance(vec, list_reverse(vec)), 6) AS l2,
       round(list_cosine_similarity(vec, list_reverse(vec)), 6) AS cosine
FROM {E_SQL} e
""")
def q_encoder_shift(spark, sf_dir):
    """The same rows under two encoders (the second is a fixed re-ordering
    of the first's output, standing in for another model)."""
    v = vectors(spark, sf_dir)
    other = v.select("vec_id", F.reverse("vec").alias("vec2"))
    j = v.join(other, "vec_id")
    return normalise(j.select("vec_id", V.l2("vec", "vec2").alias("l2"),
                              V.cosine("vec", "vec2").alias("cosine")))


@register("triplet_margin", f"""
WITH e AS {E_SQL}, n AS (SELECT count(*) AS c FROM e)
SELECT a.vec_id AS anc, p.vec_id AS pos, q.vec_id AS neg,
       round(greatest(0.0, list_distance(a.vec, p.vec) ^ 2 - list_distance(a.vec, q.vec) ^ 2 + 0.01), 6) AS loss
FROM e a, n
JOIN e p ON p.vec_id = (a.vec_id + 1) % n.c
JOIN e q ON q.vec_id = (a.vec_id + 2) % n.c
""")
def q_triplet_margin(spark, sf_dir):
    """triplets (v, v+1, v+2) modulo the row count, joined by id."""
    v = vectors(spark, sf_dir).select("vec_id", "vec")
    n = v.count()
    t = v.select(F.col("vec_id").alias("anc"), F.col("vec").alias("va"),
                 ((F.col("vec_id") + 1) % n).alias("pos"), ((F.col("vec_id") + 2) % n).alias("neg"))
    p = v.select(F.col("vec_id").alias("pos"), F.col("vec").alias("vp"))
    q = v.select(F.col("vec_id").alias("neg"), F.col("vec").alias("vn"))
    j = t.join(p, "pos").join(q, "neg")
    return normalise(j.select("anc", "pos", "neg", V.triplet_margin("va", "vp", "vn").alias("loss")))


@register("labelled_sentences", """
WITH s AS (SELECT doc_id, pos - 1 AS pos, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS sentence
           FROM (SELECT doc_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS pos
                 FROM (SELECT doc_id, string_split(text, '.') AS parts FROM documents))
           WHERE length(piece) > 40),
ids AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) - 1 AS sentence_id FROM s)
SELECT CAST(i.sentence_id AS BIGINT) AS sentence_id, i.doc_id, CAST(i.pos AS BIGINT) AS pos,
       i.sentence, e.label::BIGINT AS label
FROM ids i JOIN embeddings e ON e.vec_id = i.sentence_id % (SELECT count(*) FROM embeddings)
""")
def q_labelled_sentences(spark, sf_dir):
    """Every sentence with the vector and label of its id (modulo the number of vectors)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", spread_rows=True)
    s = numbered_sentences(docs, "text", "doc_id", min_chars=40)
    v = vectors(spark, sf_dir).select("vec_id", "label")
    n = max(v.count(), 1)
    return s.withColumn("vec_id", F.col("sentence_id") % n).join(v, "vec_id").select("sentence_id", "doc_id", "pos", "sentence", "label")


@register("pair_score_stats", f"""
WITH e AS {E_SQL},
p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.vec, b.vec) AS score
      FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id),
s AS (SELECT label, count(*) AS n_pairs, avg(score) AS avg_score, var_pop(score) AS var_score,
             min(score) AS min_score, first(a ORDER BY score, a, b) AS min_a,
             first(b ORDER BY score, a, b) AS min_b, max(score) AS max_score,
             first(a ORDER BY score DESC, a, b) AS max_a, first(b ORDER BY score DESC, a, b) AS max_b
      FROM p GROUP BY label),
na AS (SELECT p.label, first(p.a ORDER BY abs(p.score - s.avg_score), p.a, p.b) AS near_avg_a,
              first(p.b ORDER BY abs(p.score - s.avg_score), p.a, p.b) AS near_avg_b,
              first(p.score ORDER BY abs(p.score - s.avg_score), p.a, p.b) AS near_avg_score
       FROM p JOIN s USING (label) GROUP BY p.label),
sz AS (SELECT label, count(*) AS size FROM e GROUP BY label)
SELECT sz.label, sz.size, coalesce(s.n_pairs, 0) AS n_pairs, round(s.avg_score, 6) AS avg_score,
       round(s.var_score, 6) AS var_score, round(s.min_score, 6) AS min_score, s.min_a, s.min_b,
       round(s.max_score, 6) AS max_score, s.max_a, s.max_b, na.near_avg_a, na.near_avg_b,
       round(na.near_avg_score, 6) AS near_avg_score
FROM sz LEFT JOIN s USING (label) LEFT JOIN na USING (label)
""")
def q_pair_score_stats(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return normalise(D.pair_score_stats(v, "label", "vec_id", "vec", V.cosine, tile_rows=64,
                                        means=D.cosine_means(v, "label", "vec")))


@register("pair_score_examples", f"""
WITH e AS {E_SQL},
p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.vec, b.vec), 9) AS score
      FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score, a, b) - 1 AS rank,
             count(*) OVER (PARTITION BY label) AS n FROM p),
z AS (SELECT *, 'low' AS zone FROM r WHERE rank = 1
      UNION ALL SELECT *, 'mid' FROM r WHERE rank BETWEEN n // 2 - 1 AND n // 2 + 1
      UNION ALL SELECT *, 'high' FROM r WHERE rank = n - 2)
SELECT label, zone, CAST(rank AS BIGINT) AS rank, a, b, round(score, 6) AS score FROM z
""")
def q_pair_score_examples(spark, sf_dir):
    """Example pairs at the low, middle and high ranks of each cluster."""
    return normalise(D.pair_score_examples(vectors(spark, sf_dir), "label", "vec_id", "vec"))
