"""Registered vote / helpfulness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.operators import votes
from reviewlens.plans.catalog import normalise, register, with_reviews
from reviewlens.sources.tables import reviews


@register("helpfulness_profile", with_reviews("""
g AS (
  SELECT asin, grouping(asin) AS gr,
         count(*) AS n_reviews,
         CAST(sum(inters) AS BIGINT) AS n_interactions,
         CAST(sum(ups) AS BIGINT) AS n_helpfuls,
         count(*) FILTER (WHERE inters = 0) AS n_reviews_nointer,
         count(*) FILTER (WHERE inters = 0) / count(*) AS percent_nointer,
         CASE WHEN sum(inters) = 0 THEN NULL
              ELSE CAST(sum(ups) AS DOUBLE) / CAST(sum(inters) AS DOUBLE) END AS percent_helpful,
         max(inters) AS max_inter, max(ups) AS max_helpful
  FROM reviews GROUP BY ROLLUP (asin))
SELECT asin, n_reviews, n_interactions, n_helpfuls, n_reviews_nointer,
       round(percent_nointer, 6) AS percent_nointer,
       round(percent_helpful, 6) AS percent_helpful, max_inter, max_helpful,
       CASE WHEN gr = 1 THEN 'all' ELSE 'product' END AS scope
FROM g
"""))
def q_helpfulness_profile(spark, sf_dir):
    return normalise(votes.helpfulness_profile(reviews(spark, sf_dir, with_text=False)))


@register("most_reviewed_product", with_reviews("""
top AS (SELECT asin, count(*) AS n_reviews FROM reviews GROUP BY asin
        ORDER BY n_reviews DESC, asin LIMIT 1)
SELECT r.asin, r.doc_id, r.ups, r.inters, r.overall, top.n_reviews
FROM reviews r JOIN top ON r.asin = top.asin
"""))
def q_most_reviewed_product(spark, sf_dir):
    r = reviews(spark, sf_dir, with_text=False)
    return normalise(votes.most_reviewed_product(r).select(
        "asin", "doc_id", "ups", "inters", "overall", "n_reviews"))


@register("active_products_reviews", with_reviews("""
SELECT asin, doc_id, ups, inters FROM reviews
WHERE asin IN (SELECT asin FROM reviews GROUP BY asin HAVING sum(inters) > 40)
  AND inters > 3
"""))
def q_active_products_reviews(spark, sf_dir):
    r = reviews(spark, sf_dir, with_text=False)
    return votes.active_product_reviews(r).select("asin", "doc_id", "ups", "inters")


@register("positive_product_reviews", with_reviews("""
SELECT asin, doc_id, overall FROM reviews
WHERE overall >= 4 AND asin IN (
  SELECT asin FROM reviews WHERE overall >= 4 GROUP BY asin HAVING count(*) > 15)
"""))
def q_positive_product_reviews(spark, sf_dir):
    r = reviews(spark, sf_dir, with_text=False)
    return normalise(votes.positive_product_reviews(r).select("asin", "doc_id", "overall"))


# The default bands (.3 / .87) select 4 and 0 rows at sf0.01; the test uses .5 / .8.
@register("vote_ratios", with_reviews("""
b AS (
  SELECT asin, doc_id, ups, inters, inters - ups AS downs,
         CASE WHEN inters = 0 THEN NULL ELSE CAST(ups AS DOUBLE) / inters END AS raw_ratio,
         (ups + 1.0) / (inters + 3.0) AS smoothed_ratio
  FROM reviews)
SELECT asin, doc_id, ups, inters, downs, round(raw_ratio, 6) AS raw_ratio,
       round(smoothed_ratio, 6) AS smoothed_ratio,
       CASE WHEN inters > 4 AND raw_ratio < .5 THEN 'unhelpful'
            WHEN inters > 8 AND smoothed_ratio > .8 THEN 'helpful' END AS band,
       round(CASE WHEN inters > 4 AND raw_ratio < .5 THEN raw_ratio
                  WHEN inters > 8 AND smoothed_ratio > .8 THEN smoothed_ratio END, 6) AS label
FROM b
"""))
def q_vote_ratios(spark, sf_dir):
    r = reviews(spark, sf_dir, with_text=False)
    return normalise(votes.vote_ratios(r, bad_ratio=.5, good_ratio=.8))


@register("helpful_unhelpful_topk", with_reviews("""
rated AS (SELECT asin, doc_id, (ups + 1.0) / (inters + 3.0) AS ratio
          FROM reviews WHERE inters > 3),
cnt AS (SELECT asin, count(*) AS n_rated FROM rated GROUP BY asin HAVING count(*) >= 2),
ranked AS (
  SELECT r.*, c.n_rated,
         row_number() OVER (PARTITION BY r.asin ORDER BY ratio DESC, doc_id DESC) AS rk_hi,
         row_number() OVER (PARTITION BY r.asin ORDER BY ratio ASC, doc_id ASC) AS rk_lo
  FROM rated r JOIN cnt c ON r.asin = c.asin)
SELECT asin, doc_id, 'helpful' AS kind, CAST(rk_hi AS BIGINT) AS rank, round(ratio, 6) AS ratio, n_rated
FROM ranked WHERE rk_hi <= least(n_rated // 2, 5)
UNION ALL
SELECT asin, doc_id, 'unhelpful' AS kind, CAST(rk_lo AS BIGINT) AS rank, round(ratio, 6) AS ratio, n_rated
FROM ranked WHERE rk_lo <= least(n_rated // 2, 5)
"""))
def q_helpful_unhelpful_topk(spark, sf_dir):
    r = reviews(spark, sf_dir, with_text=False)
    return normalise(votes.helpful_unhelpful_topk(r))
