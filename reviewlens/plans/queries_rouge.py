"""Registered ROUGE queries.

Summary per product = its first review (smallest doc_id); gold = its most
helpful review (highest smoothed ratio, ties -> smallest doc_id).  The
100-word limit is part of ROUGE itself (limit_length), applied to whole texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.operators import rouge as RG
from reviewlens.operators.votes import smoothed_ratio
from reviewlens.plans.catalog import normalise, register, with_reviews
from reviewlens.sources.tables import reviews


def summary_pairs(spark, sf_dir):
    r = reviews(spark, sf_dir).withColumn("ratio", smoothed_ratio())
    hyp = r.groupBy("asin").agg(F.min_by("review_text", "doc_id").alias("hyp"))
    gold = r.groupBy("asin").agg(
        F.max_by("review_text", F.struct(F.col("ratio"), -F.col("doc_id"))).alias("ref"))
    return RG.strict_pairs(hyp, gold, "asin")


_TOK = ("list_transform(list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '),"
        " lambda w: w <> '')[1:100], lambda w: CASE WHEN length(w) > 3"
        " THEN regexp_replace(w, '(ing|ed|es|s)$', '') ELSE w END)")

PAIRS_SQL = f"""
rr AS (SELECT *, (ups + 1.0) / (inters + 3.0) AS ratio FROM reviews),
hyp AS (SELECT asin, first(review_text ORDER BY doc_id) AS hyp FROM rr GROUP BY asin),
gold AS (SELECT asin, first(review_text ORDER BY ratio DESC, doc_id) AS ref FROM rr GROUP BY asin),
toks AS (SELECT asin, {_TOK.format(x='hyp')} AS ht, {_TOK.format(x='ref')} AS rt
         FROM hyp JOIN gold USING (asin)),
sides AS (SELECT asin, 'h' AS side, ht AS t FROM toks UNION ALL SELECT asin, 'r', rt FROM toks),
grams AS (SELECT asin, side, n, array_to_string(t[i:i + n - 1], ' ') AS g
          FROM (SELECT asin, side, t, unnest(range(1, 5)) AS n FROM sides) x,
               LATERAL (SELECT unnest(range(1, greatest(len(x.t) - x.n + 2, 1))) AS i) y),
cnt AS (SELECT asin, n, g, count(*) FILTER (WHERE side = 'h') AS ch,
               count(*) FILTER (WHERE side = 'r') AS cr FROM grams GROUP BY asin, n, g),
per AS (SELECT asin, n, sum(least(ch, cr))::DOUBLE AS ov, sum(ch)::DOUBLE AS nh, sum(cr)::DOUBLE AS nr
        FROM cnt GROUP BY asin, n),
full_ AS (SELECT t.asin, k.n, coalesce(ov, 0) AS ov, coalesce(nh, 0) AS nh, coalesce(nr, 0) AS nr
          FROM toks t CROSS JOIN (SELECT unnest(range(1, 5)) AS n) k
          LEFT JOIN per ON per.asin = t.asin AND per.n = k.n),
prf AS (SELECT asin, 'rouge-' || n AS rouge_type,
               CASE WHEN nh > 0 THEN ov / nh ELSE 0 END AS p,
               CASE WHEN nr > 0 THEN ov / nr ELSE 0 END AS r FROM full_),
scores AS (SELECT asin, rouge_type, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f, p, r
           FROM prf)
"""


@register("rouge_n", with_reviews(PAIRS_SQL + """
SELECT asin, rouge_type, round(f, 6) AS f, round(p, 6) AS p, round(r, 6) AS r FROM scores
"""))
def q_rouge_n(spark, sf_dir):
    return normalise(RG.rouge_n(summary_pairs(spark, sf_dir), "asin"))


@register("rouge_n_mean", with_reviews(PAIRS_SQL + """
SELECT rouge_type, round(avg(f), 6) AS f, round(avg(p), 6) AS p, round(avg(r), 6) AS r,
       count(*) AS n_summaries
FROM scores GROUP BY rouge_type
"""))
def q_rouge_n_mean(spark, sf_dir):
    return normalise(RG.rouge_mean(RG.rouge_n(summary_pairs(spark, sf_dir), "asin")))


# one row of the dynamic programme after the other: (length, weight, run) of every cell, flat
LCS_SQL = """
lcs AS (
  SELECT asin, ht, rt, 0 AS i, list_transform(range(0, 3 * (len(rt) + 1)), lambda x: 0.0::DOUBLE) AS cells FROM toks
  UNION ALL
  SELECT asin, ht, rt, i + 1, list_reduce(
    list_prepend([0.0::DOUBLE, 0.0, 0.0], list_transform(range(1, len(rt) + 1), lambda j: [j::DOUBLE])),
    lambda acc, x: list_concat(acc, CASE WHEN ht[i + 1] = rt[x[1]::INT]
      THEN [cells[3 * x[1]::INT - 2] + 1,
            cells[3 * x[1]::INT - 1] + pow(cells[3 * x[1]::INT] + 1, 1.2) - pow(cells[3 * x[1]::INT], 1.2),
            cells[3 * x[1]::INT] + 1]
      ELSE [greatest(cells[3 * x[1]::INT + 1], acc[len(acc) - 2]), greatest(cells[3 * x[1]::INT + 2], acc[len(acc) - 1]), 0.0] END))
  FROM lcs WHERE i < len(ht)),
ends AS (SELECT asin, len(ht)::DOUBLE AS nh, len(rt)::DOUBLE AS nr, cells[3 * len(rt) + 1] AS l, cells[3 * len(rt) + 2] AS w
         FROM lcs WHERE i = len(ht)),
prf_lw AS (
  SELECT asin, 'rouge-l' AS rouge_type, CASE WHEN nh > 0 THEN l / nh ELSE 0 END AS p, CASE WHEN nr > 0 THEN l / nr ELSE 0 END AS r FROM ends
  UNION ALL
  SELECT asin, 'rouge-w', CASE WHEN nh > 0 THEN pow(w / pow(nh, 1.2), 1 / 1.2) ELSE 0 END,
         CASE WHEN nr > 0 THEN pow(w / pow(nr, 1.2), 1 / 1.2) ELSE 0 END FROM ends),
lw AS (SELECT asin, rouge_type, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f, p, r FROM prf_lw)
"""
_RECURSIVE = with_reviews(PAIRS_SQL.strip() + "," + LCS_SQL).replace("WITH", "WITH RECURSIVE", 1)


@register("rouge_lw", _RECURSIVE + """
SELECT asin, rouge_type, round(f, 6) AS f, round(p, 6) AS p, round(r, 6) AS r FROM lw
""")
def q_rouge_lw(spark, sf_dir):
    """longest common subsequences, plain and weighted."""
    return normalise(RG.rouge_lw(summary_pairs(spark, sf_dir), "asin"))


@register("rouge_mean", _RECURSIVE + """
SELECT rouge_type, round(avg(f), 6) AS f, round(avg(p), 6) AS p, round(avg(r), 6) AS r, count(*) AS n_summaries
FROM (SELECT * FROM scores UNION ALL SELECT * FROM lw) GROUP BY rouge_type
""")
def q_rouge_mean(spark, sf_dir):
    """A16 over all six types."""
    return normalise(RG.rouge_mean(RG.rouge_all(summary_pairs(spark, sf_dir), "asin")))
