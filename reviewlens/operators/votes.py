"""Vote / helpfulness operators.

Input: a reviews DataFrame with ``asin, doc_id, ups, inters, overall``
(``helpful = [ups, inters]`` in the original data).  Everything is native
Column arithmetic; grouped work uses partial aggregation, group filters are
semi-joins and per-product top-k uses a window with a row limit (planned as
WindowGroupLimit, so a hot product sends only k rows per partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def downs(ups: str = "ups", inters: str = "inters") -> Column:
    """Down votes = total - up."""
    return F.col(inters) - F.col(ups)


def smoothed_ratio(ups: str = "ups", inters: str = "inters",
                   up_smooth: float = 1.0, total_smooth: float = 3.0) -> Column:
    """(ups + up_smooth) / (inters + total_smooth); never divides by zero."""
    return (F.col(ups) + F.lit(up_smooth)) / (F.col(inters) + F.lit(total_smooth))


def raw_ratio(ups: str = "ups", inters: str = "inters") -> Column:
    """Ups / inters, NULL when there are no votes."""
    return F.try_divide(F.col(ups).cast("double"), F.col(inters).cast("double"))


def helpfulness_profile(reviews: DataFrame, key: str = "asin") -> DataFrame:
    """A2: the helpfulness profile per product and over all reviews at once.

    ``rollup`` gives the grouping sets ((asin), ()); the global row has a NULL
    key and ``scope = 'all'``.
    """
    inters, ups = F.col("inters"), F.col("ups")
    n_reviews = F.count(F.lit(1))
    n_inter = F.sum(inters)
    n_help = F.sum(ups)
    nointer = F.count_if(inters == 0)
    return (
        reviews.rollup(key)
        .agg(
            F.grouping(key).alias("_g"),
            n_reviews.alias("n_reviews"),
            n_inter.cast("bigint").alias("n_interactions"),
            n_help.cast("bigint").alias("n_helpfuls"),
            nointer.alias("n_reviews_nointer"),
            (nointer / n_reviews).alias("percent_nointer"),
            F.try_divide(n_help.cast("double"), n_inter.cast("double")).alias("percent_helpful"),
            F.max(inters).alias("max_inter"),
            F.max(ups).alias("max_helpful"),
        )
        .withColumn("scope", F.when(F.col("_g") == 1, "all").otherwise("product"))
        .drop("_g")
    )


def most_reviewed_product(reviews: DataFrame, key: str = "asin") -> DataFrame:
    """A1: the reviews of the product with most reviews (ties -> smallest key).

    The count is a partial aggregate, the pick is a top-1 (TakeOrderedAndProject)
    and the result is a semi-join back to the reviews.
    """
    top = (reviews.groupBy(key).agg(F.count(F.lit(1)).alias("n_reviews"))
           .orderBy(F.desc("n_reviews"), F.asc(key)).limit(1))
    return reviews.join(top, key, "inner")


def products_having(reviews: DataFrame, predicate: Column, key: str = "asin") -> DataFrame:
    """J14 + A3: keep reviews whose product satisfies an aggregate predicate.

    ``predicate`` is an aggregate Column, e.g. ``F.sum("inters") > 40``.
    """
    keep = reviews.groupBy(key).agg(predicate.alias("_keep")).filter("_keep").select(key)
    return reviews.join(keep, key, "left_semi")


def active_product_reviews(reviews: DataFrame, min_total_inters: int = 40,
                           min_inter: int = 3) -> DataFrame:
    """Reviews of products with sum(inters) > 40 that have more than min_inter votes."""
    act = products_having(reviews, F.sum("inters") > min_total_inters)
    return act.filter(F.col("inters") > min_inter)


def positive_product_reviews(reviews: DataFrame, min_rating: float = 4.0,
                             min_reviews: int = 15) -> DataFrame:
    """P7 + A3: reviews rated >= 4 of products with more than 15 such reviews."""
    pos = reviews.filter(F.col("overall") >= min_rating)
    return products_having(pos, F.count(F.lit(1)) > min_reviews)


def vote_ratios(reviews: DataFrame, bad_min_inter: int = 4, bad_ratio: float = .3,
                good_min_inter: int = 8, good_ratio: float = .87,
                up_smooth: float = 1.0, total_smooth: float = 3.0) -> DataFrame:
    """Vote columns, raw and smoothed ratios, and the two label bands.

    ``band`` is 'unhelpful' (inters > 4 and raw < .3), 'helpful' (inters > 8 and
    smoothed > .87) or NULL; ``label`` is the ratio the band is based on.
    """
    raw = raw_ratio()
    smooth = smoothed_ratio(up_smooth=up_smooth, total_smooth=total_smooth)
    is_bad = (F.col("inters") > bad_min_inter) & (raw < bad_ratio)
    is_good = (F.col("inters") > good_min_inter) & (smooth > good_ratio)
    return reviews.select(
        "asin", "doc_id", "ups", "inters",
        downs().alias("downs"),
        raw.alias("raw_ratio"),
        smooth.alias("smoothed_ratio"),
        F.when(is_bad, "unhelpful").when(is_good, "helpful").alias("band"),
        F.when(is_bad, raw).when(is_good, smooth).alias("label"),
    )


def helpful_unhelpful_topk(reviews: DataFrame, min_inter: int = 3, k_helpful: int = 5,
                           k_unhelpful: int = 5, up_smooth: float = 1.0,
                           total_smooth: float = 3.0, key: str = "asin") -> DataFrame:
    """W1 + P12: per product, the top-k and bottom-k reviews by smoothed ratio.

    Only reviews with inters > min_inter count; products with fewer than two
    such reviews are dropped; k = min(int(n/2), k_*).  Ties break on doc_id.
    The k caps are applied with row_number <= k (WindowGroupLimit) before the
    per-product count is joined back, so no product's rows meet in one task.
    """
    rated = (reviews.filter(F.col("inters") > min_inter)
             .withColumn("ratio", smoothed_ratio(up_smooth=up_smooth,
                                                 total_smooth=total_smooth)))
    counts = rated.groupBy(key).agg(F.count(F.lit(1)).alias("n_rated")).filter("n_rated >= 2")
    hi = Window.partitionBy(key).orderBy(F.desc("ratio"), F.desc("doc_id"))
    lo = Window.partitionBy(key).orderBy(F.asc("ratio"), F.asc("doc_id"))
    cols = [key, "doc_id", "ratio"]
    top = (rated.withColumn("rank", F.row_number().over(hi)).filter(F.col("rank") <= k_helpful)
           .select(*cols, "rank", F.lit("helpful").alias("kind")))
    bottom = (rated.withColumn("rank", F.row_number().over(lo))
              .filter(F.col("rank") <= k_unhelpful)
              .select(*cols, "rank", F.lit("unhelpful").alias("kind")))
    both = top.unionByName(bottom).join(counts, key)
    k = F.when(F.col("kind") == "helpful",
               F.least(F.floor(F.col("n_rated") / 2), F.lit(k_helpful))).otherwise(
        F.least(F.floor(F.col("n_rated") / 2), F.lit(k_unhelpful)))
    return both.filter(F.col("rank") <= k).select(
        key, "doc_id", "kind", F.col("rank").cast("bigint").alias("rank"), "ratio", "n_rated")
