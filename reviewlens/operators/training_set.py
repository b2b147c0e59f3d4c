"""Helpfulness training tables (mk1 / mk2): A13-A15, R1-R5, U1, J12, P9, S11.

Real rows come from the vote operators; synthetic "fake" reviews are built
from product sentences with repeatable hashed draws (seed, product, fake id,
draw index), so every run, retry and the oracle get the same table.  All
products are handled in one plan; the only driver actions are the class-count
guard of mk2 and its number of fakes (two scalars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.functions import hashing as H
from reviewlens.operators import votes
from reviewlens.operators.common import dense_index
from reviewlens.operators.text_ops import ranked_sentences
from reviewlens.sources.formats import write_csv


def _fake_text(chosen: DataFrame, keys: list[str], order: str) -> DataFrame:
    """F8: sentences of one fake joined with '. ' plus a final '.'; mean ratio."""
    return chosen.groupBy(*keys).agg(
        F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "sentence"))),
                                          lambda s: s["sentence"]), ". "), F.lit(".")).alias("review_text"),
        F.avg("ratio").alias("rating"), F.count(F.lit(1)).alias("n_sentences"))


def make_dataset_mk1(reviews: DataFrame, seed: int = 0, min_total_inters: int = 40,
                     min_inter: int = 3, k_helpful: int = 5, k_unhelpful: int = 5,
                     up_smooth: float = 1.0, total_smooth: float = 3.0,
                     min_sentence_chars: int = 20, label_sd: float = .1) -> DataFrame:
    """Per active product: top/bottom-k real reviews plus int(n/1.5) fakes.

    Fake label = max(0, N(rating * balance, sd)), balance =
    (.5 * (n_fake + n_real) - sum(real ratios)) / n_fake  (A14).
    Output: asin, kind ('helpful'|'unhelpful'|'fake'), item, review_text, label.
    """
    act = votes.products_having(reviews, F.sum("inters") > min_total_inters)
    real = votes.helpful_unhelpful_topk(act, min_inter, k_helpful, k_unhelpful,
                                        up_smooth, total_smooth)
    real = real.join(act.select("asin", "doc_id", "review_text"), ["asin", "doc_id"])
    per = real.groupBy("asin").agg(F.count(F.lit(1)).alias("n_real"),
                                   F.sum("ratio").alias("total_help"))
    per = per.withColumn("n_fake", F.floor(F.col("n_real") / 1.5).cast("bigint")).filter("n_fake > 0")
    per = per.withColumn("balance", (F.lit(.5) * (F.col("n_fake") + F.col("n_real"))
                                     - F.col("total_help")) / F.col("n_fake"))
    # all sentences of the product's reviews, each with its review's ratio
    rated = act.withColumn("ratio", votes.smoothed_ratio(up_smooth=up_smooth, total_smooth=total_smooth))
    sents = ranked_sentences(rated, "asin", "doc_id", "review_text", min_sentence_chars, "ratio")
    n_sent = sents.groupBy("asin").agg(F.count(F.lit(1)).alias("n_sent"))
    fakes = (per.join(n_sent, "asin")
             .select("asin", "balance", "n_sent",
                     F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_fake") - 1)).alias("fake")))
    lo = F.least(F.lit(4), F.col("n_sent"))
    hi = F.least(F.lit(20), F.col("n_sent"))
    fakes = fakes.withColumn("k", H.randint(lo, hi + 1, seed, "mk1k", F.col("asin"), F.col("fake")))
    # K different positions; sentences are found by position, whatever their number
    picks = fakes.select("asin", "fake", F.posexplode(H.sample(
        F.col("k"), F.col("n_sent"), seed, "mk1s", F.col("asin"), F.col("fake"))).alias("_r", "sidx"))
    chosen = picks.join(sents.select("asin", "sidx", "sentence", "ratio"), ["asin", "sidx"])
    fk = _fake_text(chosen, ["asin", "fake"], "_r").join(fakes.select("asin", "fake", "balance"),
                                                         ["asin", "fake"])
    fk = fk.select("asin", F.lit("fake").alias("kind"), F.col("fake").alias("item"), "review_text",
                   F.greatest(F.lit(0.0), H.normal(0.0, 1.0, seed, "mk1n", F.col("asin"), F.col("fake"))
                              * F.lit(label_sd) + F.col("rating") * F.col("balance")).alias("label"))
    rl = real.select("asin", "kind", F.col("doc_id").alias("item"), "review_text",
                     F.col("ratio").alias("label"))
    return rl.unionByName(fk)


def make_dataset_mk2(reviews: DataFrame, seed: int = 0, bad_ratio: float = .3,
                     good_ratio: float = .87, bad_min_inter: int = 4, good_min_inter: int = 8,
                     min_rating: float = 4.0, min_pos_reviews: int = 15,
                     min_sentence_chars: int = 30, check_balance: bool = True,
                     train_fraction: float = .8) -> DataFrame:
    """Global bands of real reviews plus as many fakes as helpful rows.

    Fakes: product drawn with replacement (R3) among products with > 15
    positive reviews; k in [2, min(24, n)] sentences drawn with replacement
    (R2); with probability .01 the draw is redrawn from itself; label
    max(0, N(.05, .02)) (R4).  Rows with NULLs are dropped (P9) and an 80/20
    split column is a stable hash bucket (R5).  ``check_balance`` raises when
    n_bad >= n_helpful (A15), like the original assertion.
    """
    vr = votes.vote_ratios(reviews, bad_min_inter, bad_ratio, good_min_inter, good_ratio)
    banded = vr.filter(F.col("band").isNotNull()).join(
        reviews.select("doc_id", "review_text"), "doc_id")
    counts = banded.groupBy().agg(F.count_if(F.col("band") == "unhelpful").alias("n_bad"),
                                  F.count_if(F.col("band") == "helpful").alias("n_helpful")).first()
    n_bad, n_helpful = int(counts["n_bad"]), int(counts["n_helpful"])
    if check_balance and not n_bad < n_helpful:
        raise ValueError(f"class guard failed: n_bad={n_bad} >= n_helpful={n_helpful}")
    pos = votes.positive_product_reviews(reviews, min_rating, min_pos_reviews)
    sents = ranked_sentences(pos, "asin", "doc_id", "review_text", min_sentence_chars)
    n_sent = sents.groupBy("asin").agg(F.count(F.lit(1)).alias("n_sent"))
    prods = dense_index(n_sent.select("asin", "n_sent"), ["asin"], name="pidx")
    n_prods = n_sent.count()
    spark = reviews.sparkSession
    if n_helpful > 0 and n_prods == 0:
        raise ValueError("no product qualifies for synthetic reviews")
    fakes = spark.range(n_helpful).select(F.col("id").alias("fake"))
    fakes = fakes.withColumn("pidx", H.randint(0, n_prods, seed, "mk2p", F.col("fake")))
    fakes = fakes.join(prods, "pidx")
    fakes = fakes.withColumn("k", H.randint(F.least(F.lit(2), F.col("n_sent")),
                                            F.least(F.lit(24), F.col("n_sent")) + 1,
                                            seed, "mk2k", F.col("fake")))
    fakes = fakes.withColumn("redraw", H.uniform(seed, "mk2r", F.col("fake")) < .01)
    draws = fakes.select("fake", "asin", "n_sent", "k", "redraw",
                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("i"))
    first = H.randint(0, F.col("n_sent"), seed, "mk2s", F.col("fake"), F.col("i"))
    # redraw: position i takes draw number j (with replacement) of the first draw
    j = H.randint(0, F.col("k"), seed, "mk2j", F.col("fake"), F.col("i"))
    draws = draws.withColumn("first_sidx", first).withColumn("j", F.when(F.col("redraw"), j)
                                                             .otherwise(F.col("i")))
    base = draws.select("fake", F.col("i").alias("j"), F.col("first_sidx").alias("sidx"))
    picks = draws.select("fake", "asin", "i", "j").join(base, ["fake", "j"])
    chosen = picks.join(sents.select("asin", "sidx", "sentence"), ["asin", "sidx"]) \
        .withColumn("ratio", F.lit(0.0))
    fk = _fake_text(chosen, ["fake"], "i").select(
        F.lit("fake").alias("kind"), F.col("fake").alias("item"), "review_text",
        F.greatest(F.lit(0.0), H.normal(.05, .02, seed, "mk2n", F.col("fake"))).alias("label"))
    real = banded.select(F.col("band").alias("kind"), F.col("doc_id").alias("item"),
                         "review_text", "label")
    out = real.unionByName(fk).na.drop()
    return out.withColumn("split", F.when(H.uniform(seed, "split", F.col("kind"), F.col("item"))
                                          < train_fraction, "train").otherwise("val"))


def write_training_csv(df: DataFrame, path: str) -> None:
    """One CSV folder per split (``<path>_train``, ``<path>_val``), header on, texts as they are."""
    for split in ("train", "val"):
        write_csv(df.filter(F.col("split") == split).select(F.col("review_text").alias("reviewText"), "label"), f"{path}_{split}")
