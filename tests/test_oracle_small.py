"""Spark vs DuckDB oracle on the smallest scale for the fast queries."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

FAST = ["helpfulness_profile", "most_reviewed_product", "vote_ratios", "helpful_unhelpful_topk",
        "standardize_dates", "tokenise_variants", "sentence_split_filtered", "token_sets",
        "jaccard_pairs", "vocabulary_by_freq", "cluster_centroids", "cluster_drift",
        "encoder_shift", "triplet_margin", "near_mid_far", "nearest_members", "rouge_n",
        "dbscan_fixed", "initial_population"]


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, name):
    from oracle_check import check
    res = check(spark, "/root/testdata/sf0.001", [name], verbose=False)
    assert res[name].startswith("OK"), res[name]


def test_entry(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0 and "n_reviews" in df.columns
