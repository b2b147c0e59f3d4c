"""Exact dedup against brute force, whatever the runs, the fan-in and the short digest."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

TEXTS = ["same"] * 40 + ["", None, "Same", "same ", "é", "é", "x" * 300_000, "x" * 300_000, "x" * 299_999 + "y"]
SCHEMA = "doc_id long, text string, run string, digest int, best string"


def rows():
    out = [(i * 7 % 101, t, f"r{i}", i, None) for i, t in enumerate(TEXTS)]
    return out + [(None, "same", "n", 0, "b"), (None, "alone", "n", 0, "b"), (3, "twice", "a", 1, "c"), (3, "twice", "a", 1, "c")]


def expected(rows, pick):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1] or ""].append(r[0])
    return by, {t: pick(ids, key=lambda i: (i is not None, i or 0)) for t, ids in by.items()}


@pytest.mark.parametrize("fan_in,parts,keep", [(2, 9, "largest"), (16, 9, "largest"), (3, 5, "smallest"), (2, 1, "smallest")])
def test_equals_brute_force(spark, fan_in, parts, keep):
    from reviewlens.llm import exact_dedup
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(parts)
    by, stays = expected(rows(), max if keep == "largest" else min)
    for digest in (exact_dedup.short_digest, lambda c: F.lit(5).cast("long")):  # all texts share the second one
        got = exact_dedup.mark(docs, fan_in=fan_in, keep=keep, digest=digest).collect()
        assert len(got) == len(rows())
        sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in by}
        assert sorted(map(repr, ((r.doc_id, sha[r.text_sha256]) for r in got))) == sorted(map(repr, ((r[0], r[1] or "") for r in rows())))
        for r in got:
            t = sha[r.text_sha256]
            assert (r.keep_id, r.group_size) == (stays[t], len(by[t]))
            assert not r.kept or r.doc_id == r.keep_id
        assert collections.Counter(r.text_sha256 for r in got if r.kept) == {s: 1 for s in sha}


def test_deduplicated_keeps_whole_rows(spark):
    from reviewlens.llm import exact_dedup
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    got = exact_dedup.deduplicated(docs)
    assert got.schema == docs.schema
    by, stays = expected(rows(), max)
    kept = got.collect()
    assert sorted(map(repr, ((r.doc_id, r.text or "") for r in kept))) == sorted(map(repr, ((stays[t], t) for t in by)))
    assert {(r.run, r.digest) for r in kept} <= {(r[2], r[3]) for r in rows()}


def test_empty_table(spark):
    from reviewlens.llm import exact_dedup
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.mark(none).collect() == [] and exact_dedup.deduplicated(none).collect() == []


def test_no_entry_of_a_hot_text_passes_the_fan_in(spark):
    """A merge sees at most one entry for each of the runs it takes in."""
    from reviewlens.llm import exact_dedup
    docs = spark.range(0, 4000, 1, 20).select(F.col("id").alias("doc_id"), F.lit("hot").alias("text"))
    leaves = exact_dedup._leaves(docs, "text", "doc_id", exact_dedup.short_digest)
    first = leaves.withColumn("best", F.struct("id", "row")).withColumn("size", F.lit(1).cast("long"))
    one = exact_dedup._merge(first, F.max("best"))
    assert one.groupBy((F.col("run") / 16).cast("int")).count().agg(F.max("count")).first()[0] <= 16
    assert {(r.keep_id, r.group_size) for r in exact_dedup.mark(docs).collect()} == {(3999, 4000)}


def test_native_main_path(spark):
    from reviewlens.llm import exact_dedup
    plan = exact_dedup.mark(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
