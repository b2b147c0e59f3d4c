"""Operators keep what a driver or a task holds bounded."""

import collections
import pickle

import numpy as np
from pyspark.sql import functions as F


def test_benchmark_stays_off_the_driver(spark, monkeypatch):
    from reviewlens.llm import decontaminate
    items = [(i, " ".join(f"item{i}word{k}" for k in range(20)) + "? answer " + " ".join(f"a{i}x{k}" for k in range(8))) for i in range(60)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(d, "before " + items[d * 3][1] + " and then " + items[d * 3 + 1][1]) for d in range(20)] + [(99, "none"), (98, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = decontaminate.build(benchmark)
    assert len(one) == 1
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 2000)
    many = decontaminate.build(benchmark)
    assert len(many) > 5 and len(pickle.dumps(many)) < 300 * len(many) + 1000
    want = sorted((d, i) for d in range(20) for i in (d * 3, d * 3 + 1))
    for indexes in (one, many):
        assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, indexes).collect()) == want
        assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, indexes).collect()) == [98, 99]


def test_scores_do_not_depend_on_shards(spark, monkeypatch):
    from reviewlens.llm import decontaminate
    words = [f"w{k}" for k in range(60)]
    rng = np.random.default_rng(0)
    items = [(i, " ".join(rng.choice(words, rng.integers(8, 40))) + "? " + " ".join(rng.choice(words, 9))) for i in range(50)]
    items += [(3, items[3][1]), (None, items[4][1]), (77, ""), (78, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [t for _, t in items[:20]] + [" ".join(t.split()[len(t.split()) // 6:]) for _, t in items[20:40]] + [items[40][1] + " " + items[41][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def found():
        return sorted(((r.doc_id, r.item_id if r.item_id is not None else -1, round(r.score, 9), r.question_overlap, r.answer_overlap)
                       for r in decontaminate.contaminated(docs, indexes).collect()))

    results, shards = [], []
    for size in (512 << 10, 3000, 400):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", size)
        indexes = decontaminate.build(benchmark)
        shards.append(len(indexes))
        results.append(found())
    assert shards[0] == 1 and shards[1] < shards[2] and results[0] == results[1] == results[2]
    assert {d for d, *_ in results[0]} >= set(range(20)) and sum(s < 1 for _, _, s, *_ in results[0]) > 3


def test_posting_lists_and_long_home_lists_are_split(spark, monkeypatch):
    from reviewlens.llm import ngram_join
    monkeypatch.setattr(ngram_join, "HOME", 100)
    sets = [(s, 50, [7, 1000 + s % 40, 10_000 + s]) for s in range(1000)] + [(5, 50, [7, 1005, 10_005]), (5000, 50, [9]), (5000, 50, [9])]
    postings = ngram_join._postings(spark.createDataFrame(sets, "set long, n long, prefix array<long>"))
    lists = collections.defaultdict(dict)
    for s, _, prefix in sets:
        for place, shingle in enumerate(prefix):
            lists[shingle][s] = place
    want = sorted((k, s, 50, place, len(v)) for k, v in lists.items() if len(v) > 1 for s, place in v.items())
    assert sorted(tuple(r) for r in postings.collect()) == want
    chosen = spark.range(1000).select(F.col("id").alias("set"), F.lit(7).cast("long").alias("home"), F.lit(1000).alias("listed"))
    sizes = [r["count"] for r in ngram_join._homes(chosen).groupBy("home").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 200 and sum(sizes) == 1000
