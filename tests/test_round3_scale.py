"""Bounds of round 3's findings: what one task of a fit holds, and work that is done once."""

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from reviewlens.functions import text as T
from reviewlens.operators import models as M
from reviewlens.plans import queries_io as IO


def test_trees_read_bounded_partitions(spark, monkeypatch):
    rows = [(f"good word{i % 7} text {i}", (i % 10) / 10) for i in range(60)]
    train = spark.createDataFrame(rows, "review_text string, label double").coalesce(1)
    seen, plain = [], GBTRegressor.fit

    def fit(self, df, *args):
        seen.append(df.rdd.getNumPartitions())
        return plain(self, df, *args)

    monkeypatch.setattr(GBTRegressor, "fit", fit)
    model = M.fit_helpfulness(train, max_iter=1, num_features=64, task_bytes=4 * 64)  # one row a task
    assert seen == [60]
    assert M.score(model, train, "review_text").count() == 60
    # partitions grow with the rows, so a task's share does not
    assert M.tree_partitions(0, 4096) == 1
    assert 60 * M.tree_partitions(10**5, 4096) - M.tree_partitions(6 * 10**6, 4096) in range(60)


def test_reviews_are_joined_once_for_all_formats(spark, tmp_path, monkeypatch):
    docs = [(i, f"text {i}, with \"quotes\"\nand lines", "en", f"s{i % 2}") for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    events = [(i, i % 5, "view") for i in range(30)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    seen, plain = spark.sparkContext.accumulator(0), IO.reviews

    def meet(doc_id):
        seen.add(1)
        return True

    monkeypatch.setattr(IO, "reviews", lambda *a: plain(*a).filter(F.udf(meet, "boolean")("review_text")))
    got = {r.fmt: r for r in IO.q_io_round_trips(spark, str(tmp_path)).collect()}
    assert seen.value == 6
    assert len(got) == 6
    assert {(r.n_rows, r.sum_doc_id, r.sum_votes, r.sum_text_md5) for r in got.values()} == {tuple(got["csv"][1:5])}
    assert got["csv"].n_rows == 6 and got["review_dicts"].n_named == 3


def test_sentences_are_tokenised_once(spark):
    df = spark.createDataFrame([("The cat sat",), ("THE dog sat",), ("the",)], "sentence string")
    seen = spark.sparkContext.accumulator(0)

    def meet(s):
        seen.add(1)
        return s

    got = M.encode_sentences(df.select(F.udf(meet, "string")("sentence").alias("sentence")), "sentence", 16).collect()
    assert seen.value == 3
    lengths = {r.sentence: round(sum(x * x for x in r.vec), 9) for r in got}
    assert lengths == {"The cat sat": 1, "THE dog sat": 1, "the": 0}


def test_stop_words_are_looked_up_in_a_set(spark, capsys):
    texts = ["  the cat\tand\u00a0 the  hat cat \n", "", " \n", "THE the", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = df.select(T.token_set("x").alias("s"), T.whitespace_tokens("x").alias("w"))
    assert [r.s for r in got.collect()] == [["and\u00a0", "cat", "hat"], [], [], ["THE"], None]
    assert [r.w for r in got.collect()][1:] == [[], [], ["THE", "the"], None]
    got.select("s").explain()
    plan = capsys.readouterr().out
    assert "INSET" in plan and "array_contains" not in plan and "regexp_replace" not in plan
