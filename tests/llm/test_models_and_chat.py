"""Classifiers by held-out accuracy, search against exact scores, chat formatting by round trip."""

import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF01


@pytest.fixture(scope="module")
def tables(spark):
    from reviewlens.llm.queries import table
    return {t: table(spark, SF01, t) for t in ("documents", "labels", "benchmark")}


def test_toxicity_on_held_out_rows(tables):
    from reviewlens.llm import toxicity
    model = toxicity.fit(tables["documents"], tables["labels"])
    got = toxicity.score_documents(tables["documents"], model).join(tables["labels"], "doc_id").filter("held_out").toPandas()
    assert got.score.between(0, 1).all()
    assert (got.predicted == got.toxic).mean() > 0.9
    assert got[got.toxic == 0].predicted.mean() < 0.05


def test_toxicity_without_labels_flags_nothing(tables):
    from reviewlens.llm import toxicity
    model = toxicity.fit(tables["documents"], tables["labels"].limit(0))
    assert toxicity.score_documents(tables["documents"], model).filter("predicted = 1").count() == 0


def test_label_model_discounts_copied_voters():
    from reviewlens.llm.toxicity import label_model
    rng = np.random.default_rng(2)
    y = rng.random(3000) < 0.3
    votes = np.array([np.where(y, rng.random(3000) < 0.7, rng.random(3000) < 0.05) for _ in range(4)])
    fires = np.vstack([votes, votes[3], votes[3], ~votes.any(0)]).T.astype(float)
    post, found = label_model(fires, y, 0.3)
    assert ((post > 0.5) == y).mean() > 0.95
    assert found["weight"][3] < found["weight"][0]


def test_language_id_on_held_out_rows(spark, tables):
    from reviewlens.llm import langid
    network = langid.fit(tables["documents"])
    got = langid.predict(tables["documents"], network).join(
        tables["documents"].select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "٣"), (5, "é")], "doc_id long, text string")
    named = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, network).collect()}
    assert all(named[k] == ("und", 0.0) for k in (1, 2, 3, 4)) and named[5][0] != "und"


def test_gradients_of_the_recurrent_cell():
    from reviewlens.llm.langid import HIDDEN, Cell
    rng = np.random.default_rng(0)
    cell = Cell(rng)
    x = rng.integers(0, 5, (6, 3))
    weight = rng.normal(size=(6, 3, HIDDEN)).astype(np.float32)
    loss = lambda: float((cell.run(x)[0].astype(float) * weight).sum())
    _, tape = cell.run(x, keep=True)
    dw, du = cell.backward(x, tape, weight)
    for array, grad, at in ((cell.u, du, (2, 3)), (cell.u, du, (1, 20)), (cell.w, dw, (int(x[0, 0]), 18))):
        old, step = array[at], np.float32(1e-2)
        array[at] = old + step
        up = loss()
        array[at] = old - step
        assert abs((up - loss()) / 2e-2 - grad[at]) < 0.02 * max(1, abs(grad[at]))
        array[at] = old


def test_wand_equals_exact_scores(tables, monkeypatch):
    from reviewlens.llm import decontaminate
    index = decontaminate.build(tables["benchmark"])[0]
    texts = [r.text for r in tables["documents"].orderBy("doc_id").limit(60).collect()]
    for threshold in (0.5, 0.1, 0.03):
        monkeypatch.setattr(decontaminate, "THRESHOLD", threshold)
        for text in texts:
            hashes, _ = decontaminate._words(*decontaminate.tb.utf8(pa.array([text])))
            terms = np.unique(index.lookup(hashes))
            terms = terms[terms >= 0]
            exact = np.zeros(len(index.ids))
            for t in terms:
                lo, hi = index.begin[t], index.begin[t + 1]
                exact[index.item[lo:hi]] += index.impact[lo:hi]
            want = set(np.flatnonzero(exact >= threshold - 1e-9).tolist())
            assert {i for i, _ in index.search(terms.tolist())} == want
            assert not want or len(index.screen(np.zeros(len(terms), np.int64), terms, 1)) == 1


def test_planted_items_are_found_and_clean_texts_kept(spark, tables):
    from reviewlens.llm import decontaminate
    item = tables["benchmark"].orderBy("item_id").first()
    rows = [(1, "before words " + item.text + " after"), (2, item.text[: len(item.text) // 4]), (3, None), (4, ""), (5, "x " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    indexes = decontaminate.build(tables["benchmark"])
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, indexes).collect()] == [(1, item.item_id)]
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, indexes).collect()) == [2, 3, 4, 5]
    assert decontaminate.contaminated(docs, decontaminate.build(tables["benchmark"].limit(0))).count() == 0


def test_chat_query_equals_sql(spark):
    from reviewlens.llm import queries
    got = queries.QUERIES["op4_chat_format"](spark, SF01).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF01}/conversations.parquet'")
    want = con.sql(queries.ORACLES["op4_chat_format"]).df()
    assert len(got) == len(want) == len(got.merge(want, on=list(want.columns)))


def test_chat_fold_and_marks_inside_texts(spark):
    from reviewlens.llm import chat
    log = [(1, 0, 0, "start", "user", None), (1, 0, 1, "delta", "user", "a</s>"), (1, 0, 2, "delta", "user", "\\l["),
           (1, 1, 3, "start", "assistant", None), (1, 1, 4, "delta", "assistant", "draft"),
           (1, 1, 5, "regenerate", "assistant", None), (1, 1, 6, "delta", "assistant", "x"), (1, 1, 8, "delta", "assistant", "z"),
           (1, 1, 7, "delta", "assistant", "y"), (1, 2, 9, "start", "user", ""), (1, 2, 10, "delta", "user", "old"),
           (1, 2, 11, "edit", "user", "new"), (None, 0, 0, "start", None, None)]
    df = spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")
    messages = chat.fold(df)
    assert sorted((r.message, r.text) for r in messages.filter("conv_id = 1").collect()) == [(0, "a</s>\\l["), (1, "xyz"), (2, "new")]
    got = {r.conv_id: r for r in chat.read_back(chat.render(messages)).collect()}
    turns = "user\na</s>\\l[\nassistant\nxyz\nuser\nnew\n"
    assert got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 3, hashlib.sha256(b"xyz").hexdigest())
    assert (got[None].n_turns, got[None].loss_chars) == (1, 0)
    assert chat.read_back(chat.render(chat.fold(df.limit(0)))).count() == 0


def test_turns_of_one_number_are_ordered_by_role_and_text(spark):
    from reviewlens.llm import chat
    rng = np.random.default_rng(4)
    rows = [(1, 0, "user", t) for t in "fbdace"] + [(1, 0, "assistant", "z"), (1, 0, "user", "b"), (1, None, "user", "q")]
    rows += [(2, t, ["user", "assistant"][t % 2], f"turn {t} " + "é" * int(rng.integers(0, 9))) for t in range(700)]
    rows += [(3, 0, "assistant", "w" * 70_001), (3, 0, "assistant", "w" * 70_000), (4, 5, "user", "same start " * 9 + "b"),
             (4, 5, "user", "same start " * 9 + "a"), (4, 5, None, None)]
    turns = spark.createDataFrame([(*r, "m", 1) for r in rows], "conv_id long, turn long, role string, text string, message string, seq int")
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(chat.events_from_turns(turns.repartition(6))))).collect()}
    for conv in (1, 2, 3, 4):
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        learned = "".join(x for _, _, r, x in own if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_pipeline_keeps_columns_and_only_narrows(spark):
    import corpus_pipeline
    docs = corpus_pipeline.table(spark, SF01, "documents")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.shared.written(stage(spark, docs, SF01), "test-stage")
        assert after.columns == docs.columns
        assert 0 < after.count() <= n
        docs, n = after, after.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF01).count() == n


def test_pipeline_decodes_written_ids(spark):
    """Encoding and decoding in one stage hold two Python workers per core, with a vocabulary each."""
    import corpus_pipeline
    docs = spark.createDataFrame([(1, "Hello world, hello"), (2, ""), (3, None), (None, "é 日本"), (1, "Hello world, hello")],
                                 "doc_id long, text string")
    found = corpus_pipeline.byte_bpe(spark, docs, SF01)
    steps = found._jdf.queryExecution().executedPlan().toString()
    assert steps.count("MapInArrow") == 1
    said = sorted((r.doc_id is None, r.doc_id or 0, r.decoded_sha256) for r in found.collect())
    assert said == sorted((i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest())
                          for i, t in [(1, "Hello world, hello"), (2, ""), (3, None), (None, "é 日本"), (1, "Hello world, hello")])
