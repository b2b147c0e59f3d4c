"""Hand-worked goldens for the scalar text functions (FIXTURES §4)."""

from pyspark.sql import functions as F

from reviewlens.functions import text as T


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()["y"]


def test_contractions(spark):
    assert one(spark, T.expand_contractions("x"), "Can't") == "Cannot"
    assert one(spark, T.expand_contractions("x"), "can't've") == "cannot have"
    assert one(spark, T.expand_contractions("x"), "I'd") == "I would"
    assert one(spark, T.expand_contractions("x"), "CAN'T stop, he's here") == "Cannot stop, he is here"
    assert one(spark, T.expand_contractions("x"), "she'll've gone") == "she will have gone"
    assert one(spark, T.expand_contractions("x"), "no apostrophe") == "no apostrophe"
    assert one(spark, T.expand_contractions("x"), "'I can't' and 'don't'") == "'I cannot' and 'do not'"
    assert one(spark, T.expand_contractions("x"), "John's y'all'd've") == "John's you all would have"
    assert one(spark, T.expand_contractions("x"), "a 'cause, b") == "a because, b"


def test_accents(spark):
    assert one(spark, T.remove_accents("x"), "Éß") == "E"
    assert one(spark, T.remove_accents("x"), "café ñandú ĳ") == "cafe nandu ij"
    assert one(spark, T.remove_accents("x"), "Việt Nam ﬁne Ａ 日") == "Viet Nam fine A "


def test_dates(spark):
    assert one(spark, T.standardize_date("x"), "2 9, 2014") == "09 02 2014"
    assert one(spark, T.standardize_date("x"), "12 25, 2019") == "25 12 2019"


def test_tokens(spark):
    assert one(spark, T.space_tokens("x"), " a b . ") == ["a", "b"]
    assert one(spark, T.space_tokens("x", lower=True), "A B") == ["a", "b"]
    assert one(spark, T.whitespace_tokens("x"), "  a \n b  ") == ["a", "b"]
    assert one(spark, T.word_tokens("x"), "Hi, you!") == ["Hi", ",", "you", "!"]


def test_capitalise(spark):
    assert one(spark, T.capitalise("x"), "it WORKS .") == "It works."


def test_sentences(spark):
    assert one(spark, T.sentence_split("x"), "One. Two!  Three?\nFour") == ["One.", "Two!", "Three?", "Four"]
    assert one(spark, T.dot_split("x"), "a.b.") == ["a", "b", ""]


def test_jaccard_and_sets(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), ([], [])], "a array<string>, b array<string>")
    vals = [r[0] for r in df.select(T.jaccard("a", "b")).collect()]
    assert vals[0] == 0.5 and vals[1] == float("inf")
    assert one(spark, T.token_set("x"), "the cat and the hat cat") == ["cat", "hat"]


def test_length_penalty(spark):
    df = spark.createDataFrame([(5,), (20,)], "n int")
    vals = [round(r[0], 6) for r in df.select(T.length_penalty("n")).collect()]
    assert vals == [1.0, 0.4]
