"""Text operators over whole tables.

Row-local work (cleaning, splitting, tokenising) is a narrow projection; the
only shuffles are the grouped ones (postings, vocabularies) and the id joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions import text as T
from reviewlens.operators.common import dense_index, group_rank, running_total

# Reserved vocabulary ids (pad, unknown, start, end).
PAD, UNK, SOS, EOS = 0, 1, 2, 3
RESERVED = (("<PAD>", PAD), ("<UNK>", UNK), ("<SOS>", SOS), ("<EOS>", EOS))


def clean_text(c: Column | str) -> Column:
    """P1 text replacement: accents removed, then contractions expanded."""
    return T.expand_contractions(T.remove_accents(c))


def dot_sentences(df: DataFrame, text: str, keys: list[str], min_chars: int = 20,
                  max_chars: int | None = None) -> DataFrame:
    """F6b + P8: '.'-pieces longer than ``min_chars`` (measured before the
    strip, as the original does), stripped; ``pos`` is the piece's index."""
    exploded = df.select(*keys, F.posexplode(T.dot_split(text)).alias("pos", "piece"))
    cond = F.length("piece") > min_chars
    if max_chars is not None:
        cond = cond & (F.length("piece") < max_chars)
    return exploded.filter(cond).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), T.strip_ws("piece").alias("sentence"))


def punct_sentences(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Sentences ending in . ! ? (punctuation kept) or at line breaks."""
    return df.select(*keys, F.posexplode(T.sentence_split(text)).alias("pos", "sentence")) \
        .withColumn("pos", F.col("pos").cast("bigint"))


def numbered_sentences(df: DataFrame, text: str, key: str, min_chars: int = 20, name: str = "sentence_id") -> DataFrame:
    """(key, pos, sentence, number): the sentences of :func:`dot_sentences` numbered in (key, pos) order.

    Only (key, number of sentences) is ranked and summed up; a document's sentences get its offset
    plus their place in it, so texts move once, to their offset.  Keys are unique and not null."""
    pieces = F.filter(F.transform(T.dot_split(text), lambda p, i: F.struct(i.cast("bigint").alias("pos"), p.alias("piece"))),
                      lambda x: F.length(x["piece"]) > min_chars)
    offsets = running_total(df.select(key, F.size(pieces).alias("_n")), key, "_n", "_before")
    found = df.select(key, text).join(offsets.filter("_n > 0").select(key, "_before"), key)
    return found.select(key, "_before", F.posexplode(pieces).alias("_i", "_p")).select(
        key, "_p.pos", T.strip_ws("_p.piece").alias("sentence"), (F.col("_before") + F.col("_i")).alias(name))


def ranked_sentences(df: DataFrame, group: str, key: str, text: str, min_chars: int = 20, *extra: str) -> DataFrame:
    """(group, key, pos, sentence, sidx, extra): sentences numbered from 0 within each group in (key, pos) order.

    As in :func:`numbered_sentences` only the counts are ranked; a group's first number is taken off."""
    pieces = F.filter(F.transform(T.dot_split(text), lambda p, i: F.struct(i.cast("bigint").alias("pos"), p.alias("piece"))),
                      lambda x: F.length(x["piece"]) > min_chars)
    counts = df.select(group, key, F.size(pieces).alias("_n")).filter("_n > 0").withColumn("_at", F.struct(group, key))
    before = running_total(counts, "_at", "_n", "_before")
    first = before.groupBy(group).agg(F.min("_before").alias("_first"))
    starts = before.join(first, group).select(group, key, (F.col("_before") - F.col("_first")).alias("_start"))
    return df.select(group, key, text, *extra).join(starts, [group, key]).select(
        group, key, *extra, "_start", F.posexplode(pieces).alias("_i", "_p")).select(
        group, key, "_p.pos", T.strip_ws("_p.piece").alias("sentence"), (F.col("_start") + F.col("_i")).alias("sidx"), *extra)


def write_index_maps(df: DataFrame, key: str, idx: str, text: str, path: str, min_chars: int = 40) -> None:
    """``prod`` (key, place, idx): the reviews of each product in order, a row each, as a product may have any
    number; ``sents`` (idx, sentences): those of a review, which its text bounds."""
    group_rank(df.select(key, F.col(idx).alias("idx")), [key], ["idx"], name="place").select(key, "place", "idx").write.parquet(f"{path}/prod")
    kept = F.filter(T.dot_split(text), lambda p: F.length(p) > min_chars)
    df.select(F.col(idx).alias("idx"), F.transform(kept, T.strip_ws).alias("sentences")).write.parquet(f"{path}/sents")


def read_index_maps(spark, path: str, prod_schema: str) -> tuple[DataFrame, DataFrame]:
    return (spark.read.schema(prod_schema).parquet(f"{path}/prod"),
            spark.read.schema("idx BIGINT, sentences ARRAY<STRING>").parquet(f"{path}/sents"))


def sentences_of_products(prod: DataFrame, sents: DataFrame, key: str) -> DataFrame:
    """(key, place, idx, pos, sentence); a review that ``sents`` lacks is an error, one without sentences isn't."""
    found = prod.join(sents.withColumn("_known", F.lit(True)), "idx", "left")
    missing = F.raise_error(F.concat(F.lit("no sentences for review "), F.coalesce(F.col("idx").cast("string"), F.lit("null"))))
    found = found.withColumn("sentences", F.when(F.col("_known"), F.col("sentences")).otherwise(missing.cast("array<string>")))
    return found.select(key, "place", "idx", F.posexplode("sentences").alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("bigint"))


def token_rows(df: DataFrame, tokens: Column, keys: list[str]) -> DataFrame:
    """One row per token occurrence with its position."""
    return df.select(*keys, F.posexplode(tokens).alias("tpos", "token")) \
        .withColumn("tpos", F.col("tpos").cast("bigint"))


def oov_postings(doc_tokens: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """J8 + A10: tokens missing from the vocabulary, with the rows they occur in.

    Posting lists stay in long form ``(token, key, occurrences)`` (repeats are
    counted, not collected), so a very common unknown token never has to fit
    in one task.
    """
    missing = doc_tokens.join(vocab.select("token"), "token", "left_anti")
    return missing.groupBy("token", key).agg(F.count(F.lit(1)).alias("occurrences"))


def vocabulary_first_seen(token_occ: DataFrame, order: list[str]) -> DataFrame:
    """Ids in order of first appearance, starting after the reserved ids.

    ``order`` names the columns giving the global token order (e.g. doc_id,
    pos, tpos).  The first occurrence of each token is a partial ``min`` over a
    struct; the numbering is a distributed dense index.
    """
    first = token_occ.groupBy("token").agg(F.min(F.struct(*order)).alias("_first"))
    out = dense_index(first, [F.col("_first"), F.col("token")], name="idx",
                      start=len(RESERVED))
    return out.select("token", "idx")


def vocabulary_by_freq(token_occ: DataFrame, min_freq: int = 1,
                       max_size: int | None = None) -> DataFrame:
    """Token counts, rare tokens dropped, most frequent first (ties by
    token), optionally only the top ``max_size``; ids follow the reserved ones."""
    counts = token_occ.groupBy("token").agg(F.count(F.lit(1)).alias("freq")) \
        .filter(F.col("freq") >= min_freq)
    if max_size is not None:
        counts = counts.orderBy(F.desc("freq"), F.asc("token")).limit(max_size)
    return dense_index(counts, [F.desc("freq"), F.asc("token")], name="idx",
                       start=len(RESERVED)).select("token", "idx", "freq")


def index_tokens(token_occ: DataFrame, vocab: DataFrame, keys: list[str],
                 prepend: int | None = None) -> DataFrame:
    """Token -> id (unknown -> UNK), re-assembled per row in token order."""
    ids = token_occ.join(vocab.select("token", "idx"), "token", "left") \
        .withColumn("idx", F.coalesce(F.col("idx"), F.lit(UNK)).cast("bigint"))
    grouped = ids.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("tpos", "idx"))).alias("_p"))
    arr = F.transform(F.col("_p"), lambda s: s["idx"])
    if prepend is not None:
        arr = F.concat(F.array(F.lit(prepend).cast("bigint")), arr)
    return grouped.select(*keys, arr.alias("ids"))


def padded_ids(ids: Column | str, length: int = 512, cls: int = SOS, sep: int = EOS,
               pad: int = PAD) -> tuple[Column, Column, Column]:
    """[CLS] + ids[:length-2] + [SEP], zero-padded to ``length``; returns
    (input_ids, input_mask, segment_ids)."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    body = F.slice(ids, 1, length - 2)
    seq = F.concat(F.array(F.lit(cls).cast("bigint")), body, F.array(F.lit(sep).cast("bigint")))
    n_pad = F.lit(length) - F.size(seq)
    input_ids = F.concat(seq, F.array_repeat(F.lit(pad).cast("bigint"), n_pad))
    mask = F.concat(F.array_repeat(F.lit(1).cast("bigint"), F.size(seq)),
                    F.array_repeat(F.lit(0).cast("bigint"), n_pad))
    segment = F.array_repeat(F.lit(0).cast("bigint"), F.lit(length))
    return input_ids, mask, segment
