"""Registered format and word-vector queries.

Round trips write to a fresh folder under the shared checkpoint folder (never
a machine-local temp dir) and read back with a declared schema.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reviewlens.functions import text as T
from reviewlens.functions import vectors as V
from reviewlens.operators.vectors_ops import centroids
from reviewlens.plans.catalog import normalise, register, with_reviews
from reviewlens.session import checkpoint_dir
from reviewlens.sources import formats as FM
from reviewlens.sources.tables import reviews, table


def _scratch(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/io/{uuid.uuid4().hex}"


@register("io_round_trips", with_reviews("""
s AS (SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum(ups + inters) AS BIGINT) AS votes,
             CAST(sum(('0x' || substr(md5(coalesce(review_text, '')), 1, 8))::BIGINT) AS BIGINT) AS texts,
             count(*) FILTER (WHERE doc_id % 2 = 0) AS named
      FROM reviews)
SELECT fmt, n AS n_rows, ids AS sum_doc_id, votes AS sum_votes, texts AS sum_text_md5,
       CASE WHEN fmt = 'review_dicts' THEN named ELSE 0 END AS n_named FROM s,
  (SELECT unnest(['review_dicts', 'json_lines', 'csv', 'csv_splits', 'parquet_by_product',
                  'parquet']) AS fmt)
"""))
def q_io_round_trips(spark, sf_dir):
    """Every format, with whole texts; the dict lines also hold None for each second name.

    The reviews are joined once, for the parquet round trip; the other formats are written from its files."""
    base = _scratch(spark)
    columns = ["doc_id", "review_text", "ups", "inters"]
    schema = "doc_id BIGINT, review_text STRING, ups BIGINT, inters BIGINT"
    reviews(spark, sf_dir).select("asin", *columns, "overall").write.mode("overwrite").parquet(f"{base}/s8", compression="zstd")
    r = FM.read_parquet(spark, f"{base}/s8", f"asin STRING, {schema}, overall DOUBLE")
    out = []

    def summary(df, name, named=None):
        digest = F.conv(F.substring(F.md5(F.coalesce("review_text", F.lit(""))), 1, 8), 16, 10)
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("doc_id").cast("bigint").alias("sum_doc_id"),
                      F.sum(F.col("ups") + F.col("inters")).cast("bigint").alias("sum_votes"),
                      F.sum(digest.cast("bigint")).alias("sum_text_md5"),
                      F.count(named or F.lit(None)).alias("n_named")) \
            .select(F.lit(name).alias("fmt"), "*")

    dicts = r.select("asin", "doc_id", F.array("ups", "inters").alias("helpful"), "overall",
                     F.col("review_text").alias("reviewText"),
                     F.when(F.col("doc_id") % 2 == 0, F.lit("O'Neil \"é\"\x07")).alias("reviewerName"))
    FM.write_review_dicts(dicts, f"{base}/s1")
    back = FM.read_review_dicts(spark, f"{base}/s1")
    out.append(summary(back.select("doc_id", F.col("helpful")[0].alias("ups"), F.col("helpful")[1].alias("inters"),
                                   F.col("reviewText").alias("review_text"), "reviewerName"),
                       "review_dicts", "reviewerName"))
    r.select(columns).write.mode("overwrite").json(f"{base}/s2")
    out.append(summary(FM.read_json_lines(spark, f"{base}/s2", schema), "json_lines"))
    FM.write_csv(r.select(columns), f"{base}/s3")
    out.append(summary(FM.read_csv(spark, f"{base}/s3", schema), "csv"))
    sp = F.pmod(F.col("doc_id"), F.lit(3))
    paths = {}
    for i, name in enumerate(("train", "val", "test")):
        FM.write_csv(r.filter(sp == i).select(columns), f"{base}/s4_{name}", header=False)
        paths[name] = f"{base}/s4_{name}"
    out.append(summary(FM.read_splits(spark, paths, schema), "csv_splits"))
    FM.write_by_product(r.select("asin", *columns), f"{base}/s6")
    out.append(summary(FM.read_parquet(spark, f"{base}/s6", "asin STRING, " + schema), "parquet_by_product"))
    out.append(summary(FM.read_parquet(spark, f"{base}/s8", schema), "parquet"))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def md5_vector(word):
    """8-d word vector from the md5 of the word (4 hex digits per component)."""
    h = F.md5(word)
    return F.array(*[F.conv(F.substring(h, 4 * k + 1, 4), 16, 10).cast("double") / 65535.0 - 0.5
                     for k in range(8)])


SQL_WORD_VECTOR = "[" + ", ".join(
    f"('0x' || substr(md5(w), {4 * k + 1}, 4))::BIGINT / 65535.0 - 0.5" for k in range(8)) + "]"
_SQL_TOKENS = ("list_filter(regexp_split_to_array(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+'),"
               " lambda t: t <> '')")


@register("mean_vector_similarity", f"""
WITH toks AS (SELECT conv_id, turn, unnest({_SQL_TOKENS}) AS w FROM conversations),
vec AS (SELECT conv_id, turn, unnest({SQL_WORD_VECTOR}) AS x, generate_subscripts({SQL_WORD_VECTOR}, 1) AS d FROM toks),
m AS (SELECT conv_id, turn, list(x ORDER BY d) AS v
      FROM (SELECT conv_id, turn, d, avg(x) AS x FROM vec GROUP BY conv_id, turn, d) GROUP BY conv_id, turn)
SELECT a.conv_id, a.turn, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""")
def q_mean_vector_similarity(spark, sf_dir):
    """S9 + F13: the word-vector file is written from the vocabulary and read
    back; each turn's vector is the mean of its words' vectors; consecutive
    turns are compared by cosine."""
    cv = table(spark, sf_dir, "conversations", "conv_id", "turn", "text", spread_rows=True)
    toks = cv.select("conv_id", "turn", F.explode(T.whitespace_tokens(F.lower("text"))).alias("word"))
    vocab = toks.select("word").distinct().select("word", md5_vector(F.col("word")).alias("vec"))
    path = _scratch(spark)
    FM.write_word_vectors(vocab, path)
    wv = FM.read_word_vectors(spark, path)
    per_turn = centroids(toks.join(wv, "word"),
                         ["conv_id", "turn"], "vec", exclude_noise=False)
    a = per_turn.select("conv_id", "turn", F.col("centroid").alias("v1"))
    b = per_turn.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("centroid").alias("v2"))
    return normalise(a.join(b, ["conv_id", "turn"]).select(
        "conv_id", "turn", V.cosine("v1", "v2").alias("similarity")))
