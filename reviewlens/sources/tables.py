"""Driver tables and the shared ``reviews`` view (D1 stand-in).

Each loader selects only the columns a caller asks for, so the parquet scan's
``ReadSchema`` stays narrow and filters written later are pushed to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin rows over all cores when a scan yields fewer partitions.

    CPU-heavy row work (text clean-up, tokenising) on a file with a single row
    group would otherwise run as one task.  On a real multi-file input the scan
    already has enough partitions and this is a no-op.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str,
          spread_rows: bool = False) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df) if spread_rows else df


def review_votes(spark: SparkSession, sf_dir: str, n_docs: int | None = None) -> DataFrame:
    """Per-document vote counts derived from ``events``.

    doc_id = (event_id^2 + 7*user_id) mod n_docs, computed with residues first
    so the product never overflows a BIGINT at any table size.  The aggregation
    is partial (map-side) before the shuffle on doc_id.
    """
    if n_docs is None:
        n_docs = table(spark, sf_dir, "documents", "doc_id").count()
    n = F.lit(int(max(n_docs, 1)))
    ev = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    ev = ev.filter((F.col("event_id") % 3 != 0) | (F.col("event_id") % 2 == 0))
    e = F.pmod(F.col("event_id"), n)
    doc = F.pmod(e * e + F.pmod(F.col("user_id") * 7, n), n)
    return ev.groupBy(doc.alias("doc_id")).agg(
        F.count_if(F.col("event_type").isin("view", "click", "purchase")).alias("ups"),
        F.count_if(F.col("event_type") != "signup").alias("inters"),
    )


def reviews(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """The review table: asin, doc_id, review_text, ups, inters, overall.

    ``helpful`` of the original data is ``[ups, inters]``; both are kept as
    separate BIGINT columns.  Documents are joined to the pre-aggregated votes
    (one row per doc) on doc_id.
    """
    cols = ["doc_id", "source", "lang"] + (["text"] if with_text else [])
    docs = table(spark, sf_dir, "documents", *cols, spread_rows=with_text)
    votes = review_votes(spark, sf_dir)
    out = docs.join(votes, "doc_id", "left").select(
        F.concat(F.col("source"), F.lit("-"), F.col("lang")).alias("asin"),
        F.col("doc_id"),
        *([F.col("text").alias("review_text")] if with_text else []),
        F.coalesce(F.col("ups"), F.lit(0)).cast("bigint").alias("ups"),
        F.coalesce(F.col("inters"), F.lit(0)).cast("bigint").alias("inters"),
        (F.lit(1) + F.col("doc_id") % 5).cast("double").alias("overall"),
    )
    return out


# Same view as SQL text, runnable by Spark SQL and DuckDB alike (used by the oracle).
REVIEWS_SQL = """
reviews_n AS (SELECT count(*) AS c FROM documents),
reviews_v AS (
  SELECT (event_id * event_id + 7 * user_id) % reviews_n.c AS doc_id,
         count(*) FILTER (WHERE event_type IN ('view','click','purchase')) AS ups,
         count(*) FILTER (WHERE event_type <> 'signup') AS inters
  FROM events CROSS JOIN reviews_n
  WHERE event_id % 3 <> 0 OR event_id % 2 = 0
  GROUP BY 1),
reviews AS (
  SELECT d.source || '-' || d.lang AS asin, d.doc_id, d.text AS review_text,
         CAST(coalesce(v.ups, 0) AS BIGINT) AS ups,
         CAST(coalesce(v.inters, 0) AS BIGINT) AS inters,
         CAST(1 + d.doc_id % 5 AS DOUBLE) AS overall
  FROM documents d LEFT JOIN reviews_v v ON d.doc_id = v.doc_id)
"""
