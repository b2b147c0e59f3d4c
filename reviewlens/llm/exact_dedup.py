"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Every scan partition is one run: its rows' digests, in digest order, equal texts already
folded.  Rounds of ``FAN_IN`` runs follow, as in a binomial tree: run r of a round goes to
run ``r // FAN_IN`` of the next, rows of one digest and run are merged, and the last round
leaves one entry for each text.  Then the result goes down the same tree, from each entry to
those it was merged from, and at last to the rows.  A text that a third of all rows hold has
at most one entry in a run, so no merge sees more than ``FAN_IN`` entries of it and no join more
than a scan partition's rows, on the way up and down; digests of a run are dealt over all tasks.

Runs are ordered by a 64-bit digest.  Entries are merged only where it is verified, in every round,
that the lengths in bytes and the 256-bit digests of the texts agree as well; entries that share
the short digest alone stay apart.  ``text_sha256`` is that digest.

Defined cases: a null text equals the empty text; a null id is less than every other id; of rows
that agree in text and id exactly one stays, the last one read; the row that stays has the
largest id, or the smallest with ``keep="smallest"``; an empty table gives no rows.  Any other
columns, also such as ``run`` or ``digest``, are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import shared

FAN_IN = 16
_ENTRY = ("run", "digest", "n_bytes", "sha")


def short_digest(text: Column) -> Column:
    return F.xxhash64(text)


def _leaves(docs: DataFrame, text: str, id: str, digest) -> DataFrame:
    """One narrow row per document; ``row`` tells repeated ids apart, ``run`` is the scan partition."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"),
        F.col(id).cast("long").alias("id"), digest(whole).alias("digest"),
        F.octet_length(whole).cast("long").alias("n_bytes"), F.unhex(F.sha2(whole, 256)).alias("sha"))
    return shared.written(rows.sortWithinPartitions("digest", "sha"), "exact-rows")


def _merge(entries: DataFrame, best: Column) -> DataFrame:
    return entries.groupBy(*_ENTRY).agg(best.alias("best"), F.sum("size").alias("size"))


def groups(docs: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "largest",
           digest=short_digest, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: run, row, id, n_bytes, sha, and its group's ``best`` (id, row) and ``size``."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is 'largest' or 'smallest', not {keep!r}")
    best = F.max("best") if keep == "largest" else F.min("best")
    leaves = _leaves(docs, text, id, digest)
    first = leaves.withColumn("best", F.struct("id", "row")).withColumn("size", F.lit(1).cast("long"))
    levels = [shared.written(_merge(first, best), "exact-level")]
    runs = (leaves.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        runs = -(-runs // fan_in)
        up = levels[-1].withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        levels.append(shared.written(_merge(up, best), "exact-level"))
    known = levels.pop()
    while levels:
        below = levels.pop().drop("best", "size").withColumn("child", F.col("run")).withColumn(
            "run", F.floor(F.col("run") / fan_in).cast("int"))
        known = below.join(known, list(_ENTRY)).drop("run").withColumnRenamed("child", "run")
    return leaves.join(known, list(_ENTRY))


def mark(docs: DataFrame, **how) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document, dropped ones too."""
    return groups(docs, **how).select(
        F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, text: str = "text", id: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they are."""
    stay = (groups(docs, text=text, id=id, **how).filter(F.col("id").eqNullSafe(F.col("best.id")))
            .groupBy("id", "n_bytes", "sha").agg(F.count(F.lit(1)).alias("times")))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    held = docs.select(F.struct("*").alias("_held"), F.col(id).cast("long").alias("_id"),
                       F.octet_length(whole).cast("long").alias("_bytes"), F.unhex(F.sha2(whole, 256)).alias("_sha"))
    found = held.join(stay, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_bytes") == F.col("n_bytes"))
                      & (F.col("_sha") == F.col("sha")))
    once = found.filter("times = 1").select("_held.*")
    again = found.filter("times > 1").dropDuplicates(["_id", "_sha"]).select("_held.*")
    return once.unionAll(again)
