"""Shared DataFrame building blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.session import checkpoint_dir


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back:
    later uses see the same rows even when executors were lost or the plan holds
    non-repeatable steps (sampled range bounds, row ids).  A checkpoint would carry
    the optimiser's constraints from round to round of a loop, and they grow."""
    spark = df.sparkSession
    path = new_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dense_index(df: DataFrame, order: list[Column | str], name: str = "idx",
                start: int = 0, partitions: int | None = None) -> DataFrame:
    """Number rows 0..n-1 (+start) in a total order without a single-task window.

    Rows are range-partitioned and sorted on ``order`` (which must be a total
    order, i.e. end with a unique key).  Each partition's local position comes
    from ``monotonically_increasing_id`` and the partition's offset from a
    cumulative sum over the per-partition counts: a table with one row per
    partition, so its broadcast is bounded by the partition count.  The sorted
    rows are checkpointed once, so row ids and partition ids stay consistent
    between the count pass and the numbering pass.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = cut_lineage(df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mono", F.monotonically_increasing_id()))
    local = F.col("_mono") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    counts = ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    out = ranked.join(F.broadcast(offsets), "_pid").withColumn(
        name, F.coalesce(F.col("_off"), F.lit(0)) + local + F.lit(start))
    return out.drop("_pid", "_mono", "_off")


def running_total(df: DataFrame, order: str, size: str, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with the sum of ``size`` over all rows before, in the order of a unique column.

    As in :func:`dense_index`: rows are range-partitioned, a partition's rows are summed up by
    themselves, and the sums of the partitions before (one row each) are added."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.repartitionByRange(n, order).withColumn("_pid", F.spark_partition_id()))
    inside = Window.partitionBy("_pid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_pid").agg(F.sum(size).alias("_sum"))
    before = sums.select("_pid", F.sum("_sum").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)).alias("_off"))
    local = F.coalesce(F.sum(size).over(inside), F.lit(0))
    out = dealt.withColumn("_local", local).join(F.broadcast(before), "_pid")
    return out.withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local")).drop("_pid", "_local", "_off")


def consecutive_pairs(df: DataFrame, key: str, pos: str, cols: list[str]) -> DataFrame:
    """Each row with the next row of the same key (pos + 1), as an equi-join.

    Unlike ``lead`` over a window this never puts one key's rows into one task:
    the join key is (key, pos), so a huge key spreads over all partitions.
    Positions must be dense (0, 1, 2, ...).
    """
    a = df.select(key, pos, *[F.col(c).alias(f"{c}1") for c in cols])
    b = df.select(F.col(key), (F.col(pos) - 1).alias(pos), *[F.col(c).alias(f"{c}2") for c in cols])
    return a.join(b, [key, pos])


def group_rank(df: DataFrame, key: list[str], order: list[Column | str],
               name: str = "rank", partitions: int | None = None) -> DataFrame:
    """0-based rank of each row within its key group, in a total ``order``.

    Same idea as :func:`dense_index` but per group: rows are range-partitioned
    on (key, order), so a huge group is split over many tasks instead of being
    sorted in one window task.  Offsets come from the per-(partition, key)
    counts, a table with at most partitions + groups rows.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    key_cols = [F.col(k) for k in key]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = cut_lineage(df.repartitionByRange(n, *key_cols, *order_cols)
                         .sortWithinPartitions(*key_cols, *order_cols)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mono", F.monotonically_increasing_id()))
    counts = ranked.groupBy("_pid", *key).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    w = Window.partitionBy(*key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", *key, "_first",
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = ranked.join(offsets, ["_pid", *key]).withColumn(
        name, F.col("_off") + F.col("_mono") - F.col("_first"))
    return out.drop("_pid", "_mono", "_off", "_first")


def salted_self_pairs(df: DataFrame, key: str, id_col: str, cols: list[str],
                      tile_rows: int = 2048) -> DataFrame:
    """All pairs (a, b) with a.key == b.key and a.id < b.id, hot keys split.

    Each key gets ``t = ceil(size / tile_rows)`` salts: the left side is
    hashed into one of t salts, the right side is replicated t times, and the
    equi-join runs on (key, salt).  A key holding a third of all rows is thus
    spread over t tasks instead of one; small keys keep t = 1 (no copies).
    """
    sizes = df.groupBy(key).agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(tile_rows))).alias("_t"))
    base = df.select(key, id_col, *cols).join(sizes, key)
    left = base.select(F.col(key), F.col(id_col).alias(f"{id_col}_a"),
                       *[F.col(c).alias(f"{c}_a") for c in cols],
                       F.pmod(F.xxhash64(F.col(id_col)), F.col("_t")).alias("_salt"))
    right = base.select(F.col(key), F.col(id_col).alias(f"{id_col}_b"),
                        *[F.col(c).alias(f"{c}_b") for c in cols],
                        F.explode(F.sequence(F.lit(0).cast("bigint"),
                                             (F.col("_t") - 1).cast("bigint"))).alias("_salt"))
    pairs = left.join(right, [key, "_salt"])
    return pairs.filter(F.col(f"{id_col}_a") < F.col(f"{id_col}_b")).drop("_salt")
