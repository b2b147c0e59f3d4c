"""Cluster diagnostics.

Pair statistics score every unordered pair inside a cluster with a pluggable
score function ``(Column, Column) -> Column``.  Pairs are produced by a salted
self-join (hot clusters split over many tasks) and folded straight into
partial aggregates, so they are never shuffled or stored as a table.

Cosines are not scored pair by pair: a cluster's vectors are cut into blocks of ``BLOCK`` rows, and a task
multiplies two blocks, ``AT_ONCE`` products at a time, and puts out what the aggregates need (one row of
statistics, or the bins of a histogram).  Every pair is scored in either form.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions import vectors as V
from reviewlens.operators.common import cut_lineage, group_rank, salted_self_pairs

BLOCK = 8192
AT_ONCE = 1 << 21
CLOSE = 1e-12  # products may differ in their last places from scores that are summed pair by pair

ScoreFn = Callable[[Column, Column], Column]


def pair_scores(df: DataFrame, label: str, id_col: str, feat: str,
                score: ScoreFn = V.cosine, tile_rows: int = 2048) -> DataFrame:
    """J3 + X1: (label, id_a, id_b, score) for every pair id_a < id_b of a cluster."""
    pairs = salted_self_pairs(df, label, id_col, [feat], tile_rows=tile_rows)
    return pairs.select(label, f"{id_col}_a", f"{id_col}_b",
                        score(F.col(f"{feat}_a"), F.col(f"{feat}_b")).alias("score"))


def _block_pairs(df: DataFrame, label: str, id_col: str, feat: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows, tiles): (label, block, place, id, v) of all vectors, and the block pairs (label, i, j), i <= j, of a label."""
    vec = F.col(feat).cast("array<double>")
    rows = group_rank(df.filter(F.col(id_col).isNotNull()).select(label, F.col(id_col).alias("id"), vec.alias("v")),
                      [label], ["id"], name="place")
    rows = rows.withColumn("block", F.floor(F.col("place") / block))
    last = rows.groupBy(label).agg(F.max("block").alias("_last"))
    first = last.select(label, "_last", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")).alias("i"))
    return rows, first.select(label, "i", F.explode(F.sequence("i", "_last")).alias("j"))


def _over_blocks(rows: DataFrame, tiles: DataFrame, label: str, fn, schema: T.StructType) -> DataFrame:
    """``fn`` of the two blocks of each tile; further columns of ``tiles`` come with the left one."""
    by = [label, "i", "j"]
    left = rows.withColumnRenamed("block", "i").join(tiles, [label, "i"])
    right = rows.withColumnRenamed("block", "j").join(tiles.select(*by), [label, "j"])
    left, right = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (left, right))
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(fn, schema)


def _in_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows, summed one dimension after the other."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


class _Tile:
    """The cosines of two blocks, in slices of at most ``AT_ONCE``; pairs of equal ids are none."""

    def __init__(self, left: pd.DataFrame, right: pd.DataFrame):
        left, right = left.sort_values("place"), right.sort_values("place")
        self.same = left["i"].iloc[0] == right["j"].iloc[0]
        self.p, self.q = left["id"].to_numpy(), right["id"].to_numpy()
        self.a, self.x = self._unit(left["v"])
        self.b, self.y = self._unit(right["v"])

    @staticmethod
    def _unit(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, norms); rows without a cosine (null, zeros, a null inside) have the norm NaN."""
        size = max((len(v) for v in column if v is not None), default=1)
        v = np.stack([np.full(size, np.nan) if x is None else x for x in column]).astype(float)
        norm = np.sqrt(_in_turn(v, v))
        norm[norm == 0] = np.nan
        return v, norm

    def slices(self):
        """(first row, scores, pair or not): scores are NaN where a vector has no direction."""
        u, w = np.nan_to_num(self.a / self.x[:, None]), np.nan_to_num(self.b / self.y[:, None]).T
        dead = np.isnan(self.x)[:, None], np.isnan(self.y)
        step = max(1, AT_ONCE // len(self.q))
        for at in range(0, len(self.p), step):
            s = u[at:at + step] @ w
            if dead[0].any() or dead[1].any():
                s[dead[0][at:at + step] | dead[1]] = np.nan
            pairs = self.p[at:at + step, None]
            yield at, s, (pairs < self.q) if self.same else (pairs != self.q)

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Scores as :func:`V.cosine` sums them, the same wherever equal vectors stand."""
        out = np.empty(len(i))
        for k in range(0, len(i), 1 << 15):
            at, to = i[k:k + (1 << 15)], j[k:k + (1 << 15)]
            out[k:k + (1 << 15)] = _in_turn(self.a[at], self.b[to]) / (self.x[at] * self.y[to])
        return out

    def ends(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum(self.p[i], self.q[j]), np.maximum(self.p[i], self.q[j])

    def least(self, at: int, key: np.ndarray, of, best):
        """The least (of(score), a, b, score) of a slice and ``best``; ``key`` is about of(score), infinite for no pair."""
        low = key.min(initial=np.inf)
        if not np.isfinite(low) or (best is not None and low > best[0] + CLOSE):
            return best
        i, j = np.nonzero(key <= low + CLOSE)
        score = self.exact(i + at, j)
        value = of(score)
        a, b = self.ends(i + at, j)
        k = np.lexsort((b, a, value))[0]
        got = (float(value[k]), int(a[k]), int(b[k]), float(score[k]))
        return got if best is None else min(got, best)


_STATS = T.StructType([T.StructField("n", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("dd", T.DoubleType()),
                       T.StructField("scored", T.LongType()),
                       *[T.StructField(f"{k}_{c}", t) for k in ("mn", "mx", "na", "no")
                         for c, t in (("key", T.DoubleType()), ("a", T.LongType()), ("b", T.LongType()), ("score", T.DoubleType()))]])


def _tile_stats(label: str):
    def fn(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """One row: numbers of pairs, sums of differences to the mean, the least, greatest and nearest pairs, the
        least pair without a score."""
        names = [label, *_STATS.names]
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in names}, dtype=object)
        tile, mean = _Tile(left, right), left["avg_score"].iloc[0]
        mean = np.nan if mean is None else float(mean)
        base = mean if mean == mean else 0.0
        n = scored = 0
        d = dd = 0.0
        mn = mx = na = no = None
        for at, s, pair in tile.slices():
            n += int(pair.sum())
            none = pair & np.isnan(s)
            if none.any():
                i, j = np.nonzero(none)
                a, b = tile.ends(i + at, j)
                k = np.lexsort((b, a))[0]
                no = min(x for x in (no, (0.0, int(a[k]), int(b[k]), None)) if x is not None)
                pair = pair & ~none
            count = int(pair.sum())
            if not count:
                continue
            scored += count
            gap = np.where(pair, s - base, 0.0)
            d, dd = d + float(gap.sum()), dd + float((gap * gap).sum())
            mn = tile.least(at, np.where(pair, s, np.inf), lambda x: x, mn)
            mx = tile.least(at, np.where(pair, -s, np.inf), lambda x: -x, mx)
            if mean == mean:
                na = tile.least(at, np.where(pair, np.abs(gap), np.inf), lambda x: np.abs(x - mean), na)
        row = [left[label].iloc[0], n, d, dd, scored]
        for found in (mn, mx, na, no):
            row += list(found or (None,) * 4)
        out = pd.DataFrame([row], columns=names)
        out[label] = out[label].astype(object)
        for c in names[5:]:
            out[c] = out[c].astype("Int64" if c[-2:] in ("_a", "_b") else "Float64")
        return out
    return fn


def _cosine_stats(df: DataFrame, label: str, id_col: str, feat: str, means: DataFrame, block: int) -> DataFrame:
    """The aggregates of :func:`pair_score_stats` for cosines, from a row of each block pair."""
    rows, tiles = _block_pairs(df, label, id_col, feat, block)
    tiles = tiles.join(means.select(label, "avg_score"), label, "left")
    schema = T.StructType([df.schema[label], *_STATS.fields])
    got = _over_blocks(rows, tiles, label, _tile_stats(label), schema).join(means.select(label, "avg_score"), label, "left")

    def pair(kind: str, a: Column, b: Column, score: Column) -> Column:
        return F.struct(score.alias("score"), a.alias("a"), b.alias("b"))

    c = F.col
    nothing = F.lit(None).cast("double")
    mn = F.when(c("no_a").isNotNull(), pair("no", c("no_a"), c("no_b"), nothing)).when(
        c("mn_a").isNotNull(), pair("mn", c("mn_a"), c("mn_b"), c("mn_score")))
    mx = F.when(c("mx_a").isNotNull(), pair("mx", -c("mx_a"), -c("mx_b"), c("mx_score"))).when(
        c("no_a").isNotNull(), pair("no", -c("no_a"), -c("no_b"), nothing))
    na = F.when(c("na_a").isNotNull(), F.struct(c("na_key").alias("gap"), c("na_a").alias("a"), c("na_b").alias("b"),
                                                c("na_score").alias("score")))
    shift = F.try_divide(F.sum("d"), F.sum("scored"))
    return got.filter("n > 0").groupBy(label).agg(
        F.sum("n").alias("n_pairs"), (F.coalesce(F.first("avg_score", True), F.lit(0.0)) + shift).alias("avg_score"),
        F.greatest(F.lit(0.0), F.try_divide(F.sum("dd"), F.sum("scored")) - shift * shift).alias("var_score"),
        F.min(mn).alias("_mn"), F.max(mx).alias("_mx"), F.min(na).alias("_na"))


def cosine_means(df: DataFrame, label: str, feat: str) -> DataFrame:
    """(label, avg_score): the mean cosine of a cluster's pairs without forming them.

    With unit vectors u the pairs' cosines add up to (|sum u|^2 - n) / 2; vectors of zeros have no cosine."""
    unit = df.select(label, V.norm(feat).alias("_norm"), F.col(feat).cast("array<double>").alias("_v")).filter("_norm > 0")
    cells = (unit.select(label, "_norm", F.posexplode("_v").alias("_dim", "_x"))
             .groupBy(label, "_dim").agg(F.sum(F.col("_x") / F.col("_norm")).alias("_s"), F.count(F.lit(1)).alias("_n")))
    total = cells.groupBy(label).agg(F.sum(F.col("_s") * F.col("_s")).alias("_s2"), F.max("_n").alias("_n"))
    return total.filter("_n > 1").select(label, ((F.col("_s2") - F.col("_n")) / (F.col("_n") * (F.col("_n") - 1))).alias("avg_score"))


def pair_score_stats(df: DataFrame, label: str, id_col: str, feat: str,
                     score: ScoreFn = V.cosine, tile_rows: int = 2048, means: DataFrame | None = None) -> DataFrame:
    """M14 + A8 + A9: per cluster the mean, population variance, the min and max
    pairs, and the pair whose score is closest to the mean (absolute distance;
    ties -> smallest ids).  Clusters of one member get a row with NULL stats.

    ``means`` (label, avg_score), where they follow from less than the pairs (:func:`cosine_means`), save
    the pass over all pairs that only finds them.
    """
    if score is V.cosine:
        # the least and nearest pairs need the mean first
        means = cut_lineage(cosine_means(df, label, feat) if means is None else means)
        return _described(df, label, _cosine_stats(df, label, id_col, feat, means, BLOCK))
    a, b = f"{id_col}_a", f"{id_col}_b"
    sc = pair_scores(df, label, id_col, feat, score, tile_rows)
    if means is None:
        means = sc.groupBy(label).agg(F.avg("score").alias("avg_score"))
    key_min = F.struct(F.col("score").alias("score"), F.col(a).alias("a"), F.col(b).alias("b"))
    key_max = F.struct(F.col("score").alias("score"), (-F.col(a)).alias("a"),
                       (-F.col(b)).alias("b"))
    key_near = F.struct(F.abs(F.col("score") - F.col("avg_score")).alias("gap"), F.col(a).alias("a"),
                        F.col(b).alias("b"), F.col("score").alias("score"))
    out = sc.join(means.select(label, "avg_score"), label, "left").groupBy(label).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg("score").alias("avg_score"),
        F.var_pop("score").alias("var_score"),
        F.min(key_min).alias("_mn"),
        F.max(key_max).alias("_mx"),
        F.min(F.when(key_near["gap"].isNotNull(), key_near)).alias("_na"),
    )
    return _described(df, label, out)


def _described(df: DataFrame, label: str, out: DataFrame) -> DataFrame:
    """The aggregates as columns; clusters without pairs have a row too."""
    labels = df.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    out = labels.join(out, label, "left")
    return out.select(
        label, "size", F.coalesce(F.col("n_pairs"), F.lit(0)).alias("n_pairs"),
        "avg_score", "var_score",
        F.col("_mn.score").alias("min_score"), F.col("_mn.a").alias("min_a"),
        F.col("_mn.b").alias("min_b"),
        F.col("_mx.score").alias("max_score"), (-F.col("_mx.a")).alias("max_a"),
        (-F.col("_mx.b")).alias("max_b"),
        F.col("_na.a").alias("near_avg_a"), F.col("_na.b").alias("near_avg_b"),
        F.col("_na.score").alias("near_avg_score"))


def _tile_bins(label: str, bins: int):
    def fn(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """(label, bin, held): pairs by bin of their score to nine places; those without a score have no bin."""
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in (label, "bin", "held")}, dtype=object)
        tile = _Tile(left, right)
        held, none = np.zeros(2 * bins + 2, np.int64), 0
        for _, s, pair in tile.slices():
            pair, missing = pair & ~np.isnan(s), int((pair & np.isnan(s)).sum())
            none += missing
            held += np.bincount(_bins(s[pair], bins) + bins, minlength=len(held))
        at = np.flatnonzero(held)
        out = pd.DataFrame({"bin": pd.array(at - bins, dtype="Int64"), "held": held[at]})
        if none:
            out = pd.concat([out, pd.DataFrame({"bin": pd.array([None], dtype="Int64"), "held": [none]})])
        out.insert(0, label, np.full(len(out), left[label].iloc[0], dtype=object))
        return out
    return fn


def _bins(score: np.ndarray, bins: int) -> np.ndarray:
    """Bins -bins to bins; a cosine may pass one by its last places."""
    return np.clip(np.floor(np.round(score, 9) * bins), -bins, bins).astype(np.int64)


def _tile_members(label: str, bins: int, names: list[str]):
    def fn(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The pairs of the wanted bins."""
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in names}, dtype=object)
        tile, wanted, out = _Tile(left, right), np.asarray(left["bins"].iloc[0], np.int64), []
        some = np.zeros(2 * bins + 2, bool)
        some[wanted + bins] = True
        for at, s, pair in tile.slices():
            i, j = np.nonzero(pair & ~np.isnan(s))
            score = s[i, j]
            bin_ = _bins(score, bins)
            keep = some[bin_ + bins]
            a, b = tile.ends(i[keep] + at, j[keep])
            out.append(pd.DataFrame({names[1]: bin_[keep], names[2]: a, names[3]: b, names[4]: np.round(score[keep], 9)}))
        got = pd.concat(out)
        got.insert(0, label, np.full(len(got), left[label].iloc[0], dtype=object))
        return got
    return fn


def pair_score_examples(df: DataFrame, label: str, id_col: str, feat: str,
                        score: ScoreFn = V.cosine, examples: int = 3, bins: int = 4096,
                        tile_rows: int = 2048) -> DataFrame:
    """Per cluster the pairs just above the lowest score (``low``), the middle three
    (``mid``) and those just below the highest (``high``); ``examples // 3`` at either end.

    Pairs are ranked by (score to nine places, ids), but neither sorted nor stored as a
    whole: a histogram of ``bins`` steps per unit of score (partial aggregates) tells
    which bins hold the wanted ranks, and only their pairs are ranked, split over
    tasks by :func:`group_rank`.  A pair in two zones of a small cluster comes twice;
    clusters without pairs have no row.
    """
    a, b = f"{id_col}_a", f"{id_col}_b"
    k = examples // 3
    blocks = None
    if score is V.cosine:
        blocks = rows, tiles = _block_pairs(df, label, id_col, feat, BLOCK)
        schema = T.StructType([df.schema[label], T.StructField("bin", T.LongType()), T.StructField("held", T.LongType())])
        held = _over_blocks(rows, tiles, label, _tile_bins(label, bins), schema).groupBy(label, "bin").agg(F.sum("held").alias("held"))
    else:
        pairs = (pair_scores(df, label, id_col, feat, score, tile_rows).withColumn("score", F.round("score", 9))
                 .withColumn("bin", F.floor(F.col("score") * bins)))
        held = pairs.groupBy(label, "bin").agg(F.count(F.lit(1)).alias("held"))
    up_to = Window.partitionBy(label).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(label, "bin", "held", F.coalesce(F.sum("held").over(up_to), F.lit(0)).alias("before"),
                       F.sum("held").over(Window.partitionBy(label)).alias("n"))
    mid = F.floor(F.col("n") / 2)

    def zone(name, first, end):
        first, end = F.greatest(first, F.lit(0)), F.least(end, F.col("n"))
        ranks = F.when(first < end, F.sequence(first.cast("bigint"), end.cast("bigint") - 1))
        return F.transform(ranks, lambda r: F.struct(F.lit(name).alias("zone"), r.alias("rank")))

    empty = F.array().cast("array<struct<zone:string,rank:bigint>>")
    zones = F.concat(*[F.coalesce(z, empty) for z in (
        zone("low", F.lit(1), F.lit(1 + k)), zone("mid", mid - 1, mid + 2),
        zone("high", F.col("n") - 1 - k, F.col("n") - 1))])
    wanted = held.select(label, "bin", "before", "held", F.explode(zones).alias("w")).filter(
        (F.col("w.rank") >= F.col("before")) & (F.col("w.rank") < F.col("before") + F.col("held")))
    wanted = cut_lineage(wanted.select(label, "bin", "before", "w.zone", "w.rank"))
    if blocks:
        # at most as many bins of a cluster as ranks are wanted
        tiles = tiles.join(wanted.filter("bin is not null").groupBy(label).agg(F.array_sort(F.collect_set("bin")).alias("bins")), label)
        schema = T.StructType([df.schema[label], T.StructField("bin", T.LongType()), T.StructField(a, T.LongType()),
                               T.StructField(b, T.LongType()), T.StructField("score", T.DoubleType())])
        # group_rank reads its input twice: to sample the ranges, and to deal the rows
        near = cut_lineage(_over_blocks(rows, tiles, label, _tile_members(label, bins, schema.names), schema))
    else:
        near = pairs.join(wanted.select(label, "bin").distinct(), [label, "bin"])
    ranked = group_rank(near, [label, "bin"], ["score", a, b], name="_at")
    return ranked.join(wanted, [label, "bin"]).filter(F.col("before") + F.col("_at") == F.col("rank")).select(
        label, "zone", "rank", F.col(a).alias("a"), F.col(b).alias("b"), "score")
