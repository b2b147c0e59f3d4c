"""Similarity join on word shingles with adaptive multi-match prefixes.

A document is its set of distinct ``size``-word shingles (64-bit hashes); equal sets are one
entity.  All sets are sorted in one order, rare shingles first.  Two sets with a Jaccard
similarity of ``percent`` per cent or more share at least l shingles among the first
n - ceil(percent n / 100) + l of either, for every l up to that overlap.  Each set chooses
its own l: the longer prefix costs more postings, but a candidate then has to share l of
them.  The cost is estimated from the lengths of the posting lists.  Two sets that link have an overlap o
that follows from their sizes, and the first o - ceil(percent n / 100) + l of their common shingles lie in
the prefix of a set of n: a pair is a candidate when it shares as many as that gives for both, and is then
verified on the whole sets.

Since only components are asked for, pairs inside one aren't formed.  Sets are first
compared with the leaders of their home list (the posting list of their first shingle
that another set has); next, a few pairs for each two components that meet in lists; then pairs within small
parts of lists; and at last all candidate pairs between sets that are still in different components, which makes
the result whole.  Before a pair's sets are moved, their parity maps are compared (bit i:
whether an odd number of shingles have remainder i).  Bits that differ are at most
as many as the shingles that only one set has, so no link is lost.  The order's frequencies are those of at most ``COMMON`` shingles that are
frequent among AT_ONCE of a task; any order is right, a better one only shortens lists.

Defined cases: texts without words (null, empty) have no shingle and are their own
component; repeated rows and equal ids fall together; a null id takes part, and is reported
as null where no other document is linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm import bloom, shared
from reviewlens.llm import textbatch as tb
from reviewlens.llm.components import components

SHINGLE = 4
PERCENT = 85
STEPS = 4  # l is one of 1 to STEPS, or the longest
GROWTH = 5  # per cent of a set's size by which its longest prefix grows beyond that of STEPS
VERIFY = 20  # cost of a verification in postings
COMMON = 1 << 19
LEADERS = 24
HOME = 1 << 10  # sets of a home list that one task compares with its leaders
AT_ONCE = 4_000_000  # shingles that a task counts together
MET = 4  # lists in which those pairs meet, at least
TRIED = (3, 8)  # pairs for each two components in the turns of the second step
LARGE = 256
FIRST = 3  # partners that each set tries before the rest
DEALS, PART = 2, 16  # turns of the third step, and sets in a part of a list
PARITY = 4  # bits of a set's parity map per shingle, at least
SKETCH = 256  # bits of the map that goes with postings
WORDS = [f"w{i}" for i in range(SKETCH // 64)]


def overlap(n, percent: int = PERCENT):
    """Least overlap of a set of n with a partner."""
    return -(-percent * n // 100)


def longest(n):
    """Largest l of a set of n."""
    return STEPS + GROWTH * n // 100


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row), unsorted, with repeats; a text of fewer words is one shingle."""
    data, offs = tb.utf8(column)
    starts, ends, bounds = tb.words(data, offs)
    hashes = tb.Spans(tb.LOWER[data]).hash(starts, ends)
    out = [tb.grams(hashes, bounds, size)]
    count = np.diff(bounds)
    for n in range(1, size):
        few = np.flatnonzero(count == n)
        key = np.zeros(len(few), np.uint64) + np.uint64(n)
        for k in range(n):
            key = tb.mix(key * np.uint64(0x9E3779B97F4A7C15) + hashes[bounds[few] + k])
        out.append((key, few))
    return np.concatenate([h for h, _ in out]), np.concatenate([r for _, r in out])


def _sets(column: pa.Array, common: tuple[np.ndarray, np.ndarray] | None, size: int):
    """(shingles in order, bounds by row, set id by row)."""
    hashes, rows = shingles(column, size)
    if common is not None and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
        weight = np.where(common[0][at] == hashes, common[1][at], 0)
        order = np.lexsort((hashes, weight, rows))
    else:
        order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    bounds = np.searchsorted(rows, np.arange(len(column) + 1))
    total = np.append(np.uint64(0), np.cumsum(tb.mix(hashes), dtype=np.uint64))
    ids = tb.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))
    return hashes, bounds, ids.view(np.int64)


def _common(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles (sorted) and their counts; at most COMMON."""
    def count(batches):
        seen, held = [], 0
        for batch in batches:
            for part in tb.chunks(batch, "text"):
                hashes, bounds, ids = _sets(part.column("text"), None, size)
                once = np.zeros(part.num_rows, bool)
                once[np.unique(ids, return_index=True)[1]] = True
                seen.append(hashes[once[tb.rows_of(bounds)]])
                held += len(seen[-1])
                if held >= AT_ONCE:
                    yield _frequent(seen)
                    seen, held = [], 0
        if seen:
            yield _frequent(seen)
        tb.trim()

    top = (docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle")
           .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow())
    keys = top.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top.column("n").to_numpy()[order]


def _frequent(seen: list[np.ndarray]) -> pa.RecordBatch:
    keys = np.concatenate(seen)
    keys.sort()
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    n = np.diff(np.append(begin, len(keys)))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[begin[n > 3]].view(np.int64)), pa.array(n[n > 3])], ["shingle", "n"])


def _prefixes(docs: DataFrame, common, size: int, percent: int) -> DataFrame:
    """One row per document: doc_id, set, n and the longest prefix (once per batch and set)."""
    shared_order = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for batch in batches:
            for part in tb.chunks(batch, "text"):
                hashes, bounds, ids = _sets(part.column("text"), shared_order.value, size)
                n = np.diff(bounds)
                first = np.zeros(part.num_rows, bool)
                first[np.unique(ids, return_index=True)[1]] = True
                length = np.where(first, np.minimum(n, n - overlap(n, percent) + longest(n)), 0)
                ends = np.cumsum(length)
                at = np.repeat(bounds[:-1] - (ends - length), length) + np.arange(int(ends[-1]))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(0, ends).astype(np.int32)), pa.array(hashes[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids), pa.array(n), lists], ["doc_id", "set", "n", "prefix"])
        tb.trim()

    return shared.written(docs.mapInArrow(run, "doc_id long, set long, n long, prefix array<long>"), "ngram-prefixes")


def _postings(rows: DataFrame) -> DataFrame:
    """(shingle, set, n, place, length): lists of two or more sets."""
    each = rows.filter(F.size("prefix") > 0).select("set", "n", F.posexplode("prefix").alias("place", "shingle"))
    packed = each.select("shingle", "set", (F.shiftleft("n", 32) + F.col("place")).alias("packed"))
    several = packed.groupBy("shingle").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).filter("lo <> hi")
    several = shared.written(several.select("shingle"), "ngram-several")  # tables, so that the joins can split a hot list
    # a set comes once from each batch it is in
    once = shared.written(packed.join(several, "shingle", "left_semi").groupBy("shingle", "set").agg(
        F.min("packed").alias("packed")), "ngram-shared")
    lengths = shared.written(once.groupBy("shingle").agg(F.count(F.lit(1)).alias("length")), "ngram-lengths")
    return shared.written(once.join(lengths, "shingle").select(
        "shingle", "set", F.shiftright("packed", 32).alias("n"),
        F.col("packed").bitwiseAND(F.lit((1 << 32) - 1)).alias("place"), "length"), "ngram-postings")


def _need(n, percent: int):
    return F.ceil(n * percent / 100)


def _chosen(postings: DataFrame, percent: int) -> DataFrame:
    """Each set's l by estimated cost, and how many shingles of its longest prefix no other prefix has.

    Partners share as many shingles of their longest prefixes as the smaller of the two largest l
    (or the whole overlap, if that is less), so sets with fewer shared ones have none and go.  The
    larger set's l may be one more than that, as sizes are rounded.
    """
    need = _need(F.col("n"), percent)
    most = F.lit(STEPS) + F.floor(F.col("n") * GROWTH / 100)
    sums = [F.sum(F.when(F.col("place") < F.col("n") - need + k, F.col("length") - 1).otherwise(0)).alias(f"s{k}")
            for k in range(1, STEPS + 1)]
    per_set = postings.groupBy("set", "n").agg(
        *sums, F.sum(F.col("length") - 1).alias("all"), F.count(F.lit(1)).alias("shared"))
    per_set = per_set.filter(F.col("shared") >= F.least(most - 1, need))
    cost = [F.struct((F.col(f"s{k}") * (1 + VERIFY / k)).alias("cost"), F.lit(k).cast("long").alias("l"))
            for k in range(1, STEPS + 1)]
    cost.append(F.struct((F.col("all") * (1 + VERIFY / most)).alias("cost"), most.cast("long").alias("l")))
    usable = F.filter(F.array(*cost), lambda c: (c["l"] == 1) | (c["l"] <= need))
    return per_set.select("set", "n", F.array_min(usable)["l"].alias("l"),
                          (F.least(F.col("n"), F.col("n") - need + most) - F.col("shared")).alias("lone"))


def _lists(postings: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """Postings within each set's own prefix, of lists of two and more sets; own: how many a set has."""
    own = (postings.select("shingle", "set", "n", "place").join(chosen.select("set", "l", "lone"), "set")
           .filter(F.col("place") < F.col("n") - _need(F.col("n"), percent) + F.col("l")))
    own = shared.written(own, "ngram-own")
    lengths = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("length")).filter("length > 1")
    kept = shared.written(own.join(lengths, "shingle"), "ngram-several")
    return shared.written(kept.join(kept.groupBy("set").agg(F.count(F.lit(1)).alias("own")), "set"), "ngram-lists")


def _contents(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(set, n, parity, content, sketch words): parity map and sorted shingles of the wanted sets and
    of a few more, once per batch that a set is in."""
    spark = docs.sparkSession
    keep = spark.sparkContext.broadcast(bloom.build(wanted, "set", wanted.count()))

    def run(batches):
        for batch in batches:
            for part in tb.chunks(batch, "text"):
                hashes, bounds, ids = _sets(part.column("text"), None, size)
                first = np.zeros(part.num_rows, bool)
                first[np.unique(ids, return_index=True)[1]] = True
                use = np.flatnonzero(first & keep.value.has(ids) & (np.diff(bounds) > 0))
                own = [hashes[bounds[i]:bounds[i + 1]] for i in use]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[use]), pa.array(np.diff(bounds)[use]), pa.array(map(parity, own), pa.binary()),
                     pa.array((x.tobytes() for x in own), pa.binary()), *map(pa.array, sketches(own))],
                    ["set", "n", "parity", "content", *WORDS])
        tb.trim()

    return shared.written(docs.select("text").mapInArrow(run, "set long, n long, parity binary, content binary, " + ", ".join(f"{w} long" for w in WORDS)),
                          "ngram-contents")


def parity(hashes: np.ndarray) -> bytes:
    """Bit i: whether the number of hashes with remainder i by the map's length is odd."""
    length = max(64, 1 << (PARITY * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(length - 1)).astype(np.int64), minlength=length) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity maps of SKETCH bits, as rows of longs: one row for each of WORDS."""
    at = [(x & np.uint64(SKETCH - 1)).astype(np.int64) + i * SKETCH for i, x in enumerate(sets)]
    odd = np.bincount(np.concatenate([np.zeros(0, np.int64), *at]), minlength=len(sets) * SKETCH) & 1
    bits = np.packbits(odd.astype(np.uint8), bitorder="little")
    return np.ascontiguousarray(bits.view("<i8").reshape(len(sets), len(WORDS)).T)


def may_link(na: int, a: bytes, nb: int, b: bytes, percent: int = PERCENT) -> bool:
    """Whether sets with these sizes and parity maps can link; a longer map is folded."""
    least = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, least), axis=0) for m in (a, b))
    apart = int(np.bitwise_count(a ^ b).sum())
    return 100 * (na + nb - apart) >= percent * (na + nb + apart)


def _unpack(content: bytes) -> np.ndarray:
    return np.frombuffer(content, np.uint64)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (small + large - common)


def _homes(chosen: DataFrame) -> DataFrame:
    """Each set's home list, in parts of about HOME sets where it is longer."""
    part = F.pmod(F.xxhash64("set"), F.ceil(F.col("listed") / HOME))
    home = F.when(F.col("listed") > HOME, F.xxhash64("home", part)).otherwise(F.col("home"))
    return chosen.withColumn("home", home).drop("listed")


def _led(contents: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """(set, component): sets joined to a leader of their home list, or of their part of it.

    The parity maps choose the leader, as contents are several times as large; a set whose
    contents don't link with it stays alone, for the next steps.  Sets with the fewest shingles of their own
come first, since a text that copies were made from links with more of them than a copy does.
    """
    first = lists.groupBy("set", "lone").agg(F.min_by("shingle", "place").alias("home"), F.min_by("length", "place").alias("listed"))
    rows = contents.select("set", "n", "parity").join(_homes(first), "set")
    parts = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        now, leaders, last = None, [], None
        for batch in batches:
            names, out = [], []
            for home, name, n, own in zip(*(batch.column(c).to_pylist() for c in ("home", "set", "n", "parity"))):
                if name == last:  # from another batch
                    continue
                last = name
                if home != now:
                    now, leaders = home, []
                mine = next((x for x, m, other in leaders if may_link(m, other, n, own, percent)), None)
                if mine is None:
                    leaders = [(name, n, own), *leaders][:LEADERS]
                names.append(name)
                out.append(mine)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.int64())], ["x", "y"])

    tried = shared.written(rows.repartition(parts, "home").sortWithinPartitions("home", "lone", "n", "set")
                           .select("home", "set", "n", "parity").mapInArrow(run, "x long, y long"), "ngram-led")
    links = _verified(contents, tried.filter("y IS NOT NULL"), percent)
    return shared.written(tried.select(F.col("x").alias("set")).join(
        links.select(F.col("x").alias("set"), "y"), "set", "left").select(
        "set", F.coalesce("y", "set").alias("component")), "ngram-labels")


def _some(contents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The contents of the wanted sets and of a few more, each set once."""
    keep = contents.sparkSession.sparkContext.broadcast(bloom.build(wanted, "set", wanted.count()))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(keep.value.has(batch.column("set").to_numpy())))

    return contents.mapInArrow(run, contents.schema).groupBy("set").agg(
        *[F.first(c).alias(c) for c in contents.columns if c != "set"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("set")).distinct()


def _near(contents: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parity maps allow a link, with all columns."""
    maps = _some(contents.select("set", "n", "parity"), _ends(pairs))
    columns = pairs.columns
    both = (pairs.join(maps.select(F.col("set").alias("x"), F.col("n").alias("_nx"), F.col("parity").alias("_px")), "x")
            .join(maps.select(F.col("set").alias("y"), F.col("n").alias("_ny"), F.col("parity").alias("_py")), "y"))

    def run(batches):
        for batch in batches:
            ok = [may_link(*four, percent) for four in
                  zip(*(batch.column(c).to_pylist() for c in ("_nx", "_px", "_ny", "_py")))]
            yield batch.select(columns).filter(pa.array(ok, pa.bool_()))

    return shared.written(both.mapInArrow(run, pairs.schema), "ngram-near")


def _verified(contents: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that link."""
    contents = _some(contents.select("set", "content"), _ends(pairs))
    both = (pairs.select("x", "y").join(contents.select(F.col("set").alias("x"), F.col("content").alias("cx")), "x")
            .join(contents.select(F.col("set").alias("y"), F.col("content").alias("cy")), "y"))

    def run(batches):
        for batch in batches:
            ok = [linked(_unpack(a), _unpack(b), percent)
                  for a, b in zip(batch.column("cx").to_pylist(), batch.column("cy").to_pylist())]
            yield batch.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return shared.written(both.mapInArrow(run, "x long, y long"), "ngram-links")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Join components that a link connects."""
    own = labels.select(F.col("set").alias("x"), F.col("component").alias("a"))
    other = labels.select(F.col("set").alias("y"), F.col("component").alias("b"))
    edges = links.join(own, "x").join(other, "y").select("a", "b").filter("a <> b").distinct()
    joined = components(edges).select(F.col("node").alias("component"), F.col("component").alias("new"))
    return shared.written(labels.join(joined, "component", "left").select(
        "set", F.coalesce("new", "component").alias("component")), "ngram-labels")


def _in_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists where components meet, with components."""
    own = lists.join(labels, "set")
    meet = own.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    return own.join(meet.select("shingle"), "shingle", "left_semi")


def _met(lists: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """At most TRIED[turn] pairs for each two components that meet, those in most lists first.

    Each list offers one set of a component, another one each turn.  After the first
    turn only pairs of components are tried between which LARGE or more pairs are possible.
    """
    pick = F.struct(F.xxhash64("set", F.lit(turn)).alias("h"), "set")
    ends = shared.written(lists.groupBy("shingle", "component").agg(F.min(pick)["set"].alias("set")), "ngram-ends")
    centre = ends.groupBy("shingle").agg(F.min(F.struct("component", "set")).alias("c"))
    star = ends.join(centre, "shingle").filter(F.col("component") != F.col("c.component")).groupBy(
        F.col("c.component").alias("a"), F.col("component").alias("b"),
        F.col("c.set").alias("x"), F.col("set").alias("y")).agg(F.count(F.lit(1)).alias("met"))
    star = star.filter(F.col("met") >= MET)
    if turn:
        sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
        star = (star.join(sizes.select(F.col("component").alias("a"), F.col("members").alias("na")), "a")
                .join(sizes.select(F.col("component").alias("b"), F.col("members").alias("nb")), "b")
                .filter(F.col("na") * F.col("nb") >= LARGE))
    best = Window.partitionBy("a", "b").orderBy(F.desc("met"), "x", "y")
    return star.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= TRIED[turn]).select("x", "y")


def _sketched(lists: DataFrame, contents: DataFrame) -> DataFrame:
    own = contents.groupBy("set").agg(*[F.first(w).alias(w) for w in WORDS])
    return shared.written(lists.join(own, "set"), "ngram-sketched")


def _joined(lists: DataFrame, percent: int, keys: list[str]) -> DataFrame:
    """Pairs of sets of different components that share a list, and can still link by their sizes, places and sketches.

    Before a common shingle two sets share at most what either has before it, and after
    it at most what either has left.  Their sketches differ in at most as many bits as there are shingles of one set alone.
    """
    side = ["set", "n", "l", "own", "place", "component", *WORDS]
    a = lists.select(*keys, *[F.col(c).alias(f"{c}_x") for c in side])
    b = lists.select(*keys, *[F.col(c).alias(f"{c}_y") for c in side])
    overlap_xy = F.floor((percent * (F.col("n_x") + F.col("n_y")) + 99 + percent) / (100 + percent))
    least = overlap_xy - F.greatest(*[_need(F.col(f"n_{i}"), percent) - F.col(f"l_{i}") for i in "xy"])
    here = F.least("place_x", "place_y") + F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    apart = sum((F.bit_count(F.col(f"{w}_x").bitwiseXOR(F.col(f"{w}_y"))) for w in WORDS), F.lit(0))
    fits = ((F.least("own_x", "own_y") >= least) & (here >= overlap_xy)
            & (apart <= F.col("n_x") + F.col("n_y") - 2 * overlap_xy))
    most = F.col("met") + F.least(F.col("n_x") - 1 - F.col("last_x"), F.col("n_y") - 1 - F.col("last_y"))
    return (a.join(b, keys).filter((F.col("set_x") < F.col("set_y")) & (F.col("component_x") != F.col("component_y")) & fits)
            .groupBy(F.col("set_x").alias("x"), F.col("set_y").alias("y"), "n_x", "n_y", "l_x", "l_y")
            .agg(F.count(F.lit(1)).alias("met"), F.max("place_x").alias("last_x"), F.max("place_y").alias("last_y"))
            .select("x", "y", "met", least.alias("least"), overlap_xy.alias("overlap"), most.alias("most")))


def _dealt(lists: DataFrame, percent: int, turn: int) -> DataFrame:
    """For each set the FIRST partners that it meets most often in its part of lists.

    Lists are dealt into parts of about PART sets, others each turn, so the pairs grow with the
    lists' rows; copies that a component still lacks mostly link with one of many members.
    """
    part = F.pmod(F.xxhash64("set", F.lit(turn)), F.ceil(F.col("length") / PART))
    pairs = _joined(lists.withColumn("part", part), percent, ["shingle", "part"])
    best = Window.partitionBy("x").orderBy(F.desc("met"), "y")
    return pairs.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= FIRST).select("x", "y")


def _candidates(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different components that share enough prefix shingles and can still link."""
    return _joined(lists, percent, ["shingle"]).filter("met >= least AND most >= overlap").select("x", "y", "most")


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose sets are in different components."""
    own = labels.select(F.col("set").alias("x"), F.col("component").alias("a"))
    other = labels.select(F.col("set").alias("y"), F.col("component").alias("b"))
    return pairs.join(own, "x").join(other, "y").filter("a <> b").select("x", "y", "most")


def near_duplicates(docs: DataFrame, text: str = "text", size: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = _prefixes(source, _common(source, size), size, percent)
    postings = _postings(rows)
    lists = _lists(postings, shared.written(_chosen(postings, percent), "ngram-chosen"), percent)
    contents = _contents(source, lists.select("set").distinct(), size)
    lists = _sketched(lists, contents)
    labels = _led(contents, lists, percent)
    for turn in range(len(TRIED)):
        pairs = shared.written(_met(_in_lists(lists, labels), labels, turn), "ngram-met")
        if not pairs.limit(1).count():
            break
        labels = _relabelled(labels, _verified(contents, _near(contents, pairs, percent), percent))
    for turn in range(DEALS):
        pairs = shared.written(_dealt(_in_lists(lists, labels), percent, turn), "ngram-dealt")
        if not pairs.limit(1).count():
            break
        labels = _relabelled(labels, _verified(contents, _near(contents, pairs, percent), percent))
    pairs = shared.written(_candidates(_in_lists(lists, labels), percent), "ngram-candidates")
    pairs = _near(contents, pairs, percent)
    for end in ("x", "y"):  # the likeliest partners first; what they join needs no more pairs
        if not pairs.limit(1).count():
            break
        best = Window.partitionBy(end).orderBy(F.desc("most"), "x", "y")
        first = pairs.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= FIRST)
        labels = _relabelled(labels, _verified(contents, shared.written(first.select("x", "y"), "ngram-first"), percent))
        pairs = shared.written(_between(pairs, labels), "ngram-candidates")
    if pairs.limit(1).count():
        labels = _relabelled(labels, _verified(contents, pairs, percent))

    sets = rows.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("first"))
    sets = sets.join(labels, "set", "left").withColumn("component", F.coalesce("component", "set"))
    least = sets.groupBy("component").agg(F.min("first").alias("component_id"))
    named = sets.join(least, "component").select("set", "component_id")
    return rows.select("doc_id", "n", "set").join(named, "set", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with all columns.

    Rows that share an id stay or go together; rows without an id stay.
    """
    found = near_duplicates(docs, text, size, percent)
    stays = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_stays")).distinct()
    rest = docs.filter(F.col("doc_id").isNull())
    return docs.join(stays, F.col("doc_id") == F.col("_stays"), "left_semi").unionByName(rest)
