"""Benchmark decontamination: BM25 over an inverted index of the test items, searched with
block-max WAND by every passage of every document.

Words are lower-cased runs of letters and digits.  A passage is ``2 * stride`` words, a new
one every ``stride`` words, where the stride is the longest item's length: an item of the
text lies whole in one passage.  A posting's impact is its BM25 weight divided by the item's
score against itself, so a score is 1 where all of an item's words occur and the threshold
means the same for all items.  Postings are in blocks of consecutive items with their
largest impact.  A first step adds these block maxima for all passages of a batch at once (the rarer
terms' lists; an item's common terms count in full) and drops passages that can't reach the
threshold in any block.  The others run the pivoting traversal.  Every item retrieved is
verified: at least half of the five-word shingles of its question and of its answer
must occur in the passage.  The question of an item goes to its last question mark, or else is its first half.

The index is built in shards of at most about ``SHARD_BYTES`` of item text, dealt by a hash
of the item's id and text; item counts of terms, the mean length and the stride are those of the whole benchmark, so scores
don't depend on the shards.  A Spark task builds a shard's index and writes it to the shared folder; every
shard is searched by all passages.  A scoring task takes about ``GROUP_BYTES`` of text at a time and opens
one shard after the other, so it holds one index; documents are read once.

Defined cases: null and empty texts and items match nothing; items that occur twice each
match; repeated documents each give their rows; a null item id is reported as null.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left
from functools import lru_cache
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import shared
from reviewlens.llm import textbatch as tb

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.5
SHINGLE = 5
BLOCK = 2  # items; small blocks keep the sums of maxima close to the scores
RARE = 8  # items at most, for a list that is screened
SHARD_BYTES = 512 << 10
SHORTEST_STRIDE = 32
GROUP_BYTES = 12 << 20

_KIND = np.zeros(256, np.uint8)
_KIND[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = 1


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = tb.runs(_KIND[data], offs)
    return tb.Spans(tb.LOWER[data]).hash(starts, ends), bounds


def _shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of five-word shingles; of the whole where there are fewer words."""
    n = min(SHINGLE, len(hashes))
    return tb.grams(hashes, np.array([0, len(hashes)]), n)[0] if n else np.zeros(0, np.uint64)


class Statistics(NamedTuple):
    """Of the whole benchmark: number of items, their mean and largest number of words, and, for the terms of one
    shard in order, the number of items that hold each."""
    items: int
    mean_length: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


class Index:
    """Postings of one shard: lists by term, in item order, with block maxima; weights are those of the whole benchmark."""

    def __init__(self, items: list[tuple[int | None, str]], whole_of: Statistics):
        self.ids = [i for i, _ in items]
        column = pa.array([t for _, t in items], pa.string())
        hashes, bounds = _words(*tb.utf8(column))
        self.stride = max(SHORTEST_STRIDE, whole_of.longest)
        self.parts = []
        for k, (_, text) in enumerate(items):
            own = hashes[bounds[k]:bounds[k + 1]]
            cut = -(-len(own) // 2)
            mark = (text or "").rfind("?")
            if mark >= 0:
                asked = len(_words(*tb.utf8(pa.array([text[:mark]])))[0])
                cut = asked if 0 < asked < len(own) else cut
            self.parts.append((_shingles(own[:cut]), _shingles(own[cut:])))
        item = tb.rows_of(bounds)
        order = np.lexsort((item, hashes))
        hashes, item = hashes[order], item[order]
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1])
        tf = np.diff(np.append(np.flatnonzero(first), len(hashes)))
        hashes, item = hashes[first], item[first]
        self.terms, begin, df = np.unique(hashes, return_index=True, return_counts=True)
        self.begin = np.append(begin, len(hashes))
        self.df = df
        n = len(items)
        length = np.diff(bounds)[item]
        every = whole_of.df[np.searchsorted(whole_of.terms, self.terms)]
        idf = np.log(1 + (whole_of.items - every + 0.5) / (every + 0.5))
        weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(whole_of.mean_length, 1)))
        whole = np.bincount(item, weights=weight, minlength=n)
        self.item, self.impact = item, weight / np.maximum(whole[item], 1e-12)
        term = np.repeat(np.arange(len(df)), df)
        self.top = np.zeros(len(df))
        np.maximum.at(self.top, term, self.impact)
        # block maxima of each list, and what an item's common terms add at most
        self.blocks = max(1, -(-n // BLOCK))
        key = term * self.blocks + item // BLOCK
        self.block_key, at = np.unique(key, return_inverse=True)
        self.block_max = np.zeros(len(self.block_key))
        np.maximum.at(self.block_max, at, self.impact)
        self.block_begin = np.searchsorted(self.block_key, np.arange(len(df) + 1) * self.blocks)
        common = df > RARE
        rest = np.bincount(item, weights=self.impact * common[term], minlength=self.blocks * BLOCK)
        self.common_mass = rest.reshape(self.blocks, BLOCK).max(1)
        self.rare = ~common
        # the traversal steps through single postings: plain lists and dicts
        self.steps = item.tolist()
        self.gains = self.impact.tolist()
        self.block_of = [dict() for _ in df]
        for k, v in zip(self.block_key.tolist(), self.block_max.tolist()):
            self.block_of[k // self.blocks][k % self.blocks] = v

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term of each word, -1 for others."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == hashes, at, -1)

    def screen(self, passage: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Passages that can reach the threshold in some block, by block maxima."""
        use = self.rare[term]
        passage, term = passage[use], term[use]
        lo, sizes = self.block_begin[term], self.block_begin[term + 1] - self.block_begin[term]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(lo - (ends - sizes), sizes) + np.arange(total)
        cell = np.repeat(passage, sizes) * self.blocks + self.block_key[at] % self.blocks
        bound = np.bincount(cell, weights=self.block_max[at], minlength=n * self.blocks).reshape(n, self.blocks)
        return np.flatnonzero((bound + self.common_mass >= THRESHOLD - 1e-9).any(1))

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: (item, score) of all items at or above the threshold."""
        steps, gains = self.steps, self.gains
        lists = [[steps[self.begin[t]], int(self.begin[t]), int(self.begin[t + 1]), float(self.top[t]),
                  self.block_of[t]] for t in terms]  # next item, its place, end, largest impact, block maxima
        need, found = THRESHOLD - 1e-9, []
        while lists:
            lists.sort(key=itemgetter(0))
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[3]
                if bound >= need:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            head = lists[:pivot + 1]
            block = item // BLOCK
            if sum([x[4].get(block, 0.0) for x in head]) < need:
                # no item up to the end of the block, or up to the next list's item, can reach it
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    goal = min(goal, lists[pivot + 1][0])
            elif head[0][0] == item:
                score = sum([gains[x[1]] for x in head])
                if score >= need:
                    found.append((item, score))
                goal = item + 1
            else:
                goal = item
            ended = False
            for x in head:
                if x[0] < goal:
                    x[1] = bisect_left(steps, goal, x[1], x[2])
                    if x[1] < x[2]:
                        x[0] = steps[x[1]]
                    else:
                        ended = True
            if ended:
                lists = [x for x in lists if x[1] < x[2]]
        return found

    def matches(self, column: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap), verified, each pair once."""
        hashes, bounds = _words(*tb.utf8(column))
        term = self.lookup(hashes)
        row = tb.rows_of(bounds)
        sizes = np.diff(bounds)
        per = np.maximum(1, -(-sizes // self.stride) - 1)
        base = np.cumsum(per) - per
        known = np.flatnonzero(term >= 0)
        slot = (known - bounds[row[known]]) // self.stride
        here, before = slot < per[row[known]], slot > 0
        key = np.concatenate([
            (base[row[known]] + slot)[here] * len(self.terms) + term[known][here],
            (base[row[known]] + slot - 1)[before] * len(self.terms) + term[known][before]])
        if not len(key):
            return []
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])]
        passage, term = key // len(self.terms), key % len(self.terms)
        cuts = np.searchsorted(passage, np.arange(int(per.sum()) + 1))
        owner = np.repeat(np.arange(len(sizes)), per)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for p in self.screen(passage, term, int(per.sum())).tolist():
            r = int(owner[p])
            found = self.search(term[cuts[p]:cuts[p + 1]].tolist())
            if not found:
                continue
            at = int(bounds[r]) + (p - int(base[r])) * self.stride
            own = np.unique(_every(hashes[at:min(at + 2 * self.stride, int(bounds[r + 1]))], range(1, SHINGLE + 1)))
            for item, score in found:
                asked, answered = (float(np.isin(x, own).mean()) if len(x) else 1.0 for x in self.parts[item])
                if asked >= OVERLAP and answered >= OVERLAP:
                    best[r, item] = max(best.get((r, item), (0.0, 0.0, 0.0)), (score, asked, answered))
        return [(r, item, *x) for (r, item), x in sorted(best.items())]


def _every(hashes: np.ndarray, sizes: range) -> np.ndarray:
    """Shingles of all the given sizes (parts of items may be shorter than five words)."""
    bounds = np.array([0, len(hashes)])
    return np.concatenate([tb.grams(hashes, bounds, n)[0] for n in sizes])


@lru_cache(maxsize=1)
def _loaded(folder: str, name: str) -> Index:
    with shared.opened(folder)[0].open_input_file(name) as source:
        return pickle.loads(pq.ParquetFile(source).read(["index"]).column(0)[0].as_py())


class Shards:
    """The indexes of a benchmark: files in the shared folder, opened one at a time."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names

    def __len__(self) -> int:
        return len(self.names)

    def __getitem__(self, k: int) -> Index:
        return _loaded(self.folder, self.names[k])


def build(benchmark: DataFrame, text: str = "text", key: str = "item_id") -> Shards:
    """One index per shard, each from at most about SHARD_BYTES of items."""
    items = benchmark.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("key", "text"), F.lit(shards)).cast("int"))

    def words(batches):
        """Each item's number of words, and its different terms."""
        for batch in batches:
            for part in tb.chunks(batch, "text"):
                hashes, bounds = _words(*tb.utf8(part.column("text")))
                shard = part.column("shard").to_numpy()
                terms = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                row = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
                yield _terms(shard, None, np.diff(bounds))
                yield _terms(shard[row], np.concatenate(terms).view(np.int64), None)

    def _terms(shard, term, length):
        null = pa.nulls(len(shard), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(shard, pa.int32()), null if term is None else pa.array(term, pa.int64()),
             null if length is None else pa.array(length, pa.int64())], ["shard", "term", "length"])

    found = shared.written(dealt.mapInArrow(words, "shard int, term long, length long"), "decontaminate-terms")
    n, mean, longest = found.filter(F.col("length").isNotNull()).agg(
        F.count(F.lit(1)), F.avg("length"), F.max("length")).first()
    held = found.filter(F.col("term").isNotNull())
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    own = held.select("shard", "term").distinct().join(df, "term").select(
        "shard", F.col("term").alias("key"), F.lit(None).cast("string").alias("text"), "df")

    def index(rows, terms):
        rows.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        order = np.array(sorted(terms), np.int64).reshape(-1, 2)
        term = order[:, 0].view(np.uint64) if len(order) else np.zeros(0, np.uint64)
        up = np.argsort(term)
        built = Index(rows, Statistics(n, mean, longest, term[up], order[up, 1]))
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(built)], pa.binary())], ["index"])

    def run(batches):
        """A shard's terms come before its items."""
        now, rows, terms = None, [], []
        for batch in batches:
            for shard, key_, text_, many in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "text", "df"))):
                if shard != now:
                    if rows:
                        yield index(rows, terms)
                    now, rows, terms = shard, [], []
                if many is not None:
                    terms.append((key_, many))
                else:
                    rows.append((key_, text_))
        if rows:
            yield index(rows, terms)

    folder = shared.new_folder(benchmark.sparkSession, "decontaminate-index")
    both = own.unionByName(dealt.withColumn("df", F.lit(None).cast("long")))
    (both.repartition(shards, "shard").sortWithinPartitions("shard", F.asc_nulls_last("df")).mapInArrow(run, "index binary")
     .write.option("maxRecordsPerFile", 1).parquet(folder))
    system, root = shared.opened(folder)
    names = sorted(x.path for x in system.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet"))
    return Shards(folder, [x for x in names if pq.read_metadata(x, filesystem=system).num_rows])


_PAIRS = ("doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def _found(group: pa.RecordBatch, text: str, indexes: Shards):
    """(first row, part, index, matches) of a group's parts, shard by shard."""
    for k in range(len(indexes)):
        own, first = indexes[k], 0
        for part in tb.chunks(group, text):
            yield first, part, own, own.matches(part.column(text))
            first += part.num_rows


def contaminated(docs: DataFrame, indexes: Shards, text: str = "text") -> DataFrame:
    """One row per document and verified item: doc_id, item_id, score and the overlaps."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            for group in tb.chunks(batch, "text", GROUP_BYTES):
                for _, part, own, found in _found(group, "text", indexes):
                    if found:
                        row, item, *rest = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(pa.array(row)),
                             pa.array([own.ids[i] for i in item], pa.int64()), *map(pa.array, rest)],
                            ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return source.mapInArrow(run, _PAIRS)


def clean_documents(docs: DataFrame, indexes: Shards, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a verified item, with all their columns."""
    def run(batches):
        for batch in batches:
            for group in tb.chunks(batch, text, GROUP_BYTES):
                keep = np.ones(group.num_rows, bool)
                for first, _, _, found in _found(group, text, indexes):
                    keep[[first + m[0] for m in found]] = False
                yield group.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
