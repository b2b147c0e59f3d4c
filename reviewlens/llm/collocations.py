"""Phrase collocations: phrases of 2 to 5 words that occur more often than their parts suggest.

Counting is by direct-address tiling, one phrase length at a time.  A phrase of m words is the
pair of its first and its last m - 1 words, two phrases of the round before that overlap; both
must be frequent, so a round looks only at the phrases that the round before found frequent,
ranked again by frequency.  The first ``HEAD`` ranks are addresses: the cell (rank of the first,
rank of the last) lies in one of (HEAD / TILE)^2 square tiles.  A task counts each tile that
gets many pairs with a dense ``bincount`` and the others as sorted coordinate lists, and hands on its cells
as sorted blocks, by bands of left ranks.  Blocks of a band are merged in rounds of ``FAN_IN`` tasks, so the
band of the commonest phrases is not summed by one task; what is below the next block is final, so a merge holds a few blocks of each
of its tasks, and a band has at most BAND x HEAD cells.
Pairs with a phrase beyond the head have no address: they are lists sorted by the pair's key, cut by
the key's upper bits into ranges, and merged in the same way.  A bitmap of bounded size leaves out most pairs with a part that is not frequent, and the join with the frequent
phrases decides.  Nothing but the head's keys, the bitmap and the scalar counts is sent to tasks or the driver.

Every occurrence in every whole text is counted: there are no caps, and pruning uses only that a
part is at least as frequent as the whole.  Words and phrases are told apart by 64-bit keys; two different
ones of n share a key with a probability of about n^2 / 2^65.  Scores are decimals of 38 digits; beyond, Spark raises an error.

Defined cases: null texts are empty; a null language is ``und``; ids are not read, and repeated rows count
each time; an empty table, or one without frequent words, gives no rows; equal scores are ordered by
count, then by the phrase's bytes; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm import bloom, shared
from reviewlens.llm import textbatch as tb

LONGEST, LEAST, TOP, SHARE = 5, 100, 2000, 100
HEAD = 1 << 16  # ranks that are addresses, at most 2^RANK_BITS
RANK_BITS = 16
TILE = 1 << 9  # ranks on one side of a tile
BAND = 1 << 7  # left ranks whose pairs are merged together
DENSE_SHARE = 8  # a tile is dense when a batch has a pair for every 8th cell
DENSE_TILES = 16  # dense tiles that a task holds (2 MB each); further ones are lists
LISTED = 1 << 20  # list entries that a task holds
FAN_IN = 64
PAIRS = 1 << 19  # pairs that are counted together
BLOCK = 1 << 13  # entries of one block
RANGE_BITS = 8  # upper bits of a key that make its range
WORDS = 1 << 17  # distinct words that a task holds

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_INSIDE = ~_BREAK
_INSIDE[[9, 32]] = False
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def join_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of the phrase whose first and last words are the phrases ``left`` and ``right``."""
    return tb.mix(left * _ODD + tb.mix(right))


class Words:
    """Words of a chunk: spans in the lower-cased bytes, keys, and which follow each other in a piece."""

    def __init__(self, part: pa.RecordBatch):
        data, offs = tb.utf8(part.column("text"))
        self.low = tb.LOWER[data]
        self.start, self.end, bounds = tb.runs(_INSIDE[data].astype(np.uint8), offs)
        self.row = tb.rows_of(bounds)
        lang, at = tb.utf8(part.column("lang"))
        langs = tb.Spans(lang).hash(at[:-1], at[1:])
        self.key = join_keys(langs[self.row], tb.Spans(self.low).hash(self.start, self.end))
        piece = np.cumsum(_BREAK[data])[self.start] + self.row if len(self.start) else self.row
        self.joined = piece[1:] == piece[:-1]

    def phrases(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, valid) of the m words from each place on."""
        keys, valid = self.key, np.ones(len(self.key), bool)
        for k in range(1, m):
            keys = join_keys(keys[:-1], keys[1:])
            valid = valid[:-1] & self.joined[k - 1:] if k > 1 else self.joined
        return keys, valid


def _chunks(batches) -> Iterator[Words]:
    for batch in batches:
        for part in tb.chunks(batch, "text"):
            words = Words(part)
            if len(words.key):
                yield part, words


def _source(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))


def count_words(source: DataFrame) -> DataFrame:
    """lang, word, key, c: every word of every language."""
    def run(batches):
        held: list[pa.Table] = []
        size = 0

        def folded():
            table = pa.concat_tables(held).combine_chunks()
            keys = table["key"].to_numpy().view(np.uint64)
            _, first, back = np.unique(keys, return_index=True, return_inverse=True)
            sums = np.zeros(len(first), np.int64)
            np.add.at(sums, back, table["c"].to_numpy())
            return table.take(pa.array(first)).set_column(3, "c", pa.array(sums))

        for part, words in _chunks(batches):
            keys, first, counts = np.unique(words.key, return_index=True, return_counts=True)
            start, end = words.start[first], words.end[first]
            offs = np.zeros(len(first) + 1, np.int32)
            np.cumsum(end - start, out=offs[1:])
            at = np.repeat(start - offs[:-1], end - start) + np.arange(offs[-1])
            text = pa.StringArray.from_buffers(len(first), pa.py_buffer(offs), pa.py_buffer(words.low[at].tobytes()))
            lang = part.column("lang").take(pa.array(words.row[first])).cast(pa.string())
            held.append(pa.table([lang, text, pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))],
                                 names=["lang", "word", "key", "c"]))
            size += len(first)
            if size > 2 * WORDS:
                held = [folded()]
                size = len(held[0])
                if size > WORDS:
                    yield from held[0].to_batches(max_chunksize=BLOCK)
                    held, size = [], 0
        if held:
            yield from folded().to_batches(max_chunksize=BLOCK)
        held = []
        tb.trim()

    counted = source.mapInArrow(run, "lang string, word string, key long, c long")
    return counted.groupBy("lang", "word").agg(F.min("key").alias("key"), F.sum("c").alias("c"))


class Tiles:
    """Counts of pairs of ranks: dense tiles, and a sorted list for the rest."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.listed = Near()

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        left, right = left.astype(np.int64), right.astype(np.int64)
        tile = (left // TILE) * (HEAD // TILE) + right // TILE
        many = np.flatnonzero(np.bincount(tile, minlength=1) >= TILE * TILE // DENSE_SHARE)
        rest = np.ones(len(tile), bool)
        for t in many.tolist():
            if t in self.dense or len(self.dense) < DENSE_TILES:
                here = tile == t
                counts = np.bincount((left[here] % TILE) * TILE + right[here] % TILE, minlength=TILE * TILE)
                self.dense[t] = self.dense[t] + counts if t in self.dense else counts
                rest &= ~here
        self.listed = Near.merged([self.listed, Near.of(left[rest], right[rest])])

    def blocks(self, with_dense: bool) -> Iterator[tuple[int, int, bytes]]:
        """Blocks of the list, and at the end of the dense tiles too; both are emptied."""
        lists = [self.listed]
        if with_dense:
            for t, counts in self.dense.items():
                cells = np.flatnonzero(counts)
                left, right = t // (HEAD // TILE) * TILE + cells // TILE, t % (HEAD // TILE) * TILE + cells % TILE
                lists.append(Near(left << RANK_BITS | right, counts[cells]))
            self.dense = {}
        self.listed = Near()
        yield from Near.merged(lists).blocks()


_ZSTD = pa.Codec("zstd", compression_level=1)


def _packed(columns: list[np.ndarray]) -> bytes:
    """The number of entries and the compressed columns."""
    return len(columns[0]).to_bytes(4, "little") + _ZSTD.compress(np.stack(columns).tobytes(), asbytes=True)


def _unpacked(block: pa.Scalar, columns: int, kind: str) -> np.ndarray:
    whole = block.as_buffer()
    n = int.from_bytes(whole.slice(0, 4).to_pybytes(), "little")
    return np.frombuffer(_ZSTD.decompress(whole.slice(4), np.dtype(kind).itemsize * columns * n), kind).reshape(columns, n)


class Near:
    """A list of (left rank, right rank, count) sorted by both, without repeats; ``key`` holds both ranks."""

    def __init__(self, key=(), counts=()):
        self.key, self.counts = np.asarray(key, np.int64), np.asarray(counts, np.int64)

    def __len__(self):
        return len(self.key)

    @classmethod
    def of(cls, left: np.ndarray, right: np.ndarray) -> Near:
        key = np.sort(left << RANK_BITS | right)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        return cls(key[first], np.diff(np.append(first, len(key))))

    @classmethod
    def merged(cls, parts: list[Near]) -> Near:
        return cls(*_sums(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("key", "counts"))))

    def slice(self, lo: int, hi: int) -> Near:
        return Near(self.key[lo:hi], self.counts[lo:hi])

    def below(self, first: int) -> int:
        """How many entries come before a block that begins with ``first``."""
        return int(np.searchsorted(self.key, first))

    @classmethod
    def unpacked(cls, block: pa.Scalar) -> Near:
        steps, counts = _unpacked(block, 2, "<i8")
        return cls(np.cumsum(steps), counts)

    def blocks(self) -> Iterator[tuple[int, int, bytes]]:
        """(band, first, block): a band is ``BAND`` left ranks."""
        band = self.key >> RANK_BITS
        edges = np.searchsorted(band, np.arange(0, HEAD + BAND, BAND))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            for at in range(edges[b], edges[b + 1], BLOCK):
                key = self.key[at:min(at + BLOCK, edges[b + 1])]
                counts = self.counts[at:at + len(key)]
                yield b, int(key[0]), _packed([np.diff(key, prepend=0), counts])

    def sides(self, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return head[self.key >> RANK_BITS], head[self.key & ((1 << RANK_BITS) - 1)]


class Far:
    """A list of (left, right, count) sorted by the pair's key, without repeats."""

    def __init__(self, left=(), right=(), counts=()):
        self.left, self.right = np.asarray(left, np.uint64), np.asarray(right, np.uint64)
        self.counts = np.asarray(counts, np.int64)
        self.key = join_keys(self.left, self.right)

    def __len__(self):
        return len(self.left)

    @classmethod
    def merged(cls, parts: list[Far]) -> Far:
        out = cls(*(np.concatenate([getattr(p, c) for p in parts] or [()]) for c in ("left", "right", "counts")))
        order = np.argsort(out.key, kind="stable")
        key = out.key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        counts = np.add.reduceat(out.counts[order], first) if len(first) else out.counts
        return cls(out.left[order[first]], out.right[order[first]], counts)

    def slice(self, lo: int, hi: int) -> Far:
        return Far(self.left[lo:hi], self.right[lo:hi], self.counts[lo:hi])

    def below(self, first: int) -> int:
        return int(np.searchsorted(self.key >> np.uint64(1), np.uint64(first)))

    @classmethod
    def unpacked(cls, block: pa.Scalar) -> Far:
        left, right, counts = _unpacked(block, 3, "<u8")
        return cls(left, right, counts.view(np.int64))

    def blocks(self) -> Iterator[tuple[int, int, bytes]]:
        """(band, first, block): ranges of keys are bands -1, -2, ...; ``first`` is the block's first key but its last bit."""
        part = (self.key >> np.uint64(64 - RANGE_BITS)).astype(np.int64)
        edges = np.searchsorted(part, np.arange((1 << RANGE_BITS) + 1))
        for r, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            for at in range(lo, hi, BLOCK):
                piece = self.slice(at, min(at + BLOCK, hi))
                yield -1 - r, int(piece.key[0] >> np.uint64(1)), _packed([piece.left, piece.right, piece.counts.view(np.uint64)])

    def sides(self, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.left, self.right


_OUT = pa.schema([("band", pa.int32()), ("run", pa.int32()), ("first", pa.int64()), ("block", pa.binary())])
_SQL_OUT = "band int, run int, first long, block binary"


def _batches(rows: Iterator[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Record batches of about a megabyte from (band, run, first, block)."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size > tb.CHUNK_BYTES or len(held) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), _OUT)], schema=_OUT)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), _OUT)], schema=_OUT)


class Ranks:
    """Ranks of the head's keys: direct addressing by the key's upper bits, then a search in its bucket."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The rank, or -1."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


def count_pairs(source: DataFrame, m: int, head: np.ndarray, tail: bloom.Bloom | None) -> DataFrame:
    """Occurrences of phrases of m words by parts: sorted blocks of bands of tiles, and of key ranges beyond the head."""
    sent = source.sparkSession.sparkContext.broadcast((Ranks(head), tail))

    def run(batches):
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        ranks, others = sent.value

        def counted():
            tiles, beyond = Tiles(), Far()
            near, far = [], []  # (left, right): ranks; keys
            pending = 0

            def fold():
                nonlocal near, far, beyond, pending
                if near:
                    tiles.add(*(np.concatenate(x) for x in zip(*near)))
                if far:
                    left, right = (np.concatenate(x) for x in zip(*far))
                    beyond = Far.merged([beyond, Far(left, right, np.ones(len(left), np.int64))])
                near, far, pending = [], [], 0

            for _, words in _chunks(batches):
                keys, valid = words.phrases(m - 1)
                if len(keys) < 2:
                    continue
                rank = ranks.of(keys)
                known = valid & (rank >= 0)
                if others is not None:
                    unranked = np.flatnonzero(valid & (rank < 0))
                    known[unranked[others.has(keys[unranked])]] = True
                # two phrases of m - 1 words overlap in m - 2, and are in one piece if the words that follow are joined
                at = np.flatnonzero(known[:-1] & known[1:] & words.joined[:len(keys) - 1])
                ranked = (rank[at] >= 0) & (rank[at + 1] >= 0)
                near.append((rank[at[ranked]], rank[at[ranked] + 1]))
                far.append((keys[at[~ranked]], keys[at[~ranked] + 1]))
                pending += len(at)
                if pending > PAIRS:
                    fold()
                    if len(tiles.listed) > LISTED:
                        yield from tiles.blocks(False)
                    if len(beyond) > LISTED:
                        yield from beyond.blocks()
                        beyond = Far()
            fold()
            yield from tiles.blocks(True)
            yield from beyond.blocks()

        yield from _batches((band, task, first, block) for band, first, block in counted())
        tb.trim()

    found = shared.written(source.mapInArrow(run, _SQL_OUT), "pairs")
    sent.unpersist()
    return found


class _Sum:
    """Merge of the blocks of one band, which come in the order of their first entries: what is below the next
    block's first entry is final."""

    def __init__(self, kind: type):
        self.kind, self.held, self.size = kind, [], 0

    def add(self, first: int, block: pa.Scalar) -> Iterator[tuple[int, int, bytes]]:
        if self.size > PAIRS:
            whole = self.kind.merged(self.held)
            final = whole.below(first)
            yield from whole.slice(0, final).blocks()
            self.held = [whole.slice(final, len(whole))]
            self.size = len(self.held[0])
        self.held.append(self.kind.unpacked(block))
        self.size += len(self.held[-1])

    def close(self) -> Iterator[tuple[int, int, bytes]]:
        yield from self.kind.merged(self.held).blocks()


def merge_bands(blocks: DataFrame, runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """One sum for every band, in rounds that add up the blocks of ``fan_in`` tasks."""
    def run(batches):
        def merged():
            now, total = None, None
            for part in batches:
                rows = zip(*(part.column(c).to_pylist() for c in ("band", "run", "first")))
                for (band, task, first), block in zip(rows, part.column("block")):
                    if (band, task) != now:
                        if total is not None:
                            yield from ((t, now[1], f, b) for t, f, b in total.close())
                        now, total = (band, task), _Sum(Near if band >= 0 else Far)
                    yield from ((t, task, f, b) for t, f, b in total.add(first, block))
            if total is not None:
                yield from ((t, now[1], f, b) for t, f, b in total.close())

        yield from _batches(merged())
        tb.trim()

    while True:
        runs = -(-runs // fan_in)
        up = blocks.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        blocks = (up.repartition("band", "run").sortWithinPartitions("band", "run", "first")
                  .mapInArrow(run, _SQL_OUT))
        if runs <= 1:
            return blocks


def _frequent(blocks: DataFrame, head: np.ndarray, least: int) -> DataFrame:
    """left, right, c, key of the merged pairs that reach ``least``."""
    sent = blocks.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        for batch in batches:
            for band, block in zip(batch.column("band").to_pylist(), batch.column("block")):
                pairs = (Near if band >= 0 else Far).unpacked(block)
                left, right = pairs.sides(sent.value)
                often = pairs.counts >= least
                if often.any():
                    left, right = left[often], right[often]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(x.view(np.int64)) for x in (left, right)), pa.array(pairs.counts[often]),
                         pa.array(join_keys(left, right).view(np.int64))], ["left", "right", "c", "key"])

    return blocks.select("band", "block").mapInArrow(run, "left long, right long, c long, key long")


def _next(source: DataFrame, shorter: DataFrame, m: int, least: int) -> DataFrame | None:
    """Frequent phrases of m words from those of m - 1; None if there were none."""
    ranked = shorter.orderBy(F.desc("a"), "key").limit(HEAD).select("key").collect()
    head = np.array([r.key for r in ranked], np.int64).view(np.uint64)
    if not len(head):
        return None
    n = shorter.count() if len(head) == HEAD else len(head)
    tail = bloom.build(shorter.select("key"), "key", n) if n > len(head) else None
    found = count_pairs(source, m, head, tail)
    runs = (found.agg(F.max("run")).first()[0] or 0) + 1
    frequent = _frequent(merge_bands(found, runs, FAN_IN), head, least)
    first = shorter.select("lang", F.col("key").alias("left"), "phrase", "heads")
    last = shorter.select(F.col("key").alias("right"), F.col("last").alias("_last"), F.col("tails").alias("_tails"))
    phrases = (frequent.join(first, "left").join(last, "right").select(
        "lang", "key", "left", "right", F.col("c").alias("a"), F.concat_ws(" ", "phrase", "_last").alias("phrase"),
        F.col("_last").alias("last"), F.concat("heads", F.array("c")).alias("heads"),
        F.concat("_tails", F.array("c")).alias("tails")))
    return shared.written(phrases, f"phrases-{m}")


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST,
            least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """([frequent phrases of 1, 2, ... words], word totals of each language).

    A phrase has its lang, key, parts' keys (left, right), count ``a``, text, and the counts of
    its first 1, 2, ... words (``heads``) and of its last 1, 2, ... words (``tails``)."""
    source = _source(docs, text, lang)
    words = shared.written(count_words(source), "words")
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"))
    none = F.lit(None).cast("long")
    levels = [shared.written(words.filter(F.col("c") >= least).select(
        "lang", "key", none.alias("left"), none.alias("right"), F.col("c").alias("a"), F.col("word").alias("phrase"),
        F.col("word").alias("last"), F.array("c").alias("heads"), F.array("c").alias("tails")), "phrases-1")]
    for m in range(2, longest + 1):
        following = _next(source, levels[-1], m, least)
        if following is None:
            break
        levels.append(following)
    return levels, totals


def _outside(level: DataFrame, longer: DataFrame, share: int) -> DataFrame:
    """Phrases that no phrase of one word more holds with ``share`` percent of their count.

    A longer phrase that holds one in that way has a part of one word more that does too."""
    enough = [longer.filter(100 * F.col("a") >= share * part).select(F.col(side).alias("key"))
              for side, part in (("left", F.element_at("heads", -2)), ("right", F.element_at("tails", -2)))]
    return level.join(enough[0].unionAll(enough[1]).distinct(), "key", "left_anti")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST,
         least: int = LEAST, share: int = SHARE) -> DataFrame:
    """Every collocation that no longer one takes in: lang, phrase, a, l, r, n, score."""
    levels, totals = phrases(docs, text, lang, longest, least)
    whole = "(CAST(a AS decimal(19,0)) * CAST(n AS decimal(18,0)) * CAST(1000 AS decimal(4,0)))"
    out = None
    for at, level in enumerate(levels[1:], 2):
        stay = _outside(level, levels[at], share) if at < len(levels) else level
        cuts = F.expr(f"""array_min(transform(sequence(1, {at - 1}), k -> named_struct(
            'score', {whole} div (CAST(heads[k - 1] AS decimal(19,0)) * CAST(tails[{at - 1} - k] AS decimal(19,0))),
            'k', k, 'l', heads[k - 1], 'r', tails[{at - 1} - k])))""")
        scored = stay.join(totals, "lang").withColumn("_cut", cuts).select(
            "lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
        out = scored if out is None else out.unionAll(scored)
    if out is None:
        return docs.sparkSession.createDataFrame([], "lang string, phrase string, a long, l long, r long, n long, score long")
    return out


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
