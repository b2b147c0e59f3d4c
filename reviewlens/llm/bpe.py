"""Byte-level BPE by a segment tree over byte positions.

A piece's leaf p holds the rank of the pair that starts at byte p (rank * length + p, so
the root is the leftmost pair of the lowest rank).  A merge gives the left token the
merged id, kills the right one, and updates three leaves: the merged pair's own, the dead
one and that of the live neighbour before it; each update walks up the tree.  Pieces
of about one length are rows of one array, and all rows take their next merge together.

Defined cases: null and empty texts have no ids; repeated rows each give a row; a text of
any length is encoded whole.  Other columns of the input are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import textbatch as tb
from reviewlens.llm.units import Store, take

NEVER = np.int64(1) << 62
CELLS = 1 << 21  # of one group of pieces


class Vocabulary:
    """Ranks of a ``.tiktoken`` file, and the pairs that merge into each token."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.by_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k] for k in self.pair.tolist()], np.int64)
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(x) for x in by_id], out=self.offsets[1:])

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NEVER."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], NEVER)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, end of each id's bytes)."""
        start, sizes = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(start - (ends - sizes), sizes) + np.arange(total)], ends

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of units: each match of the pattern separately."""
        lists = [self.pattern.findall(u) for u in units]
        number: dict[str, int] = {}
        which = np.array([number.setdefault(p, len(number)) for x in lists for p in x], np.int64)
        pieces = [p.encode() for p in number]
        found = self.encode_pieces(pieces)
        sizes = np.array([len(found[p]) for p in pieces], np.int64)
        flat = np.fromiter((t for p in pieces for t in found[p]), np.uint32, int(sizes.sum()))
        ends = np.cumsum(sizes)
        out, done = take(flat, (ends - sizes)[which], ends[which])
        per_unit = np.cumsum([len(x) for x in lists])
        return out, np.diff(np.append(0, done)[per_unit], prepend=0)

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, list[int]]:
        done = {p: [self.ranks[p]] for p in pieces if p in self.ranks}
        rest: dict[int, list[bytes]] = {}
        for p in pieces:
            if p not in done:
                rest.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(p)
        for width, group in rest.items():
            most = max(1, CELLS // width)
            for k in range(0, len(group), most):
                part = group[k:k + most]
                done.update(zip(part, self._merge_rows(part, width), strict=True))
        return done

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[list[int]]:
        m = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        place = np.arange(width)
        token = self.by_byte[raw]
        live = place < sizes[:, None]
        follow = np.broadcast_to(place + 1, (m, width)).copy()  # next live position; >= size: none
        before = np.broadcast_to(place - 1, (m, width)).copy()
        tree = np.full((m, 2 * width), NEVER)
        paired = place[:-1] + 1 < sizes[:, None]
        rank = self.merge(token[:, :-1][paired], token[:, 1:][paired])
        leaf = np.full((m, width - 1), NEVER)
        leaf[paired] = np.where(rank < NEVER, rank * width + np.broadcast_to(place[:-1], leaf.shape)[paired], NEVER)
        tree[:, width:2 * width - 1] = leaf
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level = half
        flat, tok, nxt, prv, alive = (x.reshape(-1) for x in (tree, token, follow, before, live))
        rows = np.arange(m)
        while True:
            root = flat[rows * 2 * width + 1]
            go = root < NEVER
            rows, root = rows[go], root[go]
            if not len(rows):
                break
            base, size, tbase = rows * width, sizes[rows], rows * 2 * width
            at, merged = root % width, root // width
            dead = nxt[base + at]
            after = nxt[base + dead]
            last = prv[base + at]
            tok[base + at] = merged
            alive[base + dead] = False
            nxt[base + at] = after
            ahead = after < size
            prv[(base + after)[ahead]] = at[ahead]
            for here, other, there in ((at, after, ahead), (last, at, last >= 0)):
                where, hit = base + here, there
                value = np.full(len(rows), NEVER)
                r = self.merge(tok[where[hit]], tok[(base + other)[hit]])
                value[hit] = np.where(r < NEVER, r * width + here[hit], NEVER)
                if here is at:
                    flat[tbase + width + at] = value
                else:
                    flat[(tbase + width + here)[hit]] = value[hit]
            flat[tbase + width + dead] = NEVER
            nodes = [(at + width) >> 1, (dead + width) >> 1, (np.where(last >= 0, last, at) + width) >> 1]
            while nodes[0][0] >= 1:  # all walks are as long
                for k, node in enumerate(nodes):
                    child = tbase + 2 * node
                    flat[tbase + node] = np.minimum(flat[child], flat[child + 1])
                    nodes[k] = node >> 1
        flat_ids = token[live].tolist()
        ends = np.cumsum(live.sum(1)).tolist()
        return [flat_ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _store(path: str, pattern: str) -> Store:
    """A task's own store, so that an idle Python worker doesn't hold one."""
    return Store(vocabulary(path, pattern).encode_units)


def binaries(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary column of the rows flat[bounds[i]:bounds[i + 1]] (items of any width)."""
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1,
        [None, pa.py_buffer((bounds * flat.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids): ids as little-endian unsigned 32-bit integers in one binary value."""
    def run(batches):
        store = _store(path, pattern)
        for batch in batches:
            for part in tb.chunks(batch, "text"):
                ids, bounds = store.tokens([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), binaries(ids.astype("<u4"), bounds)], ["key", "ids"])
        del store
        tb.trim()

    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "key long, ids binary").withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, bytes): the bytes that the ids stand for."""
    def run(batches):
        vocab = vocabulary(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [np.frombuffer(x or b"", "<u4") for x in part.column("ids").to_pylist()]
                data, ends = vocab.decode(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int64))
                bounds = np.zeros(len(ids) + 1, np.int64)
                np.cumsum([len(x) for x in ids], out=bounds[1:])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("ids"), binaries(data, np.append(0, ends)[bounds])],
                    ["key", "ids", "bytes"])
        tb.trim()

    source = encoded.select(F.col(key).alias("key"), "ids")
    return source.mapInArrow(run, "key long, ids binary, bytes binary").withColumnRenamed("key", key)
