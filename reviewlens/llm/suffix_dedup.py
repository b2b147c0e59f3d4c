"""Removal of repeated byte strings by the names of a difference cover, without its merge.

Text that can't repeat is pruned first.  The ``WIDTH``-byte windows of each text fall into
runs that share a minimiser (see ``windows``); equal windows lie in runs of one minimiser, a class,
and at one distance from it.  Runs are counted by content.  A class with a single run that
occurs once holds no repeat.  A run that occurs twice or more repeats as a whole: its
suffixes' neighbours in suffix order are those of its copy, so it enters the sort once.

The different runs of a class with two or more are suffix-sorted, many classes to a task:

  * sample the positions whose distance to the minimiser isn't a multiple of three, and
    sort the triples of eight-byte letters that start there; equal triples get one name, in order;
  * recurse on the names: triples of names of 24 bytes, then of 72, name 72 and 198 bytes;
  * order the windows of the sample by their 198-byte name and two more bytes, and in an order of
    their own the remaining ones by their first byte, the name after it, and their last byte;
  * compare the prefixes of neighbours in each order: equal ones are repeats.

Only windows at one distance can be equal, so the sample and the remainder need no
comparison with each other: the two orders aren't merged.  The recursion ends once names cover a window.

A class of more than ``HOT`` different runs isn't sorted in one task: its windows are
dealt out and counted by (class, distance, content), which is exact as well.

Defined cases: null and empty texts have nothing removed; a text shorter than WIDTH bytes
can't lose any; matches never cross documents; repeated rows count as different
documents and each give a row; null ids are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import bloom, shared, windows
from reviewlens.llm import textbatch as tb

WIDTH = 200
HOT = 20_000
BLOCK_BYTES = 2 << 20


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"),
                       F.xxhash64(text).alias("content"), F.col(text).alias("text"))


def _runs(docs: DataFrame) -> DataFrame:
    """(class, run, copies, windows), partly counted."""
    def run(batches):
        for batch in batches:
            for part in tb.chunks(batch, "text"):
                _, _, count, _, minimiser, whole = windows.runs(*tb.utf8(part.column("text")), WIDTH)
                _, first, copies = np.unique(whole, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(minimiser[first].view(np.int64)), pa.array(whole[first].view(np.int64)),
                     pa.array(copies), pa.array(count[first])], ["class", "run", "copies", "windows"])

    return docs.select("text").mapInArrow(run, "class long, run long, copies long, windows long")


def candidates(docs: DataFrame) -> DataFrame:
    """Runs that may hold a repeat: class, run, copies, windows, and strings of the class."""
    counted = _runs(docs).groupBy("class", "run").agg(
        F.sum("copies").alias("copies"), F.first("windows").alias("windows"))
    kept = shared.written(counted, "suffix-runs")
    classes = kept.groupBy("class").agg(F.count(F.lit(1)).alias("strings"), F.sum("copies").alias("all"))
    return kept.join(classes.filter(F.col("all") > 1).drop("all"), "class")


def _places(docs: DataFrame, wanted: bloom.Bloom, sorted_runs: bloom.Bloom) -> DataFrame:
    """Where the candidate runs lie; the bytes of a run that is to be sorted come once per batch."""
    spark = docs.sparkSession
    filters = spark.sparkContext.broadcast((wanted, sorted_runs))

    def run(batches):
        every, some = filters.value
        for batch in batches:
            for part in tb.chunks(batch, "text"):
                data, offs = tb.utf8(part.column("text"))
                row, start, count, place, minimiser, whole = windows.runs(data, offs, WIDTH)
                use = np.flatnonzero(every.has(whole))
                row, start, count, place, minimiser, whole = (
                    x[use] for x in (row, start, count, place, minimiser, whole))
                first = np.zeros(len(whole), bool)
                first[np.unique(whole, return_index=True)[1]] = True
                first &= some.has(whole)
                raw = data.tobytes()
                at = (offs[row] + start).tolist()
                size = (count + WIDTH - 1).tolist()
                texts = [raw[a:a + n] if f else None for a, n, f in zip(at, size, first.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(pa.array(row)), part.column("content").take(pa.array(row)),
                     pa.array(start.astype(np.int32)), pa.array(minimiser.view(np.int64)),
                     pa.array(whole.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(texts, pa.binary())],
                    ["doc", "content", "start", "class", "run", "place", "bytes"])

    found = docs.mapInArrow(
        run, "doc long, content long, start int, class long, run long, place int, bytes binary")
    return shared.written(found, "suffix-places")


def _names(*keys: np.ndarray) -> np.ndarray:
    """Order-preserving names, from 0, of tuples of integers: equal tuples get one name."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _packed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Names of triples of names; one integer where they fit."""
    top = int(max(a.max(initial=0), b.max(initial=0), c.max(initial=0))) + 1
    if top ** 3 < 1 << 63:
        return _names((a * top + b) * top + c)
    return _names(a, b, c)


def repeated_windows(texts: list[bytes], places: np.ndarray) -> list[np.ndarray]:
    """For each run text, which of its windows occur at the same distance in another text.

    places: the minimiser's place in each text.  The difference-cover sort of the module's docstring.
    """
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    owner = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(n) - begin[owner]
    left = sizes[owner] - offset  # bytes to the end of the text
    residue = (offset - places[owner]) % 3
    letter = np.zeros(n + 8, np.uint64)
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in range(8):
        letter[:n] = letter[:n] << np.uint64(8) | wide[k:k + n]

    def level(reach: int, below: np.ndarray | None, steps: tuple[int, int]):
        at = np.flatnonzero((residue != 0) & (left >= reach))
        out = np.zeros(n + WIDTH, np.int64)
        if below is None:
            out[at] = _names(letter[at], letter[at + 8], letter[at + 16])
        else:
            out[at] = _packed(below[at], below[at + steps[0]], below[at + steps[1]])
        return out

    names = level(24, None, (0, 0))
    names = level(72, names, (24, 48))
    names = level(198, names, (72, 126))
    whole = left >= WIDTH
    again = np.zeros(n, bool)
    sample = np.flatnonzero(whole & (residue != 0))
    rest = np.flatnonzero(whole & (residue == 0))
    tail = data.astype(np.int64)
    for at, key in ((sample, (names[sample] << 16) | (tail[sample + 198] << 8) | tail[sample + 199]),
                    (rest, (tail[rest] << 48) | (names[rest + 1] << 8) | tail[rest + 199])):
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        again[at[order[1:][same]]] = True
        again[at[order[:-1][same]]] = True
    return [again[b:b + s - WIDTH + 1] for b, s in zip(begin.tolist(), sizes.tolist())]


def _spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _sorted_marks(runs: DataFrame) -> DataFrame:
    """(run, first, last): repeated window intervals, by the suffix sort of whole classes."""
    parts = max(1, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def emit(block):
        names, texts, places = zip(*block)
        out = [[], [], []]
        for name, flags in zip(names, repeated_windows(list(texts), np.array(places))):
            first, last = _spans_of(flags)
            out[0] += [name] * len(first)
            out[1] += first.tolist()
            out[2] += last.tolist()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["run", "first", "last"])

    def run(batches):
        block, size, now = [], 0, None
        for batch in batches:
            for kind, name, place, text in zip(*(batch.column(c).to_pylist() for c in ("class", "run", "place", "bytes"))):
                if kind != now and size >= BLOCK_BYTES:
                    yield emit(block)
                    block, size = [], 0
                now = kind
                block.append((name, text, place))
                size += len(text)
        if block:
            yield emit(block)

    return (runs.select("class", "run", "place", "bytes").repartition(parts, "class")
            .sortWithinPartitions("class", "run").mapInArrow(run, "run long, first long, last long"))


def _counted_marks(runs: DataFrame) -> DataFrame:
    """The same for classes of very many runs: windows counted by distance and content."""
    each = runs.select("class", "run", F.posexplode(F.expr(
        f"transform(sequence(1, length(bytes) - {WIDTH - 1}), i -> xxhash64(substring(bytes, i, {WIDTH})))"))
        .alias("at", "window"), "place").withColumn("distance", F.col("place") - F.col("at"))
    key = ["class", "distance", "window"]
    twice = each.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return each.join(twice, key).select("run", F.col("at").cast("long").alias("first"),
                                        (F.col("at") + 1).cast("long").alias("last"))


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, content, spans): byte spans to remove from each text that has any, by a null-free
    id and the text's hash."""
    rows = _keyed(docs, text)
    found = shared.written(candidates(rows), "suffix-candidates")
    size = found.agg(F.count(F.lit(1)), F.count(F.when(F.col("strings") > 1, 1))).first()
    several = F.col("strings") > 1
    places = _places(rows, bloom.build(found, "run", size[0]), bloom.build(found.filter(several), "run", size[1]))
    texts = (places.filter(F.col("bytes").isNotNull()).groupBy("class", "run")
             .agg(F.first("place").alias("place"), F.first("bytes").alias("bytes"))
             .join(found.filter(several).select("class", "run", "strings"), ["class", "run"]))
    marks = _sorted_marks(texts.filter(F.col("strings") <= HOT))
    if found.filter(F.col("strings") > HOT).limit(1).count():
        marks = marks.unionAll(_counted_marks(texts.filter(F.col("strings") > HOT)))
    copied = found.filter("copies > 1").select("run", F.lit(0).cast("long").alias("first"), F.col("windows").alias("last"))
    every = copied.unionAll(marks.join(found.filter("copies > 1").select("run"), "run", "left_anti"))
    hits = places.select("doc", "content", "start", "run").join(every, "run").select(
        "doc", "content", F.struct((F.col("start") + F.col("first")).alias("a"),
                                   (F.col("start") + F.col("last") + (WIDTH - 1)).alias("b")).alias("span"))
    return hits.groupBy("doc", "content").agg(F.collect_set("span").alias("spans"))


def with_spans(docs: DataFrame, text: str = "text", name: str = "_spans") -> DataFrame:
    """``docs`` with a column of the spans to remove (null: none)."""
    spans = repeated_spans(docs, text).select(
        F.col("doc").alias("_doc"), F.col("content").alias("_content"), F.col("spans").alias(name))
    keyed = docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "_content": F.xxhash64(text)})
    return keyed.join(spans, ["_doc", "_content"], "left").drop("_doc", "_content")


def merged(spans) -> list[tuple[int, int]]:
    """Maximal spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def removed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256."""
    def run(batches):
        for batch in batches:
            for part in tb.chunks(batch, "text"):
                out = []
                for doc, t, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "_spans"))):
                    raw, spans = (t or "").encode(), merged(spans)
                    kept = cut(raw, spans)
                    out.append((doc, len(raw), len(raw) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _REMOVED)], schema=_REMOVED)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return with_spans(source).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


_REMOVED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                      ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])


def on_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to whole UTF-8 characters."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def deduplicated(docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """``docs`` with the repeated strings cut out of the text, at whole characters; ``size``
    (if there is such a column) becomes the new number of characters."""
    schema = docs.schema
    names = schema.names

    def run(batches):
        for batch in batches:
            for part in tb.chunks(batch, text):
                new = []
                for t, spans in zip(part.column(text).to_pylist(), part.column("_spans").to_pylist()):
                    if t is not None and spans:
                        raw = t.encode()
                        t = cut(raw, on_characters(raw, merged(spans))).decode()
                    new.append(t)
                columns = {c: part.column(c) for c in names}
                columns[text] = pa.array(new, columns[text].type)
                if size in columns:
                    columns[size] = pa.array([None if t is None else len(t) for t in new], columns[size].type)
                yield pa.RecordBatch.from_pydict(columns)

    return with_spans(docs, text).mapInArrow(run, schema)
