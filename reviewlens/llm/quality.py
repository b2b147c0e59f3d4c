"""Quality rules: counts of every document and a hashed n-gram log-likelihood ratio.

Tokens are lower-cased runs of word bytes or of punctuation; unigrams and bigrams are
hashed into ``BUCKETS`` cells.  Two smoothed multinomials over the cells are counted: the
raw corpus (all documents) and the trusted target (documents labelled good).  A document's
score is the sum of log(target / raw) over its n-grams divided by their number; documents
under one fixed threshold are rejected.  Every labelled document counts, in the target and for the threshold:
labels meet documents in a join, whose rows are written once, and the threshold comes from running
totals over the sorted scores, so the driver receives BUCKETS counts and one number, however many labels there are.

Defined cases: a null or empty text has zero counts, a score of 0 and fails the base
rules; null ids and repeated rows each give their own row; null labels are no label;
without good labels the target equals the corpus and nothing is rejected by the ratio.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import bloom
from reviewlens.llm import textbatch as tb
from reviewlens.llm.shared import written
from reviewlens.operators.common import running_total

BUCKETS = 1 << 14
MIN_WORDS = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True  # the characters # * $ % & | < >
_KIND = np.full(256, 2, np.uint8)  # punctuation
_KIND[tb.SPACE] = 0
_KIND[128:] = 1
_KIND[[b for b in range(128) if chr(b).isalnum() or b == 95]] = 1

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    inside = ~tb.SPACE[data]
    starts, ends, bounds = tb.runs(inside.astype(np.uint8), offs)
    spans = tb.Spans(data)
    out = {
        "n_words": np.diff(bounds),
        "word_chars": tb.per_row(inside & ((data & 0xC0) != 0x80), offs),
        "n_symbols": tb.per_row(_SYMBOL[data], offs),
    }
    three = tb.window_starts(bounds, 3)
    hashes, rows = tb.grams(spans.hash(starts, ends), bounds, 3)
    every, _ = tb.repeated(hashes ^ tb.mix(rows.astype(np.uint64)))
    covered = np.zeros(len(starts), bool)
    for k in range(3):
        covered[three[every] + k] = True
    out["n_repeat_words"] = tb.per_row(covered, bounds)

    breaks = np.flatnonzero(data == 10)
    first = np.union1d(offs[:-1], breaks + 1)
    first = first[first < len(data)]
    last = np.append(first[1:], len(data))
    last = np.where((last > first) & (data[np.maximum(last, 1) - 1] == 10), last - 1, last)
    has_word = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    first, last = first[has_word], last[has_word]
    row = np.searchsorted(offs, first, side="right") - 1
    _, later = tb.repeated(spans.hash(first, last) ^ tb.mix(row.astype(np.uint64)))
    out["n_dup_lines"] = np.bincount(row[later], minlength=len(offs) - 1)
    return out


def _cells(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) of every unigram and bigram."""
    low = tb.LOWER[data]
    starts, ends, bounds = tb.runs(_KIND[data], offs)
    hashes = tb.Spans(low).hash(starts, ends)
    two, rows2 = tb.grams(hashes, bounds, 2)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    cells = np.concatenate([hashes, two]) >> shift
    return cells.astype(np.int64), np.concatenate([tb.rows_of(bounds), rows2])


def _scores(data, offs, ratio):
    cells, rows = _cells(data, offs)
    n = len(offs) - 1
    total = np.bincount(rows, weights=ratio[cells], minlength=n)
    return total / np.maximum(np.bincount(rows, minlength=n), 1)


def _member(ids: pa.Array, wanted: np.ndarray) -> np.ndarray:
    if len(wanted) == 0:
        return np.zeros(len(ids), bool)
    got = ids.cast(pa.int64()).fill_null(-1 << 63).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(wanted, got), len(wanted) - 1)
    return wanted[at] == got


def labelled_sample(labels: DataFrame, column: str, most: int) -> dict[int, np.ndarray]:
    """Sorted ids by label value: at most ``most`` labelled rows, the smallest hashes."""
    rows = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
            .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most).collect())
    return {y: np.unique(np.array([r.doc_id for r in rows if r.y == y], np.int64)) for y in (0, 1)}


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, good) of every document with a label; good if any of its labels is 1.

    A filter of bounded size keeps most texts without a label out of the join's shuffle."""
    known = written(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
                    .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
                    .groupBy("doc_id").agg((F.max("y") == 1).alias("good")), "labels")
    key = F.xxhash64("doc_id").alias("key")
    keep = docs.sparkSession.sparkContext.broadcast(bloom.build(known.select(key), "key", known.count()))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(keep.value.has(batch.column("key").to_numpy())))

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").select("doc_id", "text", key)
    some = some.mapInArrow(run, some.schema)
    return written(some.hint("merge").join(known, "doc_id").select("text", "good"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> dict:
    """The log ratio of each cell and the threshold (bounded: BUCKETS numbers)."""
    source = docs.select(F.col("doc_id"), F.col(text).alias("text"))
    labelled = _labelled(source, labels)

    def count(batches):
        found = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in tb.chunks(batch, "text"):
                found += np.bincount(_cells(*tb.utf8(part.column("text")))[0], minlength=BUCKETS)
        used = np.flatnonzero(found)
        tb.trim()
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[used])], ["cell", "n"])

    def counts(texts: DataFrame) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for r in texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            out[r.cell] = r.n
        return out

    raw, target = counts(source), counts(labelled.filter("good"))
    ratio = np.zeros(BUCKETS)
    if target.sum():
        ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))

    def score(batches):
        for batch in batches:
            for part in tb.chunks(batch, "text"):
                got = _scores(*tb.utf8(part.column("text")), ratio)
                yield pa.RecordBatch.from_arrays([part.column("good"), pa.array(got)], ["good", "score"])
        tb.trim()

    return {"ratio": ratio, "threshold": _threshold(labelled.mapInArrow(score, "good boolean, score double"))}


def _threshold(scored: DataFrame) -> float:
    """The cut with the largest balanced accuracy on the labelled rows, halfway between scores;
    of equal cuts the lowest.  -inf unless both labels occur."""
    tally = written(scored.groupBy("score").agg(F.count_if(~F.col("good")).alias("bad"), F.count_if("good").alias("fine")), "tally")
    both = tally.agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine")).first()
    if not both.bad or not both.fine:
        return float("-inf")
    before = running_total(running_total(tally, "score", "bad", "_bad"), "score", "fine", "_fine")
    gain = (F.col("_bad") + F.col("bad")) / F.lit(float(both.bad)) - (F.col("_fine") + F.col("fine")) / F.lit(float(both.fine))
    best = before.agg(F.max(F.struct(gain.alias("gain"), (-F.col("score")).alias("at"))).alias("b")).first().b
    if best.gain <= 0:
        return float("-inf")
    after = tally.filter(F.col("score") > F.lit(-best.at)).agg(F.min("score").alias("next")).first().next
    return (-best.at + (-best.at if after is None else after)) / 2


def score_documents(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, score and kept."""
    ratio, threshold = model["ratio"], model["threshold"]
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def run(batches):
        for batch in batches:
            for part in tb.chunks(batch, "text"):
                out = _judge(part.column("text"), ratio, threshold)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(out[c]) for c in [*names, "base_failed", "score", "kept"])],
                    ["doc_id", *names, "base_failed", "score", "kept"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc_id long, {COUNTS}, base_failed boolean, score double, kept boolean")


def _judge(column: pa.Array, ratio: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    data, offs = tb.utf8(column)
    out = text_counts(data, offs)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["score"] = _scores(data, offs, ratio)
    out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
    return out


def keep_documents(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    ratio, threshold = model["ratio"], model["threshold"]

    def run(batches):
        for batch in batches:
            for part in tb.chunks(batch, text):
                yield part.filter(pa.array(_judge(part.column(text), ratio, threshold)["kept"]))
        tb.trim()

    return docs.mapInArrow(run, docs.schema)
