"""Toxicity by weak supervision.

Voters are lexicon entries (a word) and patterns (a word start of 4 or 5 bytes, no hit at
all), chosen on a sample of labelled training rows so that toxic texts are covered several times
each.  A generative label model with a hidden class estimates by expectation maximisation
how often each voter fires in either class, and from the remaining conditional correlations
how much each voter is to be discounted.  A linear classifier is then trained on the model's
posterior labels; its sigmoid is a document's score.

Bounds: the sample holds at most ``LABELLED`` rows of different text (smallest hashes of
the ids), the voters are at most ``VOTERS``, so the model is a few thousand numbers.  Every
document is scored on its whole text and nothing else.

Defined cases: null and empty texts hit nothing and get the score of the intercept with
the no-hit voter; without labels of both classes every score is 0; null ids count as not
held out; repeated rows each give a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import shared
from reviewlens.llm import textbatch as tb
from reviewlens.llm.quality import _member, labelled_sample

LABELLED = 20_000
VOTERS = 512
CANDIDATES = 4096
COVER = 6
LEAST = 4
PURE = 0.9
TRUST = 0.95  # of the given label as one more voter
STARTS = (4, 5)
PREDICT = 0.3
PATTERNS = 1  # no hit

_LETTER = np.zeros(256, np.uint8)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1


def held_out(key: Column, parts: int, which: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % parts == which, F.lit(False))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word and word start."""
    starts, ends, bounds = tb.runs(_LETTER[data], offs)
    spans = tb.Spans(tb.LOWER[data])
    rows = tb.rows_of(bounds)
    hashes, owner = [spans.hash(starts, ends)], [rows]
    for n in STARTS:
        long = ends - starts > n
        hashes.append(tb.mix(spans.hash(starts[long], starts[long] + n) + np.uint64(n)))
        owner.append(rows[long])
    return np.concatenate(hashes), np.concatenate(owner)


def fired(data: np.ndarray, offs: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(voter, row), each once: entries of the sorted ``lexicon`` and then the patterns."""
    n, m = len(offs) - 1, len(lexicon)
    hashes, rows = features(data, offs)
    at = np.searchsorted(lexicon, hashes)
    at[at == m] = 0
    hit = lexicon[at] == hashes if m else np.zeros(len(hashes), bool)
    pairs = np.unique(rows[hit] * (m + PATTERNS) + at[hit])
    quiet = np.flatnonzero(np.bincount(pairs // (m + PATTERNS), minlength=n) == 0)
    pairs = np.concatenate([pairs, quiet * (m + PATTERNS) + m])
    return pairs % (m + PATTERNS), pairs // (m + PATTERNS)


def _sample(docs: DataFrame, ids: dict, text: str) -> DataFrame:
    """The labelled sample: text and label, one row per different text."""
    every = np.union1d(ids[0], ids[1])

    def pick(batches):
        for batch in batches:
            part = batch.filter(pa.array(_member(batch.column("doc_id"), every)))
            toxic = pa.array(_member(part.column("doc_id"), ids[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("text"), toxic], ["text", "toxic"])

    rows = docs.select("doc_id", F.col(text).alias("text")).mapInArrow(pick, "text string, toxic int")
    return shared.written(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-sample")


def _candidates(sample: DataFrame) -> np.ndarray:
    """Features that mark toxic texts best, as hashes."""
    def count(batches):
        for batch in batches:
            for part in tb.chunks(batch, "text"):
                hashes, rows = features(*tb.utf8(part.column("text")))
                order = np.lexsort((hashes, rows))
                hashes, rows = hashes[order], rows[order]
                first = np.ones(len(hashes), bool)
                first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
                toxic = part.column("toxic").to_numpy(zero_copy_only=False)[rows[first]]
                keys, at = np.unique(hashes[first], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(np.bincount(at, toxic).astype(np.int64)),
                     pa.array(np.bincount(at))], ["feature", "toxic", "n"])

    total = sample.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    rate = (total.toxic or 0) / max(total.n, 1)
    counted = (sample.mapInArrow(count, "feature long, toxic long, n long")
               .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")))
    surplus = (F.col("toxic") - rate * F.col("n")) / F.sqrt(rate * (1 - rate) * F.col("n") + 1e-9)
    best = (counted.filter((F.col("toxic") >= LEAST) & (F.col("toxic") >= PURE * F.col("n")))
            .withColumn("z", surplus).orderBy(F.desc("z"), "feature").limit(CANDIDATES).collect())
    return np.array([r.feature for r in best], np.int64).view(np.uint64)


def _votes(sample: DataFrame, lexicon: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Fired voters and label of each sampled row, in a fixed order."""
    def run(batches):
        for batch in batches:
            for part in tb.chunks(batch, "text"):
                voter, row = fired(*tb.utf8(part.column("text")), lexicon)
                order = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[order], np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(voter[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, part.column("toxic")], ["votes", "toxic"])

    rows = sorted((tuple(r.votes), r.toxic) for r in sample.mapInArrow(run, "votes array<int>, toxic int").collect())
    return [np.array(v, np.int64) for v, _ in rows], np.array([y for _, y in rows])


def _cover(votes: list[np.ndarray], toxic: np.ndarray, m: int) -> np.ndarray:
    """Voters, taken greedily until each toxic text is covered COVER times or none helps."""
    need = [(v[v < m]) for v, y in zip(votes, toxic) if y]
    left = np.full(len(need), COVER)
    flat = np.concatenate([*need, np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(need)), [len(v) for v in need])
    chosen: list[int] = []
    taken = np.zeros(m, bool)
    while len(chosen) < VOTERS:
        gain = np.bincount(flat, weights=left[owner] > 0, minlength=m) if len(flat) else np.zeros(m)
        gain[taken] = 0
        best = int(np.argmax(gain)) if m else 0
        if not m or gain[best] < LEAST:
            break
        taken[best] = True
        chosen.append(best)
        left[owner[flat == best]] -= 1
    return np.array(sorted(chosen), np.int64)


def label_model(fires: np.ndarray, given: np.ndarray, rate: float, rounds: int = 25) -> tuple[np.ndarray, dict]:
    """Posterior P(toxic) of each row, and the estimates.

    fires[i, j]: voter j fired on row i.  The last column (no hit) speaks for the clean
    class.  The given label is one more voter, of fixed accuracy TRUST.  Correlations are those of the voters' residuals given the posterior.
    """
    n, m = fires.shape
    post = np.where(fires[:, -1] > 0, 0.02, 0.9)
    weight = np.ones(m)
    gold = np.where(given > 0, 1, -1) * np.log(TRUST / (1 - TRUST))
    for k in range(rounds):
        one = (fires.T @ post + rate) / (post.sum() + 2 * rate)
        zero = (fires.T @ (1 - post) + 0.1) / ((1 - post).sum() + 1)
        one, zero = (np.clip(x, 1e-4, 1 - 1e-4) for x in (one, zero))
        if k == rounds // 2:
            residual = fires - post[:, None] * one - (1 - post)[:, None] * zero
            scale = np.sqrt((residual ** 2).sum(0)) + 1e-9
            correlation = np.abs(residual.T @ residual / scale[:, None] / scale)
            np.fill_diagonal(correlation, 0)
            weight = 1 / (1 + np.where(correlation > 0.2, correlation, 0).sum(1))
        on, off = np.log(one / zero) * weight, np.log((1 - one) / (1 - zero)) * weight
        logit = gold + np.log(rate / (1 - rate)) + off.sum() + fires @ (on - off)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, {"fires_if_toxic": one, "fires_if_clean": zero, "weight": weight}


def linear_classifier(x: np.ndarray, target: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + penalty * w
        bend = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        w = w - np.linalg.solve(bend, slope)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> dict:
    """Learn from labelled rows that aren't held out."""
    ids = labelled_sample(labels.filter(~held_out(F.col("doc_id"), 4, 2)), "toxic", LABELLED)
    ids[0] = np.setdiff1d(ids[0], ids[1])
    nothing = {"lexicon": np.zeros(0, np.uint64), "weights": np.zeros(PATTERNS), "bias": -50.0}
    if not len(ids[0]) or not len(ids[1]):
        return nothing
    sample = _sample(docs, ids, text)
    lexicon = np.sort(_candidates(sample))
    votes, toxic = _votes(sample, lexicon)
    lexicon = lexicon[_cover(votes, toxic, len(lexicon))]
    if not len(lexicon):
        return nothing
    votes, toxic = _votes(sample, lexicon)
    fires = np.zeros((len(votes), len(lexicon) + PATTERNS))
    for i, v in enumerate(votes):
        fires[i, v] = 1
    post, _ = label_model(fires, toxic, float(np.clip(toxic.mean(), 0.001, 0.999)))
    weights, bias = linear_classifier(fires, post)
    return {"lexicon": lexicon, "weights": weights, "bias": bias}


def score_documents(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    lexicon, weights, bias = model["lexicon"], model["weights"], model["bias"]

    def run(batches):
        for batch in batches:
            for part in tb.chunks(batch, "text"):
                voter, row = fired(*tb.utf8(part.column("text")), lexicon)
                logit = bias + np.bincount(row, weights=weights[voter], minlength=part.num_rows)
                score = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= PREDICT).cast("int").alias("predicted"))
