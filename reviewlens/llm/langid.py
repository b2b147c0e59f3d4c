"""Language identification: a bidirectional gated recurrent network over bytes.

Each text is cut into sequences of ``STEPS`` bytes, which covers it whole.  Two gated
recurrent units read a sequence in either direction; a softmax labels every byte with a
language, and a document's probabilities are the means over its bytes.  The network is
trained in numpy by backpropagation through time on windows of at most ``PER_LANG``
training documents per language (the smallest hashes of their ids).  Gates are piecewise
linear (clip(x / 4 + 1/2) and clip(x)), which needs no exponential per byte and state.

Defined cases: texts that are null or have no letter are ``und`` with score 0; null
languages are not learned from; with no training rows every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm import textbatch as tb
from reviewlens.llm.toxicity import held_out

HIDDEN = 8
STEPS = 64
PER_LANG = 1_000
WINDOW = 256  # bytes of a training text, from a hashed place
ROUNDS = 400
BATCH = 96
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True


class Cell:
    """One direction: h' = (1 - z) h + z n, z = s(Wz x + Uz h), n = c(Wn x + r (Un h)), r = s(Wr x + Ur h)."""

    def __init__(self, rng: np.random.Generator):
        self.w = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)  # a row per byte, bias included
        self.u = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32)

    def run(self, x: np.ndarray, keep: bool = False):
        """States (time, batch, HIDDEN) over x (time, batch); for keep also what backward() needs."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        states, tape = np.empty((*x.shape, HIDDEN), np.float32), []
        for t in range(len(x)):
            a, b = self.w[x[t]], h @ self.u
            gates = a[:, :2 * HIDDEN] + b[:, :2 * HIDDEN]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            z, r, un = gates[:, :HIDDEN], gates[:, HIDDEN:], b[:, 2 * HIDDEN:]
            n = np.clip(a[:, 2 * HIDDEN:] + r * un, -1, 1)
            if keep:
                tape.append((h, z, r, un, n))
            h = h + z * (n - h)
            states[t] = h
        return states, tape

    def backward(self, x: np.ndarray, tape: list, dstates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dw, du = np.zeros_like(self.w), np.zeros_like(self.u)
        dh = np.zeros_like(dstates[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, un, n = tape[t]
            dh = dh + dstates[t]
            dn = dh * z * (np.abs(n) < 1)
            dz = dh * (n - h) * 0.25 * ((z > 0) & (z < 1))
            dr = dn * un * 0.25 * ((r > 0) & (r < 1))
            da = np.concatenate([dz, dr, dn], 1)
            db = np.concatenate([dz, dr, dn * r], 1)
            np.add.at(dw, x[t], da)
            du += h.T @ db
            dh = dh * (1 - z) + db @ self.u.T
        return dw, du


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Cell(rng), Cell(rng)
        self.out = rng.normal(0, 0.3, (2 * HIDDEN, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def train(self, texts: np.ndarray, target: np.ndarray, rounds: int = ROUNDS, rate: float = 0.02) -> None:
        """texts: (rows, STEPS) bytes; target: language of each row.  Adam on the mean loss over bytes."""
        rng = np.random.default_rng(11)
        params = [self.ahead.w, self.ahead.u, self.back.w, self.back.u, self.out, self.bias]
        first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
        for k in range(1, rounds + 1):
            pick = rng.integers(0, len(texts), BATCH)
            x, y = np.ascontiguousarray(texts[pick].T), target[pick]
            fwd, ftape = self.ahead.run(x, keep=True)
            rev, rtape = self.back.run(x[::-1], keep=True)
            both = np.concatenate([fwd, rev[::-1]], 2)
            p = _softmax(both @ self.out + self.bias)
            p[:, np.arange(BATCH), y] -= 1
            p /= p.shape[0] * p.shape[1]
            dboth = p @ self.out.T
            gw, gu = self.ahead.backward(x, ftape, dboth[:, :, :HIDDEN])
            hw, hu = self.back.backward(x[::-1], rtape, dboth[::-1, :, HIDDEN:])
            grads = [gw, gu, hw, hu, np.einsum("tbh,tbl->hl", both, p), p.sum((0, 1))]
            step = rate * min(1.0, 2 * (1 - k / (rounds + 1)))
            for q, g, a, b in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                q -= step * (a / (1 - 0.9 ** k)) / (np.sqrt(b / (1 - 0.99 ** k)) + 1e-8)

    def pooled(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean probabilities (rows, languages) over the bytes of each text."""
        sizes = np.diff(offs)
        per = -(-sizes // STEPS)
        row = np.repeat(np.arange(len(sizes)), per)
        place = (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * STEPS
        start = offs[:-1][row] + place
        length = np.minimum(STEPS, sizes[row] - place)
        total = np.zeros((len(sizes), len(self.languages)))
        for k in range(0, len(row), 8192):
            s, n, r = start[k:k + 8192], length[k:k + 8192], row[k:k + 8192]
            t = np.arange(STEPS)[:, None]
            real = t < n
            x = data[np.where(real, s + t, s)]
            # the backward direction starts at a sequence's own last byte
            flip = data[np.where(real, s + n - 1 - t, s)]
            fwd, _ = self.ahead.run(x)
            rev, _ = self.back.run(flip)
            rev = rev[np.where(real, n - 1 - t, t), np.arange(len(s))]
            p = _softmax(fwd @ self.out[:HIDDEN] + rev @ self.out[HIDDEN:] + self.bias)
            p *= real[:, :, None]
            np.add.at(total, r, p.sum(0))
        return total / np.maximum(sizes, 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(-1, keepdims=True)
    return x


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Network | None:
    """Train on rows with a language that aren't held out."""
    key = F.xxhash64("doc_id", "text")
    rows = docs.select("doc_id", F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)
        & F.regexp_like("text", F.lit(r"\p{L}")))
    order = Window.partitionBy("lang").orderBy("key", "doc_id")
    cut = F.substring(F.encode("text", "UTF-8"), F.lit(1) + F.pmod("key", F.greatest(
        F.lit(1), F.octet_length("text") - WINDOW)).cast("int"), F.lit(WINDOW))
    picked = (rows.withColumn("key", key).select("doc_id", "lang", "key", cut.alias("bytes"))
              .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= PER_LANG)
              .select("lang", "bytes", "key", "doc_id").collect())
    if not picked:
        return None
    picked.sort(key=lambda r: (r.lang, r.key, r.doc_id))
    network = Network(sorted({r.lang for r in picked}))
    pieces, target = [], []
    for r in picked:
        raw = np.frombuffer(bytes(r.bytes), np.uint8)
        for k in range(0, max(1, len(raw) - STEPS + 1), STEPS):
            pieces.append(np.resize(raw[k:k + STEPS], STEPS))
            target.append(network.languages.index(r.lang))
    network.train(np.stack(pieces), np.array(target))
    return network


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    def run(batches):
        for batch in batches:
            for part in tb.chunks(batch, "text"):
                data, offs = tb.utf8(part.column("text"))
                lettered = tb.per_row(_LETTER[data], offs) > 0
                for i in np.flatnonzero(~lettered & (tb.per_row(data >= 128, offs) > 0)):
                    lettered[i] = any(map(str.isalpha, part.column("text")[int(i)].as_py()))
                if network is None:
                    lettered[:] = False
                names, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                if lettered.any():
                    kept = part.filter(pa.array(lettered))
                    p = network.pooled(*tb.utf8(kept.column("text")))
                    for i, j, v in zip(np.flatnonzero(lettered), p.argmax(1), p.max(1)):
                        names[i], score[i] = network.languages[j], v
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0))],
                    ["doc_id", "lang_pred", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double").select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")
