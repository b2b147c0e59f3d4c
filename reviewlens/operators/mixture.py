"""Bayesian Gaussian mixture by variational inference (M6).

Dirichlet prior on the weights, normal-Wishart priors on means and precisions (full covariance).  A round is
one pass over the points: tasks compute responsibilities for their batches and add up, for each component, the weight,
the sum and the second moment; these statistics (components x (1 + d + d^2) numbers for a task) are
added in rounds of ``FAN_IN`` tasks, so one row per component reaches the driver, which updates the
parameters.  The evidence bound never falls.  Components that the data don't need lose their weight.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma, log, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.operators.common import cut_lineage

FAN_IN = 64
_STATS = "run int, label int, stats array<double>"


def digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 10, then the asymptotic series."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    while (x < 10).any():
        low = x < 10
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - .5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def _lgamma(x) -> np.ndarray:
    return np.vectorize(lgamma, otypes=[float])(x)


@dataclass
class Prior:
    """Dirichlet concentration, strength and centre of the means, degrees of freedom and inverse scale of the precisions."""
    alpha: float
    beta: float
    mean: np.ndarray
    nu: float
    scale: np.ndarray


@dataclass
class Mixture:
    """Parameters of the posterior: one entry per component."""
    alpha: np.ndarray
    beta: np.ndarray
    mean: np.ndarray
    nu: np.ndarray
    scale: np.ndarray  # inverse scale matrices
    prior: Prior

    @property
    def weights(self) -> np.ndarray:
        return self.alpha / self.alpha.sum()

    def log_rho(self, x: np.ndarray) -> np.ndarray:
        """Expected log of weight times density: (points, components)."""
        d = x.shape[1]
        out = np.empty((len(x), len(self.alpha)))
        pi_log = digamma(self.alpha) - digamma(self.alpha.sum())
        for k in range(len(self.alpha)):
            low = np.linalg.cholesky(self.scale[k])
            y = np.linalg.solve(low, (x - self.mean[k]).T)
            det = digamma((self.nu[k] - np.arange(d)) / 2).sum() + d * log(2) - 2 * np.log(np.diag(low)).sum()
            out[:, k] = pi_log[k] + .5 * (det - d * log(2 * pi) - d / self.beta[k] - self.nu[k] * (y * y).sum(0))
        return out

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(responsibilities, log of their normaliser for each point)."""
        rho = self.log_rho(x)
        top = rho.max(1, keepdims=True)
        total = np.log(np.exp(rho - top).sum(1, keepdims=True)) + top
        return np.exp(rho - total), total[:, 0]

    def divergence(self) -> float:
        """KL of the posterior of weights, means and precisions from the prior."""
        p, d, k = self.prior, self.mean.shape[1], len(self.alpha)
        total = (lgamma(self.alpha.sum()) - _lgamma(self.alpha).sum() - lgamma(k * p.alpha) + k * lgamma(p.alpha)
                 + ((self.alpha - p.alpha) * (digamma(self.alpha) - digamma(self.alpha.sum()))).sum())
        log_w0 = -np.linalg.slogdet(p.scale)[1]
        for i in range(k):
            w = np.linalg.inv(self.scale[i])
            log_w = np.linalg.slogdet(w)[1]
            det = digamma((self.nu[i] - np.arange(d)) / 2).sum() + d * log(2) + log_w
            away = self.mean[i] - p.mean
            total += .5 * (d * (p.beta / self.beta[i] - 1 + log(self.beta[i] / p.beta)) + p.beta * self.nu[i] * away @ w @ away)
            total += (_log_b(log_w, self.nu[i], d) - _log_b(log_w0, p.nu, d) + .5 * (self.nu[i] - p.nu) * det
                      - .5 * self.nu[i] * d + .5 * self.nu[i] * np.trace(p.scale @ w))
        return float(total)


def _log_b(log_det_w: float, nu: float, d: int) -> float:
    """Log normaliser of a Wishart density."""
    return -.5 * nu * log_det_w - (.5 * nu * d * log(2) + .25 * d * (d - 1) * log(pi) + _lgamma((nu - np.arange(d)) / 2).sum())


def update(stats: np.ndarray, prior: Prior) -> Mixture:
    """Posterior from (weight, sum, second moment) of each component, one flat row each."""
    d = len(prior.mean)
    n, s, second = stats[:, 0], stats[:, 1:1 + d], stats[:, 1 + d:1 + d + d * d].reshape(-1, d, d)
    beta = prior.beta + n
    mean = (prior.beta * prior.mean + s) / beta[:, None]
    # second moment about 0, prior's part included, less that of the new mean
    outer = prior.beta * np.outer(prior.mean, prior.mean) - beta[:, None, None] * mean[:, :, None] * mean[:, None, :]
    scale = prior.scale + second + outer
    return Mixture(prior.alpha + n, beta, mean, prior.nu + n, (scale + scale.transpose(0, 2, 1)) / 2, prior)


def _sums(x: np.ndarray, r: np.ndarray, log_norm: np.ndarray | None) -> np.ndarray:
    """A row per component: weight, sum, second moment, and (in component 0) the sum of the log normalisers."""
    n, d = x.shape
    out = np.zeros((r.shape[1], 2 + d + d * d))
    out[:, 0], out[:, 1:1 + d] = r.sum(0), r.T @ x
    for k in range(r.shape[1]):
        out[k, 1 + d:-1] = ((x * r[:, k:k + 1]).T @ x).ravel()
    if log_norm is not None:
        out[0, -1] = log_norm.sum()
    return out


def add_up(parts: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row of ``parts`` (run, label, stats) for each label, in rounds of ``fan_in`` runs."""
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"run": rows["run"].iloc[:1], "label": rows["label"].iloc[:1],
                             "stats": [np.sum(np.stack(rows["stats"].to_list()), axis=0)]})

    runs = (parts.agg(F.max("run")).first()[0] or 0) + 1
    while True:
        parts = parts.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).groupBy("run", "label").applyInPandas(add, _STATS)
        runs = -(-runs // fan_in)
        if runs <= 1:
            return parts


def _statistics(points: DataFrame, responsible, k: int) -> np.ndarray:
    """Summed rows of ``responsible(frame) -> (x, responsibilities, log normalisers or None)`` over all points."""
    def run(frames):
        from pyspark import TaskContext
        total = None
        for frame in frames:
            if len(frame):
                part = _sums(*responsible(frame))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"run": TaskContext.get().partitionId(), "label": range(k), "stats": list(total)})

    rows = add_up(cut_lineage(points.mapInPandas(run, _STATS))).collect()  # k rows
    out = [r.stats for r in sorted(rows, key=lambda r: r.label)]
    return np.array(out) if out else np.zeros((0, 0))


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["vec"].to_list()).astype(float)


def fit(df: DataFrame, vec: str, k: int, start: str | None = None, alpha: float | None = None, max_iter: int = 30,
        tol: float = 1e-4, seed: int = 0, bounds: list[float] | None = None) -> Mixture:
    """Posterior of a mixture of ``k`` components; ``bounds`` receives the evidence bound of each round.

    ``start``: a column with labels 0..k-1 to begin with (else a hashed label); ``alpha``: concentration (1 / k).  Rounds
    end when the bound grows by less than ``tol`` a point.  An empty table is an error."""
    label = F.col(start).cast("int") if start else F.pmod(F.xxhash64(F.lit(seed), vec), F.lit(k)).cast("int")
    points = cut_lineage(df.select(F.col(vec).cast("array<double>").alias("vec"), label.alias("label")))

    def hard(frame):
        return _matrix(frame), np.eye(k)[frame["label"].to_numpy()], None

    stats = _statistics(points, hard, k)
    if not stats.size:
        raise ValueError("no points")
    n = stats[:, 0].sum()
    d = len(points.select("vec").first().vec)
    mean = stats[:, 1:1 + d].sum(0) / n
    cov = stats[:, 1 + d:-1].sum(0).reshape(d, d) / n - np.outer(mean, mean)
    prior = Prior(alpha or 1 / k, 1.0, mean, float(d), cov + 1e-6 * max(np.trace(cov) / d, 1e-12) * np.eye(d))
    model, last = update(stats, prior), None
    for _ in range(max_iter):
        now = model

        def soft(frame):
            x = _matrix(frame)
            return (x, *now.responsibilities(x))

        stats = _statistics(points, soft, k)
        bound = float(stats[:, -1].sum()) - now.divergence()
        if bounds is not None:
            bounds.append(bound)
        model = update(stats, prior)
        if last is not None and bound - last < tol * n:
            break
        last = bound
    return model


def components(spark, model: Mixture) -> DataFrame:
    """label, weight, mean (in the space of the points)."""
    return spark.createDataFrame([(i, float(w), m.tolist()) for i, (w, m) in enumerate(zip(model.weights, model.mean))],
                                 "label int, weight double, mean array<double>")


def assign(df: DataFrame, vec: str, model: Mixture, id_col: str) -> DataFrame:
    """id, label (the component with the largest responsibility), probability."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames):
        for frame in frames:
            if len(frame):
                r, _ = model.responsibilities(_matrix(frame))
                yield pd.DataFrame({id_col: frame[id_col], "label": r.argmax(1), "probability": r.max(1)})

    return df.select(id_col, F.col(vec).cast("array<double>").alias("vec")).mapInPandas(
        run, f"{id_col} {kind}, label long, probability double")
