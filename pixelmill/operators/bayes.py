"""Gaussian mixtures by variational Bayes: the number of live components follows from the data.

Weights have a Dirichlet prior, means and precisions a normal-Wishart prior around the data's mean and covariance. A round is one pass over the rows, in which
each partition, of about ``ROWS`` rows, adds up its rows' shares in the components; the driver adds these sums, or gets them added by a grouped sum where they are many. The lower bound
of the evidence, which no round lowers, says when to end.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.operators.ml import vectors
from pixelmill.session import checkpoint_folder

#: A component with less than this many rows in expectation is pruned at the end.
LEAST_ROWS = 0.5
#: Rows of a partition, as a round is short, and sums that the driver takes without grouping.
ROWS = 20_000
SUMS = 100_000
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the logarithm of the gamma function for positive numbers: recurrence up to 6, then the asymptotic series."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(6):
        small = x < 6
        out = out - np.where(small, 1 / x, 0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


@dataclass
class Mixture:
    """Posterior: ``alpha`` of the weights; ``mean``, ``beta``, ``scale`` (of the Wishart, its inverse in ``inverse``) and ``nu`` of each component; ``bounds`` by round."""

    alpha: np.ndarray
    mean: np.ndarray
    beta: np.ndarray
    inverse: np.ndarray
    nu: np.ndarray
    bounds: list[float]
    settled: bool

    def expected(self) -> tuple[np.ndarray, np.ndarray]:
        """E[log weight] and E[log determinant of the precision]."""
        d = self.mean.shape[1]
        log_w = digamma(self.alpha) - digamma(self.alpha.sum())
        log_det = digamma((self.nu[:, None] - np.arange(d)) / 2).sum(axis=1) + d * math.log(2) - np.linalg.slogdet(self.inverse)[1]
        return log_w, log_det

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        """Log of the unnormalised share of each row in each component."""
        d = x.shape[1]
        log_w, log_det = self.expected()
        out = np.empty((len(x), len(self.alpha)))
        for k in range(len(self.alpha)):
            off = x - self.mean[k]
            out[:, k] = log_w[k] + 0.5 * (log_det[k] - d * math.log(2 * math.pi) - d / self.beta[k] - self.nu[k] * (off * np.linalg.solve(self.inverse[k], off.T).T).sum(axis=1))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _sums(rows: DataFrame, shares, centre: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of all rows by component: expected number, sums and products of x - centre; and the sum of the logs of ``shares``' sums."""
    d = len(centre)
    size = classes * (1 + d + d * d) + 1

    def partial(batches):
        total = np.zeros(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            log_r = shares(batch)
            top = log_r.max(axis=1, keepdims=True)
            norm = top + np.log(np.exp(log_r - top).sum(axis=1, keepdims=True))
            r, y = np.exp(log_r - norm), _matrix(batch.column("features")) - centre
            total[:-1] += np.concatenate([r.sum(axis=0), (r.T @ y).ravel(), np.einsum("nk,ni,nj->kij", r, y, y, optimize=True).ravel()])
            total[-1] += norm.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "v"])

    found, parts = np.zeros(size), rows.mapInArrow(partial, "at int, v double")
    if size * rows.rdd.getNumPartitions() > SUMS:
        parts = parts.groupBy("at").agg(F.sum("v").alias("v"))
    for row in parts.collect():
        found[row["at"]] += row["v"]
    n, s, p = np.split(found[:-1], [classes, classes * (1 + d)])
    return n, s.reshape(classes, d), p.reshape(classes, d, d), float(found[-1])


def _log_b(inverse: np.ndarray, nu: float) -> float:
    """Log of the Wishart's normaliser."""
    d = len(inverse)
    return nu / 2 * np.linalg.slogdet(inverse)[1] - (nu * d / 2 * math.log(2) + d * (d - 1) / 4 * math.log(math.pi) + _lgamma((nu - np.arange(d)) / 2).sum())


def fit(rows: DataFrame, classes: int, rounds: int = 200, tolerance: float = 1e-7, seed: int = 1, weight: float | None = None) -> Mixture:
    """A mixture of up to ``classes`` components for ``rows(features array<double>)``; components that no rows need are pruned.

    Starts from k-means. ``weight`` is the prior count of each component, else 1 / classes; rounds end when the bound rises by less than ``tolerance`` a row, or at
    ``rounds``, which ``settled`` tells.
    """
    checkpoint_folder(rows.sparkSession)
    rows = rows.select(F.transform("features", lambda v: v.cast("double")).alias("features")).where("features is not null").checkpoint()
    n = rows.count()
    if n < 2:
        raise ValueError("a mixture needs two rows at least")
    if rows.rdd.getNumPartitions() > -(-n // ROWS):
        rows = rows.coalesce(-(-n // ROWS)).checkpoint()
    d = len(rows.first()["features"])
    start = KMeans(featuresCol="raw", predictionCol="of", k=min(classes, n), seed=seed).fit(vectors(rows)).transform(vectors(rows)).select("features", "of").checkpoint()
    k = min(classes, n)

    def dealt(batch):
        return np.where(np.arange(k) == batch.column("of").to_numpy()[:, None], 0.0, -np.inf)

    count, s, p, _ = _sums(start, dealt, np.zeros(d), k)
    m0 = s.sum(axis=0) / n
    count, s, p, _ = _sums(start, dealt, m0, k)  # products around the mean lose no digits
    cov0 = p.sum(axis=0) / n + 1e-9 * np.eye(d) * max(1e-12, np.trace(p.sum(axis=0)) / n / d)
    a0, b0, nu0 = weight or 1 / classes, 1.0, float(d)

    def step(count, s, p, bounds) -> Mixture:
        """The posterior of the components given the rows' shares; means are around m0."""
        beta, nu = b0 + count, nu0 + count
        inverse = cov0 + p - s[:, :, None] * s[:, None, :] / beta[:, None, None]
        inverse = (inverse + inverse.transpose(0, 2, 1)) / 2
        return Mixture(a0 + count, m0 + s / beta[:, None], beta, inverse, nu, bounds, False)

    model = step(count, s, p, [])
    for _ in range(rounds):
        count, s, p, log_sum = _sums(rows, lambda batch, m=model: m.log_shares(_matrix(batch.column("features"))), m0, k)
        log_w, log_det = model.expected()
        a = model.alpha
        bound = log_sum - float(math.lgamma(a.sum()) - _lgamma(a).sum() - math.lgamma(k * a0) + k * math.lgamma(a0) + ((a - a0) * log_w).sum())
        for j in range(k):
            off = model.mean[j] - m0
            bound -= 0.5 * (d * (b0 / model.beta[j] - 1 + math.log(model.beta[j] / b0)) + b0 * model.nu[j] * off @ np.linalg.solve(model.inverse[j], off))
            bound -= _log_b(model.inverse[j], model.nu[j]) - _log_b(cov0, nu0) + (model.nu[j] - nu0) / 2 * log_det[j] + model.nu[j] / 2 * (np.trace(np.linalg.solve(model.inverse[j], cov0)) - d)
        bounds = [*model.bounds, float(bound)]
        done = len(bounds) > 1 and bounds[-1] - bounds[-2] < tolerance * n
        model = step(count, s, p, bounds)
        if done:
            model.settled = True
            break
    live = count >= LEAST_ROWS
    return Mixture(model.alpha[live], model.mean[live], model.beta[live], model.inverse[live], model.nu[live], model.bounds, model.settled)


def probabilities(model: Mixture, rows: DataFrame) -> DataFrame:
    """``rows`` with ``proba``, the share of each live component, and ``prediction``; null for null features."""
    @F.pandas_udf("array<double>")
    def share(v):
        good = v.notna().to_numpy()
        out = np.full(len(v), None, object)
        if good.any():
            log_r = model.log_shares(np.stack(v[good].to_numpy()).astype(float))
            r = np.exp(log_r - log_r.max(axis=1, keepdims=True))
            for at, x in zip(np.flatnonzero(good), r / r.sum(axis=1, keepdims=True)):
                out[at] = x
        import pandas as pd

        return pd.Series(out)

    made = rows.withColumn("proba", share(F.transform("features", lambda v: v.cast("double"))))
    return made.withColumn("prediction", F.array_position("proba", F.array_max("proba")).cast("int") - 1)
