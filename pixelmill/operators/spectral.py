"""Spectral clustering of any number of vectors by landmarks (the Nystrom method).

Affinities are Gaussian. All rows meet a bounded number of landmarks only: the affinity of two rows is taken to be the one that their affinities with the
landmarks imply, which is exact if every different row is a landmark. The driver holds matrices of landmarks times landmarks, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.operators import ml
from pixelmill.session import checkpoint_folder

LANDMARKS = 500
#: Rows whose affinities with all landmarks a worker holds at once.
SLICE = 1024
SMALL = 1e-10


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _affinity(x: np.ndarray, marks: np.ndarray, gamma: float) -> np.ndarray:
    """Gaussian affinities; a row that is too far from all landmarks for a number above 0 belongs to its nearest one alone."""
    d2 = np.maximum((x * x).sum(1)[:, None] + (marks * marks).sum(1) - 2 * x @ marks.T, 0)
    c = np.exp(-gamma * d2)
    far = c.max(axis=1) < 1e-30
    c[far] = 0
    c[far, d2[far].argmin(axis=1)] = 1
    return c


def _added(rows: DataFrame, size: int, width: int, part) -> np.ndarray:
    """The sum over all rows of what ``part`` makes of a batch, a matrix of ``size`` x ``width``; tasks send their sums, a row of the matrix at a time."""

    def run(batches):
        total = np.zeros((size, width))
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                total += part(_matrix(b.slice(k, SLICE).column("features")))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["at", "v"])

    def plus(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"at": [key[0].as_py()], "v": pa.array([_matrix(table.column("v").combine_chunks()).sum(axis=0)], pa.list_(pa.float64()))}, pa.schema([("at", pa.int32()), ("v", pa.list_(pa.float64()))]))

    found = np.zeros((size, width))
    for r in rows.select("features").mapInArrow(run, "at int, v array<double>").groupBy("at").applyInArrow(plus, "at int, v array<double>").collect():  # a row a landmark
        found[r["at"]] = r["v"]
    return found


def coordinates(rows: DataFrame, classes: int, gamma: float | None = None, landmarks: int = LANDMARKS) -> tuple[DataFrame, np.ndarray]:
    """Adds ``coordinates`` (array<double>) to rows with ``features``, and gives the eigenvalues: of the affinities, divided by the row's sum, the ``classes`` largest ones.

    A coordinate is an eigenvector of the random walk over rows; its sign is free, and its squares, weighed by the rows' sums, add up to 1. Landmarks are the different vectors with the
    smallest hashes. ``gamma`` (a distance's square is multiplied by it) is by default one over the median squared distance from a landmark to its 7th nearest. Rows whose
    vector is null, or has null, NaN or infinite entries, get null; there are fewer coordinates where the affinities have a smaller rank.
    """
    v = F.transform("features", lambda x: x.cast("double"))
    whole = F.col("features").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = rows.where(F.coalesce(whole, F.lit(False))).select(v.alias("features"))
    marks = np.array([r[0] for r in clean.distinct().orderBy(F.xxhash64("features"), "features").limit(landmarks).collect()], float)
    if not len(marks):
        return rows.withColumn("coordinates", F.lit(None).cast("array<double>")), np.zeros(0)
    centre = marks.mean(axis=0)
    marks = marks - centre
    if gamma is None:
        d2 = np.sort([((marks - a) ** 2).sum(axis=1) for a in marks], axis=1)
        middle = float(np.median(d2[:, min(7, len(marks) - 1)]))
        gamma = 1 / middle if middle > 0 else 1.0
    m = len(marks)
    lam, u = np.linalg.eigh(_affinity(marks, marks, gamma))
    good = lam > SMALL * lam[-1]
    half = u[:, good] / np.sqrt(lam[good])
    sums = _added(clean, 1, m, lambda x: _affinity(x - centre, marks, gamma).sum(axis=0)[None])[0]
    weight = half @ (half.T @ sums)

    def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = _affinity(x - centre, marks, gamma)
        return c, np.maximum(c @ weight, c.sum(axis=1))  # a row's sum is no less than what it has with landmarks

    def products(x: np.ndarray) -> np.ndarray:
        c, d = scaled(x)
        return c.T @ (c / d[:, None])

    sigma, w = np.linalg.eigh(half.T @ _added(clean, m, m, products) @ half)
    order = [k for k in np.argsort(-sigma, kind="stable")[:classes] if sigma[k] > SMALL]
    project = half @ w[:, order] / np.sqrt(sigma[order])

    @F.pandas_udf("array<double>")
    def place(series):
        out, keep = [None] * len(series), [k for k, f in enumerate(series) if f is not None]
        for at in range(0, len(keep), SLICE):
            some = keep[at : at + SLICE]
            c, d = scaled(np.stack([np.asarray(series.iloc[k], float) for k in some]))
            for k, p in zip(some, c @ project / d[:, None], strict=True):
                out[k] = p
        return type(series)(out)

    return rows.withColumn("coordinates", place(F.when(F.coalesce(whole, F.lit(False)), v))), sigma[order]


def cluster(rows: DataFrame, classes: int, gamma: float | None = None, landmarks: int = LANDMARKS, seed: int = 1) -> DataFrame:
    """Adds ``cluster``: k-means of the spectral coordinates, numbered by each cluster's least vector; null where a row has no coordinates. There can be fewer clusters than ``classes``."""
    placed, values = coordinates(rows, classes, gamma, landmarks)
    if not len(values):
        return placed.withColumn("cluster", F.lit(None).cast("int")).drop("coordinates")
    checkpoint_folder(rows.sparkSession)
    spread = placed.withColumnsRenamed({"features": "_own", "coordinates": "features"}).checkpoint()  # several steps read it, one meets the landmarks
    known = spread.where("features is not null")
    named = ml.probabilities(ml.class_model(known.select("features"), classes, scale=False, kind="kmeans", seed=seed), known)
    least = named.groupBy("prediction").agg(F.min("_own").alias("m")).orderBy("m").collect()  # a row a cluster
    number = F.create_map(*[F.lit(x) for k, r in enumerate(least) for x in (int(r["prediction"]), k)])
    back = [F.col("_own").alias("features") if c == "features" else F.col(c) for c in rows.columns]
    out = named.select(*back, number[F.col("prediction").cast("int")].alias("cluster"))
    return out.union(spread.where("features is null").select(*back, F.lit(None).cast("int").alias("cluster")))
