"""Whitening of embeddings from an exact integer scatter matrix.

Components become whole numbers x = floor(scale * c) + offset. A shift is subtracted, and with a column of ones appended, sums and
cross-products come from one product of each chunk with itself. Chunks are cut into digits so small that floating products are
exact; digits are carried into whole numbers of any size and added up by a grouped sum. n * X'X - S S' is then formed from these
without rounding, and only that becomes floating and is decomposed. What reaches the driver is the matrix, whose size the dimension sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import lean, materialize

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Bits of a digit, rows whose products are added before they are carried, and digits of a sum (180 bits: 2 ** 124 a product, 2 ** 56 rows).
DIGIT, CHUNK, DIGITS = 20, 4096, 9
#: Share of the greatest eigenvalue below which one pass of eigh isn't exact enough, and share of the trace that counts as nothing.
TRUSTED, NOTHING = 1e-6, 2.0**-96


def whole_vectors(embeddings: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows (vec_id, v): vectors as doubles. Null vectors, those with null or non-finite entries, empty ones, and those of another length than most go.

    An entry too large for x to be a long counts as non-finite. Of lengths that are equally frequent the smallest counts.
    """
    v = F.transform(F.col(vec), lambda c: c.cast("double"))
    good = embeddings.select("vec_id", v.alias("v")).where(F.size("v") > 0).where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE >= 2.0**62)))
    common = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return good.where(F.size("v") == (common["d"] if common else 0))


def scatter(vectors: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, sums of x - offset, and n * X'X - S S', as Python's whole numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DIGITS, d + 1, d + 1), dtype=np.int64)
        for y in _chunks(batches, d):
            _add_products(total, np.column_stack([y, np.ones(len(y), dtype=np.int64)]))
        i, j = np.triu_indices(d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(t[i, j]) for t in total)], ["i", "j", *names])

    names = [f"d{k}" for k in range(DIGITS)]
    parts = vectors.select("v").mapInArrow(lean(partial), "i int, j int, " + ", ".join(f"{k} long" for k in names))
    sums = np.zeros((d + 1, d + 1), dtype=object)
    for row in parts.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in names]).collect():
        sums[row["i"], row["j"]] = sums[row["j"], row["i"]] = sum(row[k] << (DIGIT * p) for p, k in enumerate(names))
    n, s = int(sums[d, d]), sums[:d, d]
    return n, s, n * sums[:d, :d] - np.outer(s, s)


def _chunks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        y = _scaled(batch.column("v"), d)
        for k in range(0, len(y), CHUNK):
            yield y[k : k + CHUNK]


def _scaled(column: pa.Array, d: int) -> np.ndarray:
    """x - offset of each entry, which is exact: to scale by a power of two only moves the point."""
    return np.floor(np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d) * SCALE).astype(np.int64)


def _add_products(total: np.ndarray, y: np.ndarray) -> None:
    """Add y'y to ``total``, which holds digits of DIGIT bits, the last of any size and sign."""
    digits = []
    while y.any() or not digits:
        low = ((y + (1 << DIGIT - 1)) & ((1 << DIGIT) - 1)) - (1 << DIGIT - 1)
        digits.append(low.astype(np.float64))
        y = (y - low) >> DIGIT
    for p, a in enumerate(digits):
        for q, b in enumerate(digits):
            total[p + q] += (a.T @ b).astype(np.int64)
            for k in range(p + q, DIGITS - 1):
                over = total[k] >> DIGIT
                total[k] -= over << DIGIT
                total[k + 1] += over


def decompose(scattered: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of the covariance, falling, and unit eigenvectors as columns; those that are nothing are left out.

    Eigenvalues far below the largest drown in its rounding. So what eigh finds is taken down to a share of the largest, the
    matrix is formed again, exactly, on the space that is left, and that is decomposed in turn.
    """
    d = len(scattered)
    exact, unit, basis = scattered, n * n, np.eye(d)
    least = sum(int(scattered[k, k]) for k in range(d)) / unit * d * NOTHING
    values, vectors = np.zeros(0), np.zeros((d, 0))
    while len(values) < most and basis.shape[1]:
        w, q = np.linalg.eigh((exact / unit).astype(np.float64))
        w, q = w[::-1], q[:, ::-1]
        good = int((w > max(least, w[0] * TRUSTED)).sum()) if w[0] > least else 0
        if not good:
            break
        values, vectors = np.append(values, w[:good]), np.column_stack([vectors, basis @ q[:, :good]])
        basis = basis @ q[:, good:]
        if basis.shape[1]:
            basis = np.linalg.qr(basis - vectors @ (vectors.T @ basis))[0]
            fixed = np.rint(basis * 2.0**52).astype(np.int64).astype(object)
            exact, unit = fixed.T @ scattered @ fixed, n * n << 104
    return values[:most], vectors[:, :most]


def whiten(embeddings: DataFrame, most: int = COMPONENTS, vec: str = "embedding") -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    All vectors that ``whole_vectors`` leaves are the fit list, repeated rows and null ids among them. ``deviation`` is the exact sum of
    (n * x - S) ** 2, as a decimal; null where 38 digits can't hold it. Components are numbered from 1 up to ``most`` or the dimension; one
    without variance (a single row, equal rows, a constant or dependent entry) has whitened null and explains 0, or null when all have none.
    ``identity_error`` is the largest entry of the whitened vectors' covariance, of components with variance, minus the identity. An empty table
    gives an empty one; columns besides the two are not read.
    """
    vectors = materialize(whole_vectors(embeddings.select("vec_id", vec), vec), "whole")
    first = vectors.select(F.size("v").alias("d")).first()
    d = first["d"] if first else 1
    n, s, scattered = scatter(vectors, d)
    values, axes = decompose(scattered, n, most) if n else (np.zeros(0), np.zeros((d, 0)))
    total = sum(int(scattered[k, k]) for k in range(d)) / (n * n) if n else 0.0
    projected = materialize(_project(vectors, n, s, values, axes), "whitened")
    error = _identity_error(projected, n, len(values))
    shares = [v / total for v in values] + [0.0 if total else None] * (min(most, d) - len(values))
    out = projected.select("vec_id", "deviation", F.posexplode(F.concat("w", F.array_repeat(F.lit(None).cast("double"), len(shares) - len(values)))).alias("k", "whitened"))
    explained = F.array(*[F.lit(x).cast("double") for x in shares])
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("k")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def _project(vectors: DataFrame, n: int, s: np.ndarray, values: np.ndarray, axes: np.ndarray) -> DataFrame:
    onto, d, far = axes / np.sqrt(values), len(s), max([abs(int(x)) for x in s])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _scaled(batch.column("v"), d)
            reach = n * int(np.abs(y).max(initial=0)) + far
            if reach < 2**62:
                off = n * y - s.astype(np.int64)
                centred = off / n
            else:
                off = n * y.astype(object) - s
                centred = (off / n).astype(np.float64)
            squares = (off * off).sum(axis=1) if d * reach * reach < 2**62 else (off.astype(object) ** 2).sum(axis=1)
            w = centred @ onto
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            kept = pa.array([None if q >= 10**38 else str(q) for q in squares.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), kept, lists], ["vec_id", "deviation", "w"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(lean(run), f"vec_id {kind}, deviation string, w array<double>").withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def _identity_error(projected: DataFrame, n: int, k: int) -> float | None:
    """Covariance of the whitened vectors, centred before multiplying, against the identity."""
    if not n or not k:
        return None
    mean = np.array(projected.agg(*[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(k)]).first()) / n

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = np.asarray(batch.column("w").flatten()).reshape(-1, k) - mean
            total += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    sums = projected.select("w").mapInArrow(lean(partial), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return max(abs(r["s"] / n - (r["i"] == r["j"])) for r in sums)
