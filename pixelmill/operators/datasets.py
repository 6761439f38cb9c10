"""Training sets: distinct and balanced rows, and folds by group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators.ranks import ranked
from pixelmill.session import checkpoint_folder

#: Above so many clusters a label's rows are parted into cells of about as many rows, with clusters of their own; cells are found from a sample.
CELL, SAMPLE = 512, 20000


def unique_rows(rows: DataFrame, label: str, features: str, digits: int = 3) -> DataFrame:
    """Distinct (label, rounded features)."""
    return rows.select(label, F.transform(features, lambda v: F.round(v, digits) + 0.0).alias(features)).distinct()


def balance(rows: DataFrame, label: str, key: str, groups: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """As many rows of each label (of each group) as the rarest has, chosen by a seeded hash of ``key``.

    The rank of a row among its label's is found by the hash's range: rows are counted by hash bucket first, so no window holds a whole label.
    """
    g = list(groups)
    hashed = rows.withColumn("_h", F.xxhash64(key, F.lit(seed))).withColumn("_b", F.shiftright("_h", 52))
    n = hashed.groupBy(*g, label, "_b").agg(F.count("*").alias("_n"))
    least = n.groupBy(*g, label).agg(F.sum("_n").alias("_n"))
    least = least.groupBy(*g).agg(F.min("_n").alias("_k")) if g else least.agg(F.min("_n").alias("_k"))
    before = n.withColumn("_before", F.sum("_n").over(Window.partitionBy(*g, label).orderBy("_b")) - F.col("_n")).select(*g, label, "_b", "_before")
    ranked = hashed.join(before, [*g, label, "_b"]).withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy(*g, label, "_b").orderBy("_h", key)))
    ranked = ranked.join(least, g) if g else ranked.join(F.broadcast(least), F.lit(True))
    return ranked.where("_r <= _k").drop("_h", "_b", "_before", "_r", "_k")


def sizes(rows: DataFrame, groups: list[str], label: str) -> DataFrame:
    """Rows of each label in each group."""
    return rows.groupBy(*groups, label).agg(F.count("*").alias("n"))


def group_folds(rows: DataFrame, group: str, hold_out: int) -> DataFrame:
    """Adds ``fold``: groups in order, ``hold_out`` of them a fold, so that no group is in two folds. Rows without a group are left out."""
    ids = ranked(rows.select(group).where(F.col(group).isNotNull()).distinct(), [F.col(group)], "_r")
    return rows.join(ids.select(group, F.floor(F.col("_r") / hold_out).cast("int").alias("fold")), group)


def fold_table(n: int, hold_out: int) -> list[list[int]]:
    """Sample numbers that each fold holds out; the last fold, if short, takes samples from the beginning again."""
    if hold_out < 1 or n < 1:
        raise ValueError("sizes have to be positive")
    return [[k % n for k in range(start, start + hold_out)] for start in range(0, n, hold_out)]


def hold_out(rows: DataFrame, key: str, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training rows and a seeded share of rows held out, by a hash of the key."""
    out = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))
    return rows.where(~out), rows.where(out)


def shuffled(rows: DataFrame, key: str, seed: int = 0, name: str = "place") -> DataFrame:
    """Adds the place, from 0, of each row in an order that a seeded hash of its key gives."""
    return ranked(rows.withColumn("_h", F.xxhash64(key, F.lit(seed))), [F.col("_h"), F.col(key)], name).drop("_h")


def balance_by_kmeans(rows: DataFrame, label: str, key: str, features: str = "features", n: int | None = None, seed: int = 1) -> DataFrame:
    """For each label the rows nearest to the centres of n clusters of its rows, n the size of the rarest label unless given; at most n a label.

    Labels are few: each has a model of its own. Rows that are equally near count by their keys. As a model's cost is clusters times rows, more than ``CELL`` clusters
    are dealt to cells of near rows by their sizes, and found cell by cell, so that the cost grows with the rows alone.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    n, out = n or min(counts.values()), None
    if n > CELL:
        return _balanced_by_cells(rows, label, key, features, n, counts, seed)
    for value, size in sorted(counts.items()):
        part = rows.where(F.col(label) == value)
        if size > n:
            model = KMeans(featuresCol="_v", predictionCol="_c", k=n, seed=seed).fit(part.withColumn("_v", array_to_vector(features)))
            centres = part.sparkSession.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())], "_c int, _m array<double>")
            near = model.transform(part.withColumn("_v", array_to_vector(features))).drop("_v").join(centres, "_c")
            far = F.aggregate(F.zip_with(features, "_m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
            best = near.groupBy("_c").agg(F.min(F.struct(far.alias("d"), F.col(key).alias("k")))["k"].alias(key)).select(key).distinct()
            part = part.join(best, key, "left_semi")
        out = part if out is None else out.unionByName(part)
    return out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _tree(x: np.ndarray, leaves: int, first: int = 0):
    """A leaf's number, or (direction, bound, left, right): rows are split along their widest direction in proportion to the leaves of both sides."""
    if leaves <= 1 or len(x) < 2:
        return first
    off = x - x.mean(axis=0)
    direction = np.linalg.eigh(off.T @ off)[1][:, -1]
    at, left = x @ direction, leaves // 2
    bound = float(np.quantile(at, left / leaves))
    return direction, bound, _tree(x[at < bound], left, first), _tree(x[at >= bound], leaves - left, first + left)


def _leaves(tree, x: np.ndarray) -> np.ndarray:
    out, todo = np.zeros(len(x), np.int32), [(tree, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        if isinstance(node, int):
            out[at] = node
        else:
            low = x[at] @ node[0] < node[1]
            todo += [(node[2], at[low]), (node[3], at[~low])]
    return out


def _centres_rows(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Of the rows of each of at most k clusters (Lloyd's rounds from seeded rows) the one nearest to its centre, the first of equals."""
    different = np.unique(x, axis=0)
    centres = different[np.random.default_rng(seed).permutation(len(different))[:k]]
    middle = x.mean(axis=0)
    x, centres = x - middle, centres - middle
    of = None
    for _ in range(20):
        now = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        if of is not None and (now == of).all():
            break
        of = now
        n = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    far = ((x - centres[of]) ** 2).sum(axis=1)
    order = np.lexsort((np.arange(len(x)), far, of))
    return order[np.r_[True, np.diff(of[order]) > 0]]


def _balanced_by_cells(rows: DataFrame, label: str, key: str, features: str, n: int, counts: dict, seed: int) -> DataFrame:
    checkpoint_folder(rows.sparkSession)
    large = {value: size for value, size in counts.items() if size > n}
    vectors = rows.select(label, key, F.transform(features, lambda v: v.cast("double")).alias("_v"))
    trees = {}
    for value, size in large.items():
        sample = vectors.where(F.col(label) == value).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(SAMPLE).select("_v").toArrow()
        trees[value] = _tree(_matrix(sample.column("_v")), -(-size // CELL))

    def deal(batches):
        for batch in batches:
            x, cell = _matrix(batch.column("_v")), np.zeros(batch.num_rows, np.int32)
            of = np.array(batch.column(label).to_pylist(), object)
            for value in set(of):
                mine = np.flatnonzero(of == value)
                cell[mine] = _leaves(trees[value], x[mine])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (label, key, "_v")), pa.array(cell)], [label, key, "_v", "_cell"])

    kinds = dict(vectors.dtypes)
    dealt = vectors.where(F.col(label).isin(list(large))).mapInArrow(deal, f"{label} {kinds[label]}, {key} {kinds[key]}, _v array<double>, _cell int").checkpoint()
    # a cell that copies make too large is cut by hash
    parts = dealt.groupBy(label, "_cell").agg(F.ceil(F.count("*") / (2 * CELL)).alias("_parts"))
    dealt = dealt.join(parts, [label, "_cell"]).withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts"))).drop("_parts")
    share: dict = {}
    groups = dealt.groupBy(label, "_cell", "_part").agg(F.count("*").alias("n")).orderBy(label, "_cell", "_part").collect()  # a row a cell
    for value, size in large.items():
        mine = [r for r in groups if r[label] == value]
        got = [n * r["n"] // size for r in mine]
        for at in sorted(range(len(mine)), key=lambda i: -(n * mine[i]["n"] % size))[: n - sum(got)]:
            got[at] += 1
        share |= {(value, r["_cell"], r["_part"]): k for r, k in zip(mine, got, strict=True)}

    def pick(group: tuple, table: pa.Table) -> pa.Table:
        k = share[tuple(g.as_py() for g in group)]
        table = table.sort_by(key)
        chosen = _centres_rows(_matrix(table.column("_v")), k, seed) if k else np.zeros(0, int)
        return table.select([label, key]).take(pa.array(chosen))

    best = dealt.groupBy(label, "_cell", "_part").applyInArrow(pick, f"{label} {kinds[label]}, {key} {kinds[key]}")
    return rows.where(F.col(label).isin(list(set(counts) - set(large)))).unionByName(rows.join(best, [label, key], "left_semi"))
