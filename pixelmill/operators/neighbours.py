"""Exact nearest neighbours of vectors, and a classifier by their votes.

Vectors are dealt to the nearest of a few pivots; what a pivot has is a ball, cut into blocks of bounded size. A query first meets the
blocks of its own ball, which gives a bound of its k-th distance, then those of all other balls that reach nearer than this bound (by the triangle
inequality). So no ball is left out that could hold a neighbour, and no group exceeds a block of vectors and a block of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.session import checkpoint_folder

#: Vectors and queries of a group, and queries that are compared at once.
BLOCK, AT_ONCE = 16384, 64
#: Balls that end a hair's breadth beyond the bound are visited, too, so that rounding loses none.
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, by differences, so that equal vectors have equal distances."""
    return np.concatenate([((a[k : k + AT_ONCE, None, :] - b[None]) ** 2).sum(axis=2) for k in range(0, len(a), AT_ONCE)]) if len(a) else np.zeros((0, len(b)))


def _to_pivots(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            v = _matrix(batch.column("v"))
            d = np.sqrt(_distances(v, pivots)) if len(v) else np.zeros((0, len(pivots)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(list(d), pa.list_(pa.float64()))], ["id", "v", "ball", "far"])

    return run


def _nearest(k: int, among: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, ids, out = left.column("q").to_numpy(), right.column("r").to_numpy(), ([], [], [])
        if len(q) and len(ids):
            a, b = _matrix(left.column("v")), _matrix(right.column("w"))
            # squares by a product choose whom to measure by differences: rounding is far below the margin, so no neighbour is left out
            middle = b.mean(axis=0)
            a_, b_ = a - middle, b - middle
            a2, b2 = (a_ * a_).sum(axis=1), (b_ * b_).sum(axis=1)
            margin, last = 1e-12 * (a.shape[1] + 8), min(k + among, len(ids)) - 1
            with np.errstate(all="ignore"):
                for at in range(0, len(q), AT_ONCE):
                    d = a2[at : at + AT_ONCE, None] + b2 - 2 * a_[at : at + AT_ONCE] @ b_.T
                    most = np.partition(d, last, axis=1)[:, last] + 2 * margin * (a2[at : at + AT_ONCE] + b2.max())
                    for row, limit, v, one in zip(d, most, a[at : at + AT_ONCE], q[at : at + AT_ONCE]):
                        near = np.flatnonzero(~(row > limit))
                        if among:
                            near = near[ids[near] != one]
                        own = ((b[near] - v) ** 2).sum(axis=1)
                        first = np.lexsort((ids[near], own))[:k]
                        first = first[np.isfinite(own[first])]
                        for c, x in zip(out, (np.full(len(first), one), ids[near[first]], own[first])):
                            c.append(x)
        cat = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        return pa.table({"q": cat(out[0], pa.int64()), "r": cat(out[1], pa.int64()), "d2": cat(out[2], pa.float64())})

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int, pivots: int = 64, among: bool = False) -> DataFrame:
    """Rows (query, place, id, distance): the ``k`` vectors of ``rows(id, features)`` nearest to each of ``queries(id, features)``, of equally near ones the smallest ids.

    ``among``: queries are rows themselves, and no neighbours of their own. Ids are whole numbers, each once; null vectors, and those with null or NaN entries, are left out. All vectors
    have one length. Fewer than ``k`` rows give fewer neighbours. Pivots are the rows with the smallest hashes; they decide what is compared, not the result.
    """
    checkpoint_folder(rows.sparkSession)

    def clean(df: DataFrame) -> DataFrame:
        v = F.transform("features", lambda x: x.cast("double"))
        return df.select(F.col("id").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))

    data = clean(rows)
    chosen = data.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    result = "q long, r long, d2 double"
    if not chosen:
        return clean(queries).limit(0).select(F.col("id").alias("query"), F.lit(0).alias("place"), "id", F.lit(0.0).alias("distance"))
    deal = _to_pivots(np.array([r["v"] for r in chosen]))
    schema = "id long, v array<double>, ball int, far array<double>"
    data = data.mapInArrow(deal, schema).select("id", "v", "ball", F.col("far")[F.col("ball")].alias("d")).checkpoint()
    asked = clean(queries).mapInArrow(deal, schema).checkpoint()
    balls = data.groupBy("ball").agg(F.max("d").alias("radius"), F.ceil(F.count("*") / BLOCK).alias("blocks")).collect()  # a row a pivot
    size = F.create_map(*[F.lit(x) for b in balls for x in (b["ball"], b["blocks"])])
    blocks = data.select(F.col("id").alias("r"), F.col("v").alias("w"), "ball", F.pmod(F.xxhash64("id"), size[F.col("ball")]).alias("block"))

    def meet(visits: DataFrame) -> DataFrame:
        """Of ``visits(q, v, ball)`` the nearest in each block of the ball."""
        counts = visits.groupBy("ball").agg(F.ceil(F.count("*") / BLOCK).alias("n")).collect()  # a row a pivot
        parts = F.create_map(*[F.lit(x) for r in counts for x in (r["ball"], r["n"])]) if counts else F.lit(None).cast("map<int,bigint>")
        spread = visits.withColumn("part", F.pmod(F.xxhash64("q"), parts[F.col("ball")])).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), size[F.col("ball")] - 1)))
        copies = blocks.withColumn("part", F.explode(F.when(parts[F.col("ball")] > 0, F.sequence(F.lit(0).cast("long"), parts[F.col("ball")] - 1))))
        key = ["ball", "block", "part"]
        return spread.groupBy(*key).cogroup(copies.groupBy(*key)).applyInArrow(_nearest(k, among), result)

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("d2", "r"))).where(F.col("place") <= k)

    first = best(meet(asked.select(F.col("id").alias("q"), "v", "ball"))).drop("place").checkpoint()
    bound = first.groupBy("q").agg(F.max("d2").alias("most"), F.count("*").alias("n"))
    bound = bound.select("q", F.when(F.col("n") == k, F.sqrt("most")).alias("bound"))
    others = F.array(*[F.struct(F.lit(b["ball"]).alias("ball"), F.lit(b["radius"]).alias("radius")) for b in balls])
    open_ = asked.join(bound, asked["id"] == bound["q"], "left").select("id", "v", F.col("ball").alias("home"), "far", "bound", F.explode(others).alias("o"))
    near = F.col("bound").isNull() | (F.col("far")[F.col("o.ball")] - F.col("o.radius") <= F.col("bound") * (1 + SLACK) + SLACK)
    more = open_.where((F.col("o.ball") != F.col("home")) & near).select(F.col("id").alias("q"), "v", "o.ball").checkpoint()
    return best(first.union(meet(more))).select(F.col("q").alias("query"), F.col("place").cast("int").alias("place"), F.col("r").alias("id"), F.sqrt("d2").alias("distance"))


def classify(train: DataFrame, rows: DataFrame, k: int = 5, among: bool = False) -> DataFrame:
    """Rows (id, prediction, votes): the most frequent label among the ``k`` nearest of ``train(id, features, label)``, the smallest of equals."""
    votes = nearest(rows, train.where("label is not null"), k, among=among).join(train.select("id", "label"), "id").groupBy("query", "label").agg(F.count("*").alias("votes"))
    best = votes.groupBy("query").agg(F.min(F.struct((-F.col("votes")).alias("n"), "label")).alias("m"))
    return best.select(F.col("query").alias("id"), F.col("m.label").alias("prediction"), (-F.col("m.n")).alias("votes"))
