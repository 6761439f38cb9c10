"""Region adjacency graphs: edges, weights, costs, label transitions, components and labelling."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators.features import segment_statistics
from pixelmill.session import checkpoint_folder

KEY = ["img"]
#: Edge weights are kept between 1 / MAX_WEIGHT and MAX_WEIGHT, pairwise costs below MAX_COST.
MAX_WEIGHT, MAX_COST = 1000.0, 100000.0
MAX_CLASSES = 1000


def adjacency(px: DataFrame, segment: str, axes: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Pairs of segments that touch along an axis, once each: (img, src, dst) with src < dst."""
    pairs = None
    for axis in axes:
        w = Window.partitionBy(*KEY, *[a for a in axes if a != axis]).orderBy(axis)
        p = px.select(*KEY, F.col(segment).alias("_a"), F.lead(segment).over(w).alias("_b")).where("_a <> _b")
        pairs = p if pairs is None else pairs.union(p)
    return pairs.select(*KEY, F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst")).distinct()


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """Rows (img, segment, neighbours), neighbours in order."""
    both = edges.select(*KEY, F.col("src").alias("segment"), F.col("dst").alias("_n")).union(edges.select(*KEY, "dst", "src"))
    return both.groupBy(*KEY, "segment").agg(F.sort_array(F.collect_set("_n")).alias("neighbours"))


def _ends(edges: DataFrame, sp: DataFrame, segment: str, columns: list[str]) -> DataFrame:
    a = sp.select(*KEY, F.col(segment).alias("src"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = sp.select(*KEY, F.col(segment).alias("dst"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return edges.join(a, [*KEY, "src"]).join(b, [*KEY, "dst"])


def spatial_distance(edges: DataFrame, centres: DataFrame, segment: str, axes: tuple[str, ...] = ("y", "x"), relative: bool = False) -> DataFrame:
    """Adds ``distance`` between the centroids of an edge's segments, relative to the image's mean if asked for."""
    d2 = sum((F.col(f"a_c_{a}") - F.col(f"b_c_{a}")) * (F.col(f"a_c_{a}") - F.col(f"b_c_{a}")) for a in axes)
    out = _ends(edges, centres, segment, [f"c_{a}" for a in axes]).withColumn("distance", F.sqrt(d2)).select(*KEY, "src", "dst", "distance")
    return out.withColumn("distance", F.col("distance") / F.avg("distance").over(Window.partitionBy(*KEY))) if relative else out


def _decay(d: Column) -> Column:
    """exp(-d / (2 std(d)^2)) over an image's edges; 1 where all distances are equal."""
    v = F.var_pop(d).over(Window.partitionBy(*KEY))
    return F.when(v > 0, F.exp(-d / (2 * v))).otherwise(1.0)


def array_distance(metric: str, a: str, b: str) -> Column:
    """l1, l2, or lT: the largest squared difference of two arrays."""
    diff = F.zip_with(a, b, lambda x, y: x - y)
    if metric == "l1":
        return F.aggregate(diff, F.lit(0.0), lambda acc, x: acc + F.abs(x))
    if metric == "l2":
        return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda acc, x: acc + x * x))
    if metric == "lT":
        return F.array_max(F.transform(diff, lambda x: x * x))
    raise ValueError(f"unknown metric {metric}")


def edge_weights(edges: DataFrame, kind: str, sp: DataFrame | None = None, centres: DataFrame | None = None, segment: str = "lb", values: str = "proba", axes: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Adds ``w``: (img, src, dst, w).

    ``model``, ``model_l1``, ``model_l2``, ``model_lT``: decay of the distance of class probabilities (array ``values`` of ``sp``);
    ``features``: of values scaled to unit deviation; ``color``: of mean colours; ``spatial`` and anything else: 1. The plain names model,
    features, color and spatial are divided by the relative distance of centroids; the suffixed ones aren't.
    """
    if kind.startswith("model") or kind in ("features", "color"):
        if sp is None:
            raise ValueError(f"{kind} needs values of the segments")
        rows = sp
        if kind == "features":
            n = len(sp.select(values).first()[0])
            w = Window.partitionBy(*KEY)
            cols = [F.element_at(values, k + 1) for k in range(n)]
            rows = sp.select(*KEY, segment, F.array(*[F.when(F.stddev_pop(c).over(w) > 0, (c - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).otherwise(c - F.avg(c).over(w)) for c in cols]).alias(values))
        metric = {"features": "l2", "color": "l1"}.get(kind) or (kind.split("_")[1] if "_" in kind else "lT")
        out = _ends(edges, rows, segment, [values]).withColumn("_d", array_distance(metric, f"a_{values}", f"b_{values}"))
        out = out.withColumn("w", _decay(F.col("_d"))).select(*KEY, "src", "dst", "w")
    else:
        out = edges.withColumn("w", F.lit(1.0))
    if kind in ("model", "features", "color", "spatial"):
        if centres is None:
            raise ValueError(f"{kind} needs centroids")
        far = spatial_distance(edges, centres, segment, axes, relative=True)
        out = out.join(far, [*KEY, "src", "dst"]).withColumn("w", F.col("w") / F.col("distance"))
    return out.select(*KEY, "src", "dst", F.greatest(F.least("w", F.lit(MAX_WEIGHT)), F.lit(1 / MAX_WEIGHT)).alias("w"))


def transitions(edges: DataFrame, sp: DataFrame, segment: str, label: str) -> DataFrame:
    """Touching segments by their labels over all images: (l1, l2, n), both orders; equal labels count an edge once."""
    e = _ends(edges, sp, segment, [label])
    both = e.select(F.col(f"a_{label}").alias("l1"), F.col(f"b_{label}").alias("l2")).union(e.select(f"b_{label}", f"a_{label}"))
    return both.groupBy("l1", "l2").agg((F.count("*") / F.when(F.col("l1") == F.col("l2"), 2).otherwise(1)).cast("double").alias("n"))


def pairwise_from_transitions(trans: DataFrame, least: float = 1e-9) -> DataFrame:
    """Costs (l1, l2, cost) = -log of the larger of both column shares, pairs never seen at the least probability."""
    ids = trans.select(F.col("l1").alias("l2")).distinct()
    if ids.count() > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} labels; costs of all their pairs are meant for classes")
    grid = ids.withColumnRenamed("l2", "l1").join(F.broadcast(ids), F.lit(True))
    share = grid.join(trans, ["l1", "l2"], "left").fillna(0.0, ["n"]).withColumn("r", F.col("n") / F.sum("n").over(Window.partitionBy("l2")))
    turned = share.select(F.col("l1").alias("l2"), F.col("l2").alias("l1"), F.col("r").alias("t"))
    return share.join(turned, ["l1", "l2"]).select("l1", "l2", F.log(1 / F.greatest("r", "t", F.lit(least))).alias("cost"))


def pairwise_matrix(classes: int, regularisation: float | list = 1.0) -> list[list[float]]:
    """Costs of unlike neighbours: one number for all, or overrides ((i, j), cost) of 1, or a full matrix (its least becomes 0)."""
    if isinstance(regularisation, list) and regularisation and isinstance(regularisation[0], list):
        low = min(min(r) for r in regularisation)
        m = [[v - low for v in r] for r in regularisation]
    elif isinstance(regularisation, list):
        m = [[float(i != j) for j in range(classes)] for i in range(classes)]
        for (i, j), w in regularisation:
            m[i][j] = m[j][i] = w
    else:
        m = [[0.0 if i == j else float(regularisation) for j in range(classes)] for i in range(classes)]
    return [[min(v, MAX_COST) for v in r] for r in m]


def unary_cost(p: Column, least: float = 0.01) -> Column:
    """-log of a probability held between ``least`` and its complement."""
    return F.abs(-F.log(F.greatest(F.least(p, F.lit(1 - least)), F.lit(least))))


def best_labels(costs: DataFrame, keys: list[str]) -> DataFrame:
    """The label of least cost a row group (keys, cls, cost), the smallest of equals."""
    return costs.groupBy(*keys).agg(F.min_by("cls", F.struct("cost", "cls")).alias("label"))


def pairwise_penalty(edges: DataFrame, sp: DataFrame, segment: str, label: str, background: float = 0.05, foreground: float = 0.01) -> DataFrame:
    """Adds ``cost``: -log of the probability that unlike labels touch, other for the background (label 0)."""
    e = _ends(edges, sp, segment, [label])
    a, b = F.col(f"a_{label}"), F.col(f"b_{label}")
    cost = F.when(a == b, 0.0).when((a == 0) | (b == 0), -F.log(F.lit(background))).otherwise(-F.log(F.lit(foreground)))
    return e.select(*KEY, "src", "dst", cost.alias("cost"))


def energy(unary: DataFrame, edges: DataFrame, labels: DataFrame, matrix: list[list[float]], segment: str = "lb") -> DataFrame:
    """Rows (img, energy): unary costs (img, segment, cls, cost) of the labels plus weighted pairwise costs."""
    u = unary.join(labels, [*KEY, segment]).where("cls = label").groupBy(*KEY).agg(F.sum("cost").alias("u"))
    pair = F.array(*[F.array(*map(F.lit, r)) for r in matrix])
    e = _ends(edges, labels, segment, ["label"]).groupBy(*KEY).agg(F.sum(F.col("w") * pair[F.col("a_label")][F.col("b_label")]).alias("e"))
    return u.join(e, KEY, "left").select(*KEY, (F.col("u") + F.coalesce("e", F.lit(0.0))).alias("energy"))


def regularise(unary: DataFrame, edges: DataFrame, matrix: list[list[float]], segment: str = "lb") -> DataFrame:
    """Labels (img, segment, label) that lower unary (img, segment, cls, cost) plus weighted pairwise cost, by rounds of conditional modes.

    A segment takes its best label given its neighbours' if no neighbour gains more in the same round, so the energy falls with each round, and
    rounds go on until nothing changes. This replaces the max-flow of alpha expansion; it ends in a local minimum, as that does. An
    image's segments are one group, so all images are settled side by side.
    """
    costs = unary.select(*KEY, F.col(segment).alias("_s"), F.col("cls").cast("long").alias("_c"), F.col("cost").cast("double").alias("_v"), F.lit(None).cast("long").alias("_f"))
    return _settled(costs, edges, matrix, False).select(*KEY, F.col("_s").cast(dict(unary.dtypes)[segment]).alias(segment), "label")


def grown(unary: DataFrame, edges: DataFrame, seeds: DataFrame, matrix: list[list[float]], segment: str) -> DataFrame:
    """As ``regularise``, but from seeds (img, segment, label), which keep their labels: all else begins as 0, and a segment may only take 0's place with a
    label above 0 that a neighbour has."""
    fixed = seeds.select(*KEY, F.col(segment).alias("_s"), F.col("label").cast("long").alias("_f"))
    costs = unary.select(*KEY, F.col(segment).alias("_s"), F.col("cls").cast("long").alias("_c"), F.col("cost").cast("double").alias("_v")).join(fixed, [*KEY, "_s"], "left")
    kind = dict(unary.dtypes)[segment]
    return _settled(costs.select(*KEY, "_s", "_c", "_v", "_f"), edges, matrix, True).select(*KEY, F.col("_s").cast(kind).alias(segment), "label")


def _settled(costs: DataFrame, edges: DataFrame, matrix: list[list[float]], beside: bool) -> DataFrame:
    """Rows (img, _s, label): the labels of the segments of each image after rounds of conditional modes."""
    pair = np.array(matrix, float)
    e = edges.select(F.col("img").alias("_img"), F.col("src").cast("long").alias("_a"), F.col("dst").cast("long").alias("_b"), F.col("w").cast("double").alias("_w"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, row = np.unique(left.column("_s").to_numpy().astype(np.int64), return_inverse=True)
        cost = np.full((len(ids), len(pair)), np.inf)
        cost[row, left.column("_c").to_numpy()] = left.column("_v").to_numpy()
        given = np.full(len(ids), -1, np.int64)
        given[row] = left.column("_f").fill_null(-1).to_numpy()
        a, b, w = (right.column(c).to_numpy() for c in ("_a", "_b", "_w"))
        known = np.isin(a, ids) & np.isin(b, ids)
        a, b, w = np.searchsorted(ids, a[known]), np.searchsorted(ids, b[known]), w[known]
        labels = _modes(cost, np.r_[a, b], np.r_[b, a], np.r_[w, w], pair, given, beside)
        img = left.column("img")[0].as_py() if len(left) else None
        return pa.table({"img": pa.array([img] * len(ids), left.schema.field("img").type), "_s": pa.array(ids), "label": pa.array(labels.astype(np.int32))})

    kind = dict(costs.dtypes)["img"]
    return costs.groupBy(*KEY).cogroup(e.groupBy("_img")).applyInArrow(run, f"img {kind}, _s long, label int")


def _modes(cost: np.ndarray, near: np.ndarray, other: np.ndarray, w: np.ndarray, pair: np.ndarray, given: np.ndarray, beside: bool) -> np.ndarray:
    n = np.arange(len(cost))
    labels = np.where(given >= 0, given, 0) if beside else cost.argmin(axis=1)
    while True:  # the energy falls by more than 1e-9 in each round
        total = cost.copy()
        np.add.at(total, near, w[:, None] * pair[labels[other]])
        if beside:
            may = np.zeros(total.shape, bool)
            may[near, labels[other]] = labels[other] > 0
            may[n, labels] = True
            total[~may] = np.inf
        best = total.argmin(axis=1)
        gain = np.where((given >= 0) & beside, 0.0, total[n, labels] - total[n, best])
        open_ = gain > 1e-9
        if not open_.any():
            return labels
        rank = np.empty(len(n), np.int64)
        rank[np.lexsort((-n, gain))] = n
        rank[~open_] = -1
        rival = np.full(len(n), -1, np.int64)
        np.maximum.at(rival, near, rank[other])
        wins = open_ & (rank > rival)
        labels = np.where(wins, best, labels)


def components(edges: DataFrame, nodes: DataFrame, rounds: int | None = None) -> DataFrame:
    """Components of an undirected graph: (img, node, component), the smallest node reachable.

    Rounds of two steps: each node's larger neighbours, then its smaller ones and itself, are tied to the smallest of them. Rounds grow with
    the logarithm of the longest path, each is a grouped minimum and a join, and edges never become more.
    """
    checkpoint_folder(edges.sparkSession)
    e = edges.select(*KEY, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct().checkpoint()
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64(*KEY, "u", "v"))).first())
    known = mark(e)
    for _ in itertools.count() if rounds is None else range(rounds):
        both = e.union(e.select(*KEY, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*KEY, "u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, [*KEY, "u"]).select(*KEY, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(*KEY, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [*KEY, "u"]).select(*KEY, F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(low.select(*KEY, "u", F.col("m").alias("v"))).distinct()
        e = small.checkpoint()
        now = mark(e)
        if now == known:
            break
        known = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.select(*KEY, "node").join(e.select(*KEY, F.col("u").alias("node"), "v"), [*KEY, "node"], "left").select(*KEY, "node", F.coalesce("v", "node").alias("component"))


def color_edges(px: DataFrame, segment: str, channels: list[str]) -> DataFrame:
    """Mean colours as arrays: (img, segment, proba), for ``edge_weights(kind="color")``."""
    mean = segment_statistics(px, segment, channels, ("mean",))
    return mean.select(*KEY, segment, F.array(*[f"{c}_mean" for c in channels]).alias("proba"))
