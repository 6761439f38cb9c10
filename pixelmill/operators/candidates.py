"""Candidates for the centres of objects: nested levels to learn from, features of points, detection and evaluation."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators import boundary, features, labels, ml, pixelwise, spatial
from pixelmill.session import checkpoint_folder

KEY = ["img"]
LEVELS = (0.0, 0.4, 0.8)
#: Pixels of a box whose levels are found in memory, and of the boxes of an image that are dealt together.
MOST = 65_536
#: Pixels of boxes in a partition.
PIXELS = 250_000
#: Side of the cells by which boxes and pixels meet.
CELL = 16
FAR = 1 << 20


def center_levels(px: DataFrame, label: str, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Adds ``level``: 0 off objects (``label`` above 0), else how many of the nested regions around its object's centre a pixel lies in, counted from the outermost.

    A pixel's depth is its distance to the nearest pixel that isn't of its object, over the largest of the object; region k holds what is deeper than ``levels[k]``. From the second on it is cut by the circle
    around the object's centroid that has the region's area, and opened by a disk of 0.15 of that circle's radius. Objects are boxes of their own with a margin of one pixel, which holds
    every pixel next to them, so objects in one image, however many, are separate. An object that fills its image has no depth, and level 0.
    """
    checkpoint_folder(px.sparkSession)
    boxes = pixelwise.bounding_boxes(px, label, 1).checkpoint()
    area = (F.col("y1") - F.col("y0")).cast("long") * (F.col("x1") - F.col("x0"))
    top = _levels_in_memory(px, boxes.where(area <= MOST).withColumn("_bin", F.floor(F.sum(area).over(Window.partitionBy(*KEY).orderBy(label)) / MOST)), label, levels)
    if (boxes.agg(F.max(area)).first()[0] or 0) > MOST:
        top = top.union(_levels_of_large(px, boxes.where(area > MOST), label, levels))
    return px.join(top, [*KEY, "y", "x"], "left").fillna(0, ["level"])


def _levels_in_memory(px: DataFrame, boxes: DataFrame, label: str, levels: tuple[float, ...]) -> DataFrame:
    """Pixels (img, y, x, level) of a level above 0 of objects of up to ``MOST`` pixels; those of a ``_bin`` of their image are one group."""
    size = boxes.agg(F.sum((F.col("y1") - F.col("y0")).cast("long") * (F.col("x1") - F.col("x0")))).first()[0] or 0
    named = boxes.select(*KEY, F.struct("_bin", F.col(label).alias("_o"), F.col("y0").alias("_y0"), F.col("x0").alias("_x0")).alias("_box"), "y0", "x0", "y1", "x1")
    cut = pixelwise.crop(px.select(*KEY, "y", "x", F.col(label).alias("_l")), named, "_box", CELL)
    cut = cut.select(*KEY, "object.*", "y", "x", F.coalesce(F.col("_l") == F.col("object._o"), F.lit(False)).alias("own"))
    cut = cut.repartition(max(px.sparkSession.sparkContext.defaultParallelism, -(-size // PIXELS)), *KEY, "_bin")

    def run(table: pa.Table) -> pa.Table:
        o, y0, x0, y, x, own = (table.column(c).to_numpy() for c in ("_o", "_y0", "_x0", "y", "x", "own"))
        order = np.argsort(o, kind="stable")
        cuts = np.flatnonzero(np.diff(o[order])) + 1
        level = np.zeros(len(o), np.int32)
        for at in np.split(order, cuts):
            level[at] = _levels(y[at].astype(np.int64), x[at].astype(np.int64), own[at], int(y0[at[0]]), int(x0[at[0]]), levels)
        hit = level > 0
        place = [pa.array((c[hit] + c0[hit]).astype(np.int64)).cast(table.schema.field(n).type) for n, c, c0 in (("y", y, y0), ("x", x, x0))]
        return pa.table([table.column("img").filter(pa.array(hit)), *place, pa.array(level[hit])], ["img", "y", "x", "level"])

    kinds = dict(px.dtypes)
    return cut.groupBy(*KEY, "_bin").applyInArrow(run, f"img {kinds['img']}, y {kinds['y']}, x {kinds['x']}, level int")


def _levels(y: np.ndarray, x: np.ndarray, own: np.ndarray, y0: int, x0: int, levels: tuple[float, ...]) -> np.ndarray:
    """Levels of the pixels of one box, whose corner is (y0, x0); ``own`` are the object's."""
    out = np.zeros(len(y), np.int32)
    there = np.zeros((y.max() + 1, x.max() + 1), bool)
    mask = there.copy()
    there[y, x], mask[y, x] = True, own
    d2 = _squared_distances(there & ~mask)[y, x]
    if not own.any() or own.all():
        return out
    depth = np.where(own, np.sqrt(d2.astype(float)) / np.sqrt(float(d2[own].max())), -1.0)
    out[depth > levels[0]] = 1
    cy, cx = (_mean(c[own] + c0) for c, c0 in ((y, y0), (x, x0)))
    dy, dx = y + y0 - cy, x + x0 - cx
    for k, least in enumerate(levels[1:], 2):
        deep = depth > least
        r = math.floor(math.sqrt(deep.sum() / math.pi))
        deep &= dy * dy + dx * dx < r * r
        s = math.floor(r * 0.15)
        if s:  # a disk of one pixel opens nothing
            for grow in (False, True):
                mark = np.zeros_like(there)
                mark[y, x] = deep if grow else ~deep
                d2 = _squared_distances(mark)[y, x]
                deep = d2 <= s * s if grow else d2 > s * s
        out[deep] = k
    return out


def _mean(c: np.ndarray) -> float:
    low, n = int(c.min()) - 1, len(c)
    return (int(c.sum()) - n * low) / n + low


def _squared_distances(mark: np.ndarray) -> np.ndarray:
    """Squared distance of each place to the nearest mark, at least ``FAR`` squared without one: along the longer axis, then among the places of the shorter one."""
    if mark.shape[1] > mark.shape[0]:
        return _squared_distances(mark.T).T
    n, w = mark.shape
    y = np.arange(n)[:, None]
    before, after = np.maximum.accumulate(np.where(mark, y, -FAR)), np.minimum.accumulate(np.where(mark, y, n + FAR)[::-1])[::-1]
    near = np.minimum(y - before, after - y) ** 2
    apart = (np.arange(w)[:, None] - np.arange(w)) ** 2
    out, step = np.empty((n, w), np.int64), max(1, MOST // (w * w))
    for a in range(0, n, step):
        out[a : a + step] = (near[a : a + step, None] + apart).min(axis=2)
    return out


def _levels_of_large(px: DataFrame, boxes: DataFrame, label: str, levels: tuple[float, ...]) -> DataFrame:
    """As ``_levels_in_memory`` for objects of any size: a pixel is one row throughout."""
    cut = pixelwise.crop(px.select(*KEY, "y", "x", F.col(label).alias("_l")), boxes, label)
    cut = cut.select(F.struct("img", F.col("object")).alias("img"), "y", "x", (F.col("_l") == F.col("object")).alias("own"))
    deep = labels.distance_to(cut.withColumn("_out", F.when(F.coalesce("own", F.lit(False)), 0).otherwise(1)), "_out").where("own").select(*KEY, "y", "x", F.col("d2").cast("double").alias("d2"))
    # centroids in places of the image, counted from a pixel before the object, so that equal distances to the circle are rounded alike whatever the box
    corner = boxes.select(F.struct("img", F.col(label).alias("object")).alias("img"), "y0", "x0")
    deep = deep.join(corner, KEY).withColumns({"_ay": F.col("y") + F.col("y0"), "_ax": F.col("x") + F.col("x0")}).drop("y0", "x0")
    mean = lambda c: (F.sum(c) - F.count("*") * (F.min(c) - 1)) / F.count("*") + (F.min(c) - 1)
    of = deep.groupBy(*KEY).agg(F.max("d2").alias("_top"), mean("_ay").alias("_cy"), mean("_ax").alias("_cx"))
    deep = deep.join(of, KEY).withColumn("depth", F.sqrt("d2") / F.sqrt("_top")).select(*KEY, "y", "x", "depth", "_ay", "_ax", "_cy", "_cx").checkpoint()
    frame = cut.select(*KEY, "y", "x").checkpoint()
    found = [deep.where(F.col("depth") > levels[0]).select(*KEY, "y", "x", F.lit(1).alias("level"))]
    for k, least in enumerate(levels[1:], 2):
        mask = deep.where(F.col("depth") > least)
        radius = mask.groupBy(*KEY).agg(F.floor(F.sqrt(F.count("*") / math.pi)).alias("_r"))
        dy, dx = F.col("_ay") - F.col("_cy"), F.col("_ax") - F.col("_cx")
        mask = mask.join(radius, KEY).where(dy * dy + dx * dx < F.col("_r") * F.col("_r")).select(*KEY, "y", "x", F.lit(1).alias("_m"))
        reach = radius.select(*KEY, F.floor(F.col("_r") * 0.15).alias("_s"))
        shrunk = _within(frame.join(mask, [*KEY, "y", "x"], "left").withColumn("_mark", F.when(F.col("_m") == 1, 0).otherwise(1)), reach, False)
        grown = _within(frame.join(shrunk.withColumn("_mark", F.lit(1)), [*KEY, "y", "x"], "left"), reach, True)
        found.append(grown.withColumn("level", F.lit(k)))
    top = reduce(DataFrame.union, found).groupBy(*KEY, "y", "x").agg(F.max("level").alias("level"))
    top = top.select(F.col("img.img").alias("img"), F.col("img.object").alias("_o"), F.col("y").alias("_y"), F.col("x").alias("_x"), "level")
    top = top.join(boxes.select(*KEY, F.col(label).alias("_o"), "y0", "x0"), [*KEY, "_o"])
    kinds = dict(px.dtypes)
    place = [(F.col(f"_{c}") + F.col(f"{c}0")).cast(kinds[c]).alias(c) for c in ("y", "x")]
    return top.select(*KEY, *place, "level")


def _within(marked: DataFrame, reach: DataFrame, near: bool) -> DataFrame:
    """Places whose nearest mark is at most as far as their image's ``_s`` (``near``), or farther or missing."""
    d = labels.distance_to(marked.select(*KEY, "y", "x", "_mark"), "_mark").join(reach, KEY)
    limit = F.col("_s") * F.col("_s")
    return d.where(F.col("d2") <= limit if near else F.col("d2").isNull() | (F.col("d2") > limit)).select(*KEY, "y", "x")


def smoothed_rays(distances: str | Column, sigma: float) -> Column:
    """Distances along the circle of rays under a Gaussian of ``sigma`` rays; as they are if it is 0."""
    d = F.col(distances) if isinstance(distances, str) else distances
    if not sigma:
        return d
    reach = math.ceil(4 * sigma)
    weights = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    total = sum(weights)
    at = lambda i, k: d[F.pmod(i + k, F.size(d)).cast("int")]
    return F.transform(d, lambda v, i: reduce(Column.__add__, [at(i, k) * (w / total) for k, w in zip(range(-reach, reach + 1), weights, strict=True)]))


def point_features(px: DataFrame, label: str, points: DataFrame, classes: list[int], radii: list[int] | None = (10, 50, 100, 200, 300), step: int | None = 15, kinds: tuple[tuple[str, tuple[int, ...]], ...] = (("up", (0,)),), closer: bool = True, smooth: float = 0.0) -> DataFrame:
    """Points (img, idx, y, x) with ``features``: shares of ``classes`` of ``label`` in the rings between ``radii``, then rays.

    Rays go to the edge of the mask of some labels, for each of ``kinds``; with ``closer`` and several kinds each ray is the shortest of them, that reaches an edge, else
    kinds follow one another. Each is turned to start with its longest. A ray that leaves the image is -1; a ring without pixels has shares of 0. ``radii`` or ``step`` may be None,
    not both.
    """
    parts = []
    if radii:
        n = features.disk_histogram(px, label, points, list(radii)).where(F.col(label).isin(list(classes)))
        grid = points.select(*KEY, "idx").withColumn("radius", F.explode(F.array(*map(F.lit, sorted(radii))))).withColumn("_c", F.explode(F.array(*map(F.lit, classes))))
        share = grid.join(n.select(*KEY, "idx", "radius", F.col(label).alias("_c"), (F.col("n") / F.col("size")).alias("_v")), [*KEY, "idx", "radius", "_c"], "left")
        listed = share.groupBy(*KEY, "idx").agg(F.sort_array(F.collect_list(F.struct("radius", "_c", F.coalesce("_v", F.lit(0.0)).alias("v")))).alias("l"))
        parts.append(listed.select(*KEY, "idx", F.transform("l", lambda e: e["v"]).alias("_hist")))
    if step:
        made = []
        for k, (edge, of) in enumerate(kinds):
            on = px.select(*KEY, "y", "x", F.coalesce(F.col(label).isin(list(of)).cast("int"), F.lit(0)).alias("_m"))
            r = boundary.ray_arrays(spatial.rays(on, "_m", points, step, edge))
            made.append(r.select(*KEY, "idx", smoothed_rays("distances", smooth).alias(f"_r{k}")))
        rays = reduce(lambda a, b: a.join(b, [*KEY, "idx"]), made)
        names = [f"_r{k}" for k in range(len(kinds))]
        if closer and len(kinds) > 1:
            best = lambda i: F.least(*[F.when(F.col(n)[i] >= 0, F.col(n)[i]) for n in names])  # noqa: E731  least leaves nulls out
            rays = rays.withColumn("_r", F.transform("_r0", lambda _, i: F.coalesce(best(i), F.lit(-1.0))))
            names = ["_r"]
        for n in names:
            rays = rays.withColumn(n, spatial.shifted_to_longest(n))
        parts.append(rays.select(*KEY, "idx", F.concat(*names).alias("_rays")))
    out = reduce(lambda a, b: a.join(b, [*KEY, "idx"], "left"), parts, points)
    return out.withColumn("features", F.concat(*[c for c, on in ((F.col("_hist"), radii), (F.col("_rays"), step)) if on])).drop("_hist", "_rays")


def label_close_points(points: DataFrame, centres: DataFrame | None = None, limit: float = 50.0, regions: DataFrame | None = None, region: str = "level") -> DataFrame:
    """Points with ``label``: whether one of the centres (img, y, x) is at most ``limit`` away, or, where ``regions`` are given, the value of the pixel that a point lies in.

    Without either it is -1, and 0 for points off the raster. Points and centres meet by cells as wide as the limit.
    """
    if regions is not None:
        at = points.withColumns({"_y": F.floor("y").cast("long"), "_x": F.floor("x").cast("long")})
        r = regions.select(*KEY, F.col("y").cast("long").alias("_y"), F.col("x").cast("long").alias("_x"), F.col(region).cast("int").alias("label"))
        return at.join(r, [*KEY, "_y", "_x"], "left").drop("_y", "_x").fillna(0, ["label"])
    if centres is None:
        return points.withColumn("label", F.lit(-1))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    cell = lambda c: F.floor(F.col(c) / limit)
    c = centres.select(*KEY, F.col("y").alias("_y"), F.col("x").alias("_x")).distinct().withColumn("_dy", F.explode(around)).withColumn("_dx", F.explode(around))
    c = c.withColumns({"_cy": F.floor(F.col("_y") / limit) + F.col("_dy"), "_cx": F.floor(F.col("_x") / limit) + F.col("_dx")})
    p = points.select(*KEY, "idx", "y", "x", cell("y").alias("_cy"), cell("x").alias("_cx"))
    d2 = (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")) + (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x"))
    close = p.join(c, [*KEY, "_cy", "_cx"]).where(d2 <= limit * limit).select(*KEY, "idx").distinct().withColumn("label", F.lit(1))
    return points.join(close, [*KEY, "idx"], "left").fillna(0, ["label"])


def detect(model: PipelineModel, points: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """Of points with features, those a classifier calls centres (prediction 1), and their clusters (img, cluster, n, y, x) by steps of at most ``limit``."""
    checkpoint_folder(points.sparkSession)
    found = ml.probabilities(model, points.where("features is not null")).where("prediction = 1").drop("prediction", "proba").checkpoint()
    return found, spatial.cluster_points(found.select(*KEY, "idx", "y", "x"), limit)


def evaluate(centres: DataFrame, truth: DataFrame, limit: float) -> DataFrame:
    """A row an image: (img, centres, detected, tp, fp, fn), where a detected centre (img, cluster, y, x) and a true one (img, idx, y, x) belong together if each is the
    nearest of the other, at most ``limit`` away; of equally near ones the smallest number."""
    cells = lambda c: F.floor(F.col(c) / limit)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = centres.select(*KEY, "cluster", F.col("y").alias("_y"), F.col("x").alias("_x")).withColumns({"_cy": cells("_y"), "_cx": cells("_x")})
    t = truth.select(*KEY, "idx", "y", "x").withColumn("_dy", F.explode(around)).withColumn("_dx", F.explode(around))
    t = t.withColumns({"_cy": cells("y") + F.col("_dy"), "_cx": cells("x") + F.col("_dx")})
    d2 = (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")) + (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x"))
    pairs = a.join(t, [*KEY, "_cy", "_cx"]).select(*KEY, "cluster", "idx", d2.cast("double").alias("d")).where(F.col("d") <= limit * limit)
    mine = pairs.groupBy(*KEY, "cluster").agg(F.min(F.struct("d", "idx")).alias("m")).select(*KEY, "cluster", F.col("m.idx").alias("idx"))
    theirs = pairs.groupBy(*KEY, "idx").agg(F.min(F.struct("d", "cluster")).alias("m")).select(*KEY, F.col("m.cluster").alias("cluster"), "idx")
    tp = mine.join(theirs, [*KEY, "cluster", "idx"]).groupBy(*KEY).agg(F.count("*").alias("tp"))
    n = truth.groupBy(*KEY).agg(F.count("*").alias("centres")).join(centres.groupBy(*KEY).agg(F.count("*").alias("detected")), KEY, "full").join(tp, KEY, "left").fillna(0, ["centres", "detected", "tp"])
    return n.select(*KEY, "centres", "detected", "tp", (F.col("detected") - F.col("tp")).alias("fp"), (F.col("centres") - F.col("tp")).alias("fn"))
