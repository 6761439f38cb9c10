"""Boundaries of objects by rays: interpolation, points, ellipses by random samples, and shape models."""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators import ml, pixelwise, segmentation, spatial, spectral
from pixelmill.session import checkpoint_folder

KEY = ["img"]


def ray_arrays(rays: DataFrame) -> DataFrame:
    """Rows (img, idx, distances) of rays (img, idx, angle, distance), in the order of their angles."""
    return rays.groupBy(*KEY, "idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("angle", "distance"))), lambda r: r["distance"]).alias("distances"))


def _periodic_spline(at: np.ndarray, value: np.ndarray, n: int, want: np.ndarray) -> np.ndarray:
    """The cubic spline of period n through the points, at other places."""
    m = len(at)
    if m < 3:
        return np.interp(want, np.r_[at - n, at, at + n], np.r_[value, value, value])
    h = np.diff(np.r_[at, at[0] + n]).astype(float)
    slope = np.diff(np.r_[value, value[0]]) / h
    a = np.zeros((m, m))
    k = np.arange(m)
    a[k, k] = 2 * (h + h[k - 1])
    a[k, (k + 1) % m] += h
    a[k, k - 1] += h[k - 1]
    bend = np.linalg.solve(a, 6 * (slope - slope[k - 1]))
    place = (want - at[0]) % n + at[0]
    j = np.searchsorted(at, place, side="right") - 1
    t, nxt = place - at[j], (j + 1) % m
    return value[j] + t * (slope[j] - h[j] * (2 * bend[j] + bend[nxt]) / 6) + t**2 * bend[j] / 2 + t**3 * (bend[nxt] - bend[j]) / (6 * h[j])


def interpolated(kind: str | int):
    """A column function that fills distances of -1: by a periodic cubic ``spline``, the first harmonic (``cos``), or a polynomial of a degree."""

    def fill(v: np.ndarray) -> np.ndarray:
        v = np.array(v, float)
        x, gaps = np.arange(len(v)), v == -1
        if gaps.all() or not gaps.any():
            return v
        if kind == "spline":
            v[gaps] = _periodic_spline(x[~gaps], v[~gaps], len(v), x[gaps])
        else:
            w = 2 * math.pi * x / len(v)
            base = np.stack([np.ones(len(v)), np.sin(w), np.cos(w)], 1) if kind == "cos" else np.vander(x / len(v), int(kind) + 1)
            v[gaps] = (base @ np.linalg.lstsq(base[~gaps], v[~gaps], rcond=None)[0])[gaps]
        return v

    @F.pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda v: None if v is None else fill(v))

    return run


def reconstructed(arrays: DataFrame, shift: float = 0.0) -> DataFrame:
    """Points (img, idx, k, y, x) at the ends of rays (img, idx, y, x, distances) around a place; rays that met nothing (negative, infinite) give none.

    Ray k of n points along 90 - 360 * k / n - shift degrees, measured from the first axis (y) to the second.
    """
    each = arrays.select(*KEY, "idx", F.col("y").cast("double").alias("_y"), F.col("x").cast("double").alias("_x"), F.size("distances").alias("_n"), F.posexplode("distances").alias("k", "_d"))
    angle = F.lit(math.pi / 2) - 2 * math.pi * F.col("k") / F.col("_n") - math.radians(shift)
    ok = (F.col("_d") >= 0) & (F.col("_d") < float("inf"))
    return each.where(ok).select(*KEY, "idx", "k", (F.col("_y") + F.cos(angle) * F.col("_d")).alias("y"), (F.col("_x") + F.sin(angle) * F.col("_d")).alias("x"))


def split_layers(px: DataFrame, label: str, open_background: int, open_foreground: int) -> DataFrame:
    """Adds ``background`` (what isn't in objects with their holes filled, opened by a disk) and ``foreground`` (label 1, opened)."""
    out = pixelwise.fill_holes(px.withColumn("_any", (F.col(label) > 0).cast("int")), "_any")
    out = out.withColumns({"background": 1 - F.col("_any"), "foreground": (F.col(label) == 1).cast("int")}).drop("_any")
    for name, r in (("background", open_background), ("foreground", open_foreground)):
        out = segmentation.opened(out, name, r) if r > 0 else out
    return out


def boundary_points(px: DataFrame, label: str, centres: DataFrame, kind: str = "dist", close: float = 5, least: float = 25.0, open_background: int = 15, open_foreground: int = 5, step: int = 5) -> DataFrame:
    """Boundary points (img, idx, k, y, x) of the objects around centres (img, idx, y, x), by rays to the background and out of the foreground.

    ``join``: the ends of both; ``edge``: the nearer end of each angle; ``mean``: their mean where both are there; ``dist``: the background only, each
    point going to its nearest centre. Rays are at least ``least`` long (not for dist); points nearer than ``close`` to each other are thinned.
    """
    checkpoint_folder(px.sparkSession)
    px = px.select(*KEY, "y", "x", label).checkpoint()
    layers = split_layers(px, label, open_background, open_foreground).checkpoint()
    place = centres.select(*KEY, "idx", "y", "x")
    back = ray_arrays(spatial.rays(layers, "background", place, step, "up")).withColumnRenamed("distances", "_b")
    if kind == "dist":
        ends = reconstructed(place.join(back.withColumnRenamed("_b", "distances"), [*KEY, "idx"]))
        thin = thinned(ends, close, [*KEY, "idx"])
        near = spatial.nearest(thin.select(*KEY, F.struct("idx", "k").alias("idx"), "y", "x"), place.select(*KEY, F.col("idx").alias("c"), F.col("y").alias("cy"), F.col("x").alias("cx")))
        return near.select(*KEY, F.col("c").alias("idx"), F.col("idx.k").alias("k"), "y", "x")
    fore = ray_arrays(spatial.rays(layers, "foreground", place, step, "down")).withColumnRenamed("distances", "_f")
    both = place.join(back, [*KEY, "idx"]).join(fore, [*KEY, "idx"])
    if kind == "join":
        floor = lambda c: F.transform(c, lambda v: F.greatest(v, F.lit(float(least))))
        parts = [thinned(reconstructed(both.select(*KEY, "idx", "y", "x", floor(c).alias("distances"))), close, [*KEY, "idx"]) for c in ("_b", "_f")]
        return parts[0].unionByName(parts[1].withColumn("k", F.col("k") + 360 // step))
    far = lambda v: F.when(v < 0, float("inf")).otherwise(F.greatest(v, F.lit(float(least))))
    if kind == "edge":
        d = F.zip_with("_b", "_f", lambda b, f: F.least(far(b), far(f)))
    elif kind == "mean":
        d = F.zip_with("_b", "_f", lambda b, f: F.when((b < 0) | (f < 0), F.least(far(b), far(f))).otherwise((far(b) + far(f)) / 2))
    else:
        raise ValueError(f"unknown kind of boundary points {kind}")
    return thinned(reconstructed(both.select(*KEY, "idx", "y", "x", d.alias("distances"))), close, [*KEY, "idx"])


def thinned(points: DataFrame, limit: float, keys: list[str]) -> DataFrame:
    """Points (keys, k, y, x) of which, within each group, the later one of the closest pair goes until none is nearer than ``limit``.

    A group is the boundary of one object, a point an angle; ``spatial.thin_points`` does the same for groups of any size.
    """
    if limit <= 0:
        return points
    points = points.select(*keys, "k", "y", "x")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        y, x = (table.column(c).to_numpy().astype(float) for c in ("y", "x"))
        far = (y[:, None] - y) ** 2 + (x[:, None] - x) ** 2
        far[np.tril_indices(len(y))] = np.inf
        keep = np.ones(len(y), bool)
        while len(y) and far.min() < limit * limit:
            gone = int(far.argmin()) % len(y)
            keep[gone] = False
            far[gone], far[:, gone] = np.inf, np.inf
        return table.filter(pa.array(keep))

    return points.groupBy(*keys).applyInArrow(run, points.schema)


def boundary_superpixels(sp: DataFrame, edges: DataFrame, segment: str) -> DataFrame:
    """Superpixels (img, segment, c_y, c_x, label) on the border of objects: background ones beside an object, and those of label 1 beside the background.

    ``edges`` (img, src, dst) say which superpixels touch.
    """
    both = edges.select(*KEY, F.col("src").alias(segment), F.col("dst").alias("_n")).union(edges.select(*KEY, "dst", "src"))
    beside = both.join(sp.select(*KEY, F.col(segment).alias("_n"), F.col("label").alias("_l")), [*KEY, "_n"])
    share = beside.groupBy(*KEY, segment).agg(F.avg((F.col("_l") == 0).cast("double")).alias("_bg"))
    j = sp.join(share, [*KEY, segment])
    return j.where("(label = 0 and _bg < 1) or (label = 1 and _bg > 0)").drop("_bg")


def radial_residual(y: Column, x: Column, cy: Column, cx: Column, a: Column, b: Column, theta: Column) -> Column:
    """How far a point lies from an ellipse, along the ray from its centre."""
    dx, dy = x - cx, y - cy
    u, v = (dx * F.cos(theta) + dy * F.sin(theta)) / a, (dy * F.cos(theta) - dx * F.sin(theta)) / b
    r = F.sqrt(u * u + v * v)
    return F.when(r > 0, F.abs(1 - 1 / r) * F.sqrt(dx * dx + dy * dy)).otherwise(F.least(a, b))


def ransac_ellipses(points: DataFrame, regions: DataFrame, foreground: tuple[float, ...], share: float = 0.6, residual: float = 1.0, trials: int = 100, seed: int = 0) -> DataFrame:
    """Ellipses (img, idx, cy, cx, a, b, theta, crit) of objects by random samples of their boundary points (img, idx, k, y, x).

    In each trial the ``share`` of an object's points with the smallest seeded hashes is fitted; the trial with the least ``spatial.criterion`` over
    the superpixels ``regions`` (img, idx, y, x, label, weight) wins, and its ellipse is fitted again to the points within ``residual`` of it. All objects
    and trials are fitted in one plan.
    """
    if not 0 < share <= 1 or trials < 1:
        raise ValueError("the share has to be in (0, 1], and trials positive")
    rows = points.select(*KEY, "idx", "k", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    each = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    of = Window.partitionBy(*KEY, "idx", "trial")
    chosen = each.withColumn("_r", F.row_number().over(of.orderBy(F.xxhash64("k", "trial", F.lit(seed)), "k"))).withColumn("_n", F.count("*").over(of)).where(F.col("_r") <= F.floor(F.col("_n") * share))
    fits = spatial.ellipse_from_points(chosen.select(*KEY, "idx", "trial", "y", "x"), [*KEY, "idx", "trial"]).where("a is not null")
    fits = fits.withColumn("e", F.struct("idx", "trial"))
    crit = spatial.criterion(regions, fits, foreground).select(*KEY, "e.idx", "e.trial", "crit")
    best = crit.join(fits.drop("e"), [*KEY, "idx", "trial"]).groupBy(*KEY, "idx").agg(F.min(F.struct("crit", "trial", "cy", "cx", "a", "b", "theta")).alias("m")).select(*KEY, "idx", "m.*")
    inside = rows.join(best, [*KEY, "idx"]).where(radial_residual(*[F.col(c) for c in ("y", "x", "cy", "cx", "a", "b", "theta")]) < residual)
    again = spatial.ellipse_from_points(inside.select(*KEY, "idx", "y", "x"), [*KEY, "idx"])
    refit = again.select(*KEY, "idx", *[F.col(c).alias(f"_{c}") for c in ("cy", "cx", "a", "b", "theta")])
    return best.join(refit, [*KEY, "idx"], "left").select(*KEY, "idx", *[F.when(F.col("_a").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("cy", "cx", "a", "b", "theta")], "crit")


def best_overlap(ellipses: DataFrame, px: DataFrame, label: str) -> DataFrame:
    """Of the ellipses (img, e, ...) those that overlap each object most, in share of the union: (img, label, e, jaccard), the smallest e of equals."""
    drawn = spatial.draw_ellipses(px, ellipses)
    size = drawn.groupBy(*KEY, "e").agg(F.count("*").alias("_e"))
    objects = px.where(F.col(label) > 0).groupBy(*KEY, label).agg(F.count("*").alias("_o"))
    both = drawn.join(px.where(F.col(label) > 0), [*KEY, "y", "x"]).groupBy(*KEY, "e", label).agg(F.count("*").alias("_s"))
    j = both.join(size, [*KEY, "e"]).join(objects, [*KEY, label]).withColumn("jaccard", F.col("_s") / (F.col("_e") + F.col("_o") - F.col("_s")))
    return j.groupBy(*KEY, label).agg(F.max_by(F.struct("e", "jaccard"), F.struct("jaccard", -F.col("e"))).alias("m")).select(*KEY, label, "m.*")


def object_shapes(px: DataFrame, label: str, step: int = 10) -> DataFrame:
    """Rays of each object (label > 0) from its centroid to its own edge, turned to the longest first: (img, object, y, x, distances, angle).

    ``angle`` is where the longest ray pointed.
    """
    checkpoint_folder(px.sparkSession)
    px = px.select(*KEY, "y", "x", label).checkpoint()
    centre = px.where(F.col(label) > 0).groupBy(*KEY, F.col(label).alias("idx")).agg(F.avg("y").alias("y"), F.avg("x").alias("x"))
    out = ray_arrays(spatial.rays(px, label, centre, step, "down", own=True))
    j = centre.join(out, [*KEY, "idx"])
    turn = (F.array_position("distances", F.array_max("distances")) - 1) * step
    return j.select(*KEY, F.col("idx").alias("object"), "y", "x", spatial.shifted_to_longest("distances").alias("distances"), turn.cast("int").alias("angle"))


def _beyond(d: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """The share of a normal distribution above each d."""
    return np.array([0.5 * math.erfc((x - m) / (s * math.sqrt(2))) for x, m, s in zip(d.ravel(), mean.ravel(), std.ravel(), strict=True)]).reshape(d.shape)


def shape_models(shapes: DataFrame, kind: str = "mixture", classes: int = 3, reach: int | None = None, seed: int = 1) -> DataFrame:
    """Tables (model, weight, a, d, p): the chance p that a shape reaches beyond distance d at its angle number a.

    ``mixture``: classes of ray vectors (img, object, distances) by a Gaussian mixture; ``kmeans``: by k-means, with each class's deviations; ``spectral``: the same by spectral clustering;
    ``hist``: shares of the shapes themselves, one model. Of models a row each, and of tables angles times reach, are held by the driver.
    """
    spark = shapes.sparkSession
    checkpoint_folder(spark)
    rows = shapes.select("distances").withColumn("distances", F.transform("distances", lambda v: v.cast("double"))).checkpoint()  # each fit reads them again and again
    top = int(rows.agg(F.max(F.array_max("distances"))).first()[0]) + 1
    reach = reach or max(2, int(1.5 * top))
    if kind == "hist":
        each = rows.select(F.posexplode("distances").alias("a", "v"))
        n = each.groupBy("a").agg(F.count("*").alias("_t"))
        grid = n.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(reach - 1))))
        at = each.groupBy("a", F.floor("v").cast("int").alias("d")).agg(F.count("*").alias("_c"))
        up = F.sum(F.coalesce("_c", F.lit(0))).over(Window.partitionBy("a").orderBy("d"))
        return grid.join(at, ["a", "d"], "left").select(F.lit(0).alias("model"), F.lit(1.0).alias("weight"), "a", "d", ((F.col("_t") - up) / F.col("_t")).alias("p"))
    features = rows.select(F.col("distances").alias("features"))
    model = ml.class_model(features, classes, scale=False, kind=kind, seed=seed) if classes > 1 and kind != "spectral" else None
    if kind == "mixture" and model:
        last = model.stages[-1]
        means = np.array([g.mean.toArray() for g in last.gaussians])
        stds = np.array([np.sqrt(np.maximum(np.diag(g.cov.toArray()), 1e-6)) for g in last.gaussians])
        weights = np.array(last.weights)
    else:
        if kind == "spectral" and classes > 1:
            made = spectral.cluster(features, classes, seed=seed).withColumnRenamed("cluster", "prediction").where("prediction is not null")
        else:
            made = ml.probabilities(model, features) if model else features.withColumn("prediction", F.lit(0))
        made = made.select("prediction", F.posexplode("features").alias("a", "v"))
        stats = made.groupBy("prediction", "a").agg(F.avg("v"), F.stddev_pop("v"), F.count("*")).orderBy("prediction", "a").collect()
        names = sorted({r[0] for r in stats})
        means, stds = (np.array([[r[c] for r in stats if r[0] == k] for k in names]) for c in (2, 3))
        counts = np.array([next(r[4] for r in stats if r[0] == k) for k in names], float)
        weights, stds = counts / counts.sum(), np.maximum(stds, 1e-3)
    d = np.arange(reach, dtype=float)
    out: list[tuple] = []
    for k, w in enumerate(weights):
        for a in range(means.shape[1]):
            p = _beyond(d, np.full(reach, means[k, a]), np.full(reach, stds[k, a]))
            out += [(k, float(w), a, int(x), float(v)) for x, v in zip(d, p, strict=True)]
    return spark.createDataFrame(out, "model int, weight double, a int, d int, p double")


def mean_table(models: DataFrame) -> DataFrame:
    """One table (a, d, p) of several models, by their weights."""
    return models.groupBy("a", "d").agg((F.sum(F.col("weight") * F.col("p")) / F.sum("weight")).alias("p"))


def shape_costs(segments: DataFrame, objects: DataFrame, table: DataFrame, angles: int, reach: int, least: float = 1e-3) -> DataFrame:
    """Rows (img, segment, cls, shape_cost): -log of the chance that object cls (img, cls, y, x, angle) reaches to a segment (img, segment, c_y, c_x); table as for ``ml.shape_prior``."""
    j = segments.select(*KEY, "segment", "c_y", "c_x").join(objects, KEY)
    turn = F.radians(F.col("angle").cast("double"))
    dy, dx = F.col("c_y") - F.col("y"), F.col("c_x") - F.col("x")
    # the prior counts its angles from dx; places are turned so that the longest ray comes first
    p = j.withColumns({"dx": dy * F.cos(turn) - dx * F.sin(turn), "dy": dy * F.sin(turn) + dx * F.cos(turn)})
    return ml.shape_prior(p, table, angles, reach).select(*KEY, "segment", "cls", (-F.log(F.greatest("prior", F.lit(least)))).alias("shape_cost"))


def grow_shapes(px: DataFrame, unary: DataFrame, edges: DataFrame, seeds: DataFrame, matrix: list[list[float]], table: DataFrame, angles: int, reach: int, segment: str = "lb", strength: float = 1.0, most: int | None = None) -> DataFrame:
    """Region growing with a shape prior: (img, segment, label).

    Objects grow from ``seeds`` (img, segment, label) by ``segmentation.grow_regions``, where an object's cost of a segment has the shape's cost added, seen
    from its present centre and direction. Then centres and directions are taken anew from the regions, and they grow again, until an image's labels are
    ones that it had before: these stand, and the image leaves the turns, so that none waits for others. With ``most`` given, it is an error if some
    image isn't done within so many turns.
    """
    checkpoint_folder(px.sparkSession)
    y, x = (F.col(c).cast("long") for c in ("y", "x"))
    sums = {"_n": F.lit(1), "_y": y, "_x": x, "_yy": y * y, "_xx": x * x, "_yx": y * x}
    # each turn reads all of these, pixels only as the whole-number sums of their segments
    of_segment = px.groupBy(*KEY, segment).agg(F.avg("y").alias("c_y"), F.avg("x").alias("c_x"), *[F.sum(v).alias(k) for k, v in sums.items()]).checkpoint()
    unary, edges, cells, seeds = (d.checkpoint() for d in (unary, edges, ml.prior_cells(table, angles, reach), seeds.select(*KEY, segment, "label")))
    labels = seeds
    places = of_segment.select(*KEY, F.col(segment).alias("segment"), "c_y", "c_x")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    spread = lambda a, b, ab: (whole("_n") * whole(ab) - whole(a) * whole(b)).cast("double")  # noqa: E731  n^2 times the covariance
    left = unary.select(*KEY).distinct().withColumn("_seen", F.array().cast("array<long>")).checkpoint()
    done: list[DataFrame] = []
    for _ in itertools.count() if most is None else range(most):
        m = of_segment.join(labels.where("label > 0"), [*KEY, segment]).groupBy(*KEY, F.col("label").alias("cls")).agg(*[F.sum(k).alias(k) for k in sums])
        across = spread("_x", "_x", "_xx") - spread("_y", "_y", "_yy")
        objects = m.select(*KEY, "cls", (F.col("_y") / F.col("_n")).alias("y"), (F.col("_x") / F.col("_n")).alias("x"), F.bround(F.degrees(0.5 * F.atan2(2 * spread("_y", "_x", "_yx"), across))).cast("int").alias("angle"))
        costs, near = (d.join(left.select(*KEY), KEY, "left_semi") for d in (unary, edges))
        cost = shape_costs(places, objects, cells, angles, reach).withColumnRenamed("segment", segment)
        both = costs.join(cost, [*KEY, segment, "cls"], "left").select(*KEY, segment, "cls", (F.col("cost") + strength * F.coalesce("shape_cost", F.lit(0.0))).alias("cost"))
        labels = segmentation.grow_regions(both, near, seeds, matrix, segment).checkpoint()
        marks = labels.groupBy(*KEY).agg(F.bit_xor(F.xxhash64(segment, "label")).alias("_m"))
        state = marks.join(left, KEY).select(*KEY, F.array_contains("_seen", F.col("_m")).alias("_done"), F.array_append("_seen", F.col("_m")).alias("_seen")).checkpoint()
        gone, all_ = state.agg(F.count_if("_done"), F.count("*")).first()
        if gone:
            done.append(labels.join(state.where("_done").select(*KEY), KEY, "left_semi"))
        if gone == all_:
            return reduce(DataFrame.union, done) if done else labels
        left = state.where("not _done")
    raise RuntimeError(f"shapes did not settle in {most} turns")
