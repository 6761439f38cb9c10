"""Joins by place: nearest centres, slices of a stack, shapes, objects and their centres, thinning."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators.graph import components
from pixelmill.session import checkpoint_folder

KEY = ["img"]
#: Points of a partition whose pairs are compared.
POINTS = 50_000
#: Rays of a partition whose steps meet pixels.
RAYS = 5_000
#: Slices that still belong to an object, by its stage (fixed values of the data format).
SLICE_TOLERANCE = {1: 1, 2: 2, 3: 2, 4: 3, 5: 3, 6: 0}


def slice_groups(info: DataFrame, stages: list[int], tolerance: dict[int, int] = SLICE_TOLERANCE) -> DataFrame:
    """Annotations of a stack whose slices are near: (id, near) for ``info(id, stack, slice_index, stage)``.

    A row of a chosen stage meets all chosen rows of its stack whose own tolerance reaches its slice. Rows are dealt by stack and by runs
    of slices as long as the widest tolerance, so a stack of any length is split.
    """
    width = max(1, *tolerance.values())
    chosen = info.where(F.col("stage").isin(stages))
    tol = F.create_map(*[F.lit(v) for kv in tolerance.items() for v in kv])
    a = chosen.select("id", "stack", F.col("slice_index").alias("_s"), F.floor(F.col("slice_index") / width).alias("_c"))
    b = chosen.select("stack", F.col("id").alias("near"), F.col("slice_index").alias("_t"), tol[F.col("stage")].alias("_r"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("slice_index") / width) + d)).alias("_c"))
    return a.join(b, ["stack", "_c"]).where(F.abs(F.col("_s") - F.col("_t")) <= F.col("_r")).select("id", "near")


def nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Adds to points (img, idx, y, x) their nearest centre (img, c, cy, cx) and its distance, the smallest number of equals.

    An image has few centres; they are joined by image, whatever their number.
    """
    d2 = (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) + (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx"))
    best = points.join(centres, KEY).groupBy(*KEY, "idx", "y", "x").agg(F.min(F.struct(d2.cast("double").alias("d2"), F.col("c"))).alias("_b"))
    return best.select(*KEY, "idx", "y", "x", F.col("_b.c").alias("c"), F.sqrt("_b.d2").alias("distance"))


def label_points(near: DataFrame, limit: float) -> DataFrame:
    """Label 1 for points within the limit of their nearest centre, else 0."""
    return near.withColumn("label", (F.col("distance") <= limit).cast("int"))


def in_ellipse(y: Column, x: Column, cy: Column, cx: Column, a: Column, b: Column, theta: Column) -> Column:
    """Whether a pixel lies in an ellipse with half axes a (along theta, from the x axis) and b."""
    dx, dy = x - cx, y - cy
    u, v = dx * F.cos(theta) + dy * F.sin(theta), dy * F.cos(theta) - dx * F.sin(theta)
    return (u / a) * (u / a) + (v / b) * (v / b) <= 1


def in_boxes(px: DataFrame, ellipses: DataFrame) -> DataFrame:
    """Pixels or points (img, y, x, ...) joined with the ellipses (img, e, cy, cx, a, b, theta) they lie in; both meet by cells of bounding boxes."""
    cell = 16
    r = F.greatest("a", "b")
    p = px.withColumns({"_cy": F.floor(F.col("y") / cell), "_cx": F.floor(F.col("x") / cell)})
    # an ellipse may be far larger than its image; cells without pixels are left out
    ends = p.groupBy(*KEY).agg(*[g(c).alias(f"{n}{c}") for c in ("_cy", "_cx") for n, g in (("_lo", F.min), ("_hi", F.max))])
    boxes = ellipses.join(ends, KEY)
    for c, at in (("_cy", "cy"), ("_cx", "cx")):
        first, last = F.greatest(F.floor((F.col(at) - r) / cell), F.col(f"_lo{c}")), F.least(F.floor((F.col(at) + r) / cell), F.col(f"_hi{c}"))
        boxes = boxes.withColumn(c, F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))))
    boxes = boxes.select(*ellipses.columns, "_cy", "_cx")
    return p.join(boxes, [*KEY, "_cy", "_cx"]).where(in_ellipse(*[F.col(c) for c in ("y", "x", "cy", "cx", "a", "b", "theta")])).drop("_cy", "_cx")


def draw_ellipses(px: DataFrame, ellipses: DataFrame) -> DataFrame:
    """Pixels in ellipses (img, e, cy, cx, a, b, theta): (img, y, x, e)."""
    return in_boxes(px.select(*KEY, "y", "x"), ellipses).select(*KEY, "y", "x", "e")


def ellipse_overlap(px: DataFrame, ellipses: DataFrame, label: str) -> DataFrame:
    """Rows (img, e, label, shared, ratio): pixels of labelled objects (label > 0) in an ellipse, over the smaller of both sizes."""
    drawn = draw_ellipses(px, ellipses)
    size = drawn.groupBy(*KEY, "e").agg(F.count("*").alias("_e"))
    objects = px.where(F.col(label) > 0).groupBy(*KEY, label).agg(F.count("*").alias("_o"))
    both = drawn.join(px.where(F.col(label) > 0), [*KEY, "y", "x"]).groupBy(*KEY, "e", label).agg(F.count("*").alias("shared"))
    j = both.join(size, [*KEY, "e"]).join(objects, [*KEY, label])
    return j.select(*KEY, "e", label, "shared", (F.col("shared") / F.least("_e", "_o")).alias("ratio"))


def criterion(points: DataFrame, ellipses: DataFrame, foreground: tuple[float, ...]) -> DataFrame:
    """Rows (img, e, crit): sum over points (img, idx, y, x, label, weight) in an ellipse of weight * (log bg - log fg) of their label."""
    table = F.array(*[F.lit(-math.log(p) + math.log(1 - p)) for p in foreground])
    hit = in_boxes(points, ellipses).groupBy(*KEY, "e").agg(F.sum(F.col("weight") * table[F.col("label")]).alias("crit"))
    return ellipses.select(*KEY, "e").join(hit, [*KEY, "e"], "left").fillna(0.0, ["crit"])


def ellipse_from_points(pts: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares ellipse of each group of points (keys, y, x): (keys, cy, cx, a, b, theta), null if there is none.

    Solves the conic through grouped sums of products (5 x 5 normal equations), which Spark combines before the shuffle, so a group may
    have any number of points.
    """
    m = pts.groupBy(*keys).agg(F.avg("y").alias("_my"), F.avg("x").alias("_mx"), F.greatest(F.stddev_pop("y") + F.stddev_pop("x"), F.lit(1e-9)).alias("_s"))
    n = pts.join(m, keys).withColumns({"_u": (F.col("x") - F.col("_mx")) / F.col("_s"), "_v": (F.col("y") - F.col("_my")) / F.col("_s")})
    terms = ["_u * _u", "_u * _v", "_v * _v", "_u", "_v"]
    sums = [F.sum(F.expr(f"({p}) * ({q})")).alias(f"m{i}{j}") for i, p in enumerate(terms) for j, q in enumerate(terms)] + [F.sum(F.expr(p)).alias(f"r{i}") for i, p in enumerate(terms)]
    eq = n.groupBy(*keys, "_my", "_mx", "_s").agg(*sums, F.count("*").alias("_n"))
    schema = ", ".join([*[f"{k} {dict(pts.dtypes)[k]}" for k in keys], "cy double, cx double, a double, b double, theta double"])

    def solve(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            m = f[[f"m{i}{j}" for i in range(5) for j in range(5)]].to_numpy(float).reshape(-1, 5, 5)
            r = f[[f"r{i}" for i in range(5)]].to_numpy(float)
            fit = np.full((len(f), 5), np.nan)
            with np.errstate(all="ignore"):
                ok = np.flatnonzero((f["_n"].to_numpy() >= 5) & np.isfinite(m).all(axis=(1, 2)) & (np.linalg.det(np.nan_to_num(m)) != 0))
                k = np.linalg.solve(m[ok], r[ok][:, :, None])[:, :, 0]
                q = np.stack([k[:, 0], k[:, 1] / 2, k[:, 1] / 2, k[:, 2]], axis=1).reshape(-1, 2, 2)
                sound = np.isfinite(q).all(axis=(1, 2)) & (np.linalg.det(np.nan_to_num(q)) != 0)
                ok, k, q = ok[sound], k[sound], q[sound]
                c = np.linalg.solve(-2 * q, k[:, 3:, None])[:, :, 0]
                scaled = q / (1 + np.einsum("ni,nij,nj->n", c, q, c))[:, None, None]
                sound = np.isfinite(scaled).all(axis=(1, 2))
                ok, c, scaled = ok[sound], c[sound], scaled[sound]
                w, v = np.linalg.eigh(scaled)
                sound = (w > 0).all(axis=1)
                ok, c, w, v = ok[sound], c[sound], w[sound], v[sound]
                my, mx, s = (f[x].to_numpy(float)[ok] for x in ("_my", "_mx", "_s"))
                half = 1 / np.sqrt(w)
                fit[ok] = np.column_stack([c[:, 1] * s + my, c[:, 0] * s + mx, half[:, 0] * s, half[:, 1] * s, np.arctan2(v[:, 1, 0], v[:, 0, 0])])
            values = pd.DataFrame(fit, columns=["cy", "cx", "a", "b", "theta"], index=f.index).astype(object)
            yield pd.concat([f[keys], values.where(values.notna(), None)], axis=1)

    return eq.mapInPandas(solve, schema)


def pairs_within(points: DataFrame, limit: float, parts: int | None = None) -> DataFrame:
    """Pairs of points (img, src, dst, _d) with src < dst that lie in neighbouring cells as wide as ``limit``, and their squared distance; cells in ``parts`` partitions if given."""
    cell = lambda c: F.floor(F.col(c) / limit)
    a = points.select(*KEY, F.col("idx").alias("src"), "y", "x", cell("y").alias("_cy"), cell("x").alias("_cx"))
    a = a.repartition(parts, *KEY, "_cy", "_cx") if parts else a
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    b = points.select(*KEY, F.col("idx").alias("dst"), F.col("y").alias("_y"), F.col("x").alias("_x")).withColumn("_dy", F.explode(around)).withColumn("_dx", F.explode(around))
    b = b.withColumns({"_cy": F.floor(F.col("_y") / limit) + F.col("_dy"), "_cx": F.floor(F.col("_x") / limit) + F.col("_dx")})
    d2 = (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")) + (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x"))
    return a.join(b, [*KEY, "_cy", "_cx"]).where("src < dst").select(*KEY, "src", "dst", d2.alias("_d"))


def cluster_points(points: DataFrame, limit: float) -> DataFrame:
    """Clusters of points (img, idx, y, x) by steps of at most ``limit``: (img, cluster, n, y, x), named by their smallest idx, at their mean."""
    edges = pairs_within(points, limit).where(F.col("_d") <= limit * limit).select(*KEY, "src", "dst")
    named = components(edges, points.select(*KEY, F.col("idx").alias("node")))
    joined = points.join(named.withColumnRenamed("node", "idx"), [*KEY, "idx"])
    return joined.groupBy(*KEY, F.col("component").alias("cluster")).agg(F.count("*").alias("n"), (F.sum("y") / F.count("*")).alias("y"), (F.sum("x") / F.count("*")).alias("x"))


def thin_points(points: DataFrame, limit: float, rounds: int | None = None) -> DataFrame:
    """Drop points until none are nearer than ``limit``: of the closest pair left in an image the later one goes, again and again.

    Each round drops a point at least, so it ends; with ``rounds`` given, it is an error not to be done in so many.
    """
    checkpoint_folder(points.sparkSession)
    left = points.checkpoint()
    # a point has many pairs, so that partitions of a usual size would take much memory
    parts = max(points.sparkSession.sparkContext.defaultParallelism, -(-left.count() // POINTS))
    for _ in itertools.count() if rounds is None else range(rounds):
        pairs = pairs_within(left, limit, parts).where(F.col("_d") < limit * limit).select(*KEY, F.col("src").alias("idx"), F.col("dst").alias("_i"), "_d")
        rank = F.struct("_d", "idx", "_i")
        # the closest pair of each point, which tasks find among theirs before anything is shuffled
        best = pairs.select(*KEY, rank.alias("_r"), F.explode(F.array("idx", "_i")).alias("_p")).groupBy(*KEY, "_p").agg(F.min("_r").alias("_r"))
        # a pair that is the closest of both its ends is taken by the one-by-one choice, too
        gone = best.groupBy(*KEY, "_r").count().where("count = 2").select(*KEY, F.col("_r._i").alias("idx")).distinct().checkpoint()
        if gone.isEmpty():
            break
        left = left.join(gone, [*KEY, "idx"], "left_anti").checkpoint()
    else:
        raise RuntimeError(f"points did not settle in {rounds} rounds")
    return left


def centres_in_objects(centres: DataFrame, seg: DataFrame, label: str) -> DataFrame:
    """Rows (img, objects, missed, multiple): objects (label > 0) with no centre, and with several."""
    n = seg.where(F.col(label) > 0).join(centres.withColumn("_one", F.lit(1)), [*KEY, "y", "x"], "left").groupBy(*KEY, label).agg(F.sum(F.coalesce("_one", F.lit(0))).alias("n"))
    return n.groupBy(*KEY).agg(F.count("*").alias("objects"), F.sum((F.col("n") == 0).cast("long")).alias("missed"), F.sum((F.col("n") > 1).cast("long")).alias("multiple"))


def rays(seg: DataFrame, mask: str, points: DataFrame, step: int = 10, edge: str = "up", own: bool = False) -> DataFrame:
    """Distances from points along rays to a mask's edge: (img, idx, angle, distance), -1 if the ray leaves the image first.

    ``up`` is the first pixel in the mask (0 for a point that is in it), ``down`` the first one out of it. A ray advances by one pixel along its longer side, as far as the image goes. With ``own``, the mask of a point are the pixels
    whose value is the point's idx.
    """
    checkpoint_folder(seg.sparkSession)
    p = points.select(*KEY, "idx", F.col("y").alias("_y"), F.col("x").alias("_x")).checkpoint()
    angle = F.explode(F.sequence(F.lit(0), F.lit(359), F.lit(step))).alias("angle")
    rad = F.radians(F.col("angle").cast("double"))
    longest = F.greatest(F.abs(F.sin(rad)), F.abs(F.cos(rad)))
    march = p.select("*", angle).withColumns({"_gy": F.sin(rad) / longest, "_gx": F.cos(rad) / longest})
    ends = seg.groupBy(*KEY).agg(F.max("y").alias("_ey"), F.max("x").alias("_ex"))
    march = march.join(ends, KEY)
    first, last = {"y": F.lit(0), "x": F.lit(0)}, {"y": F.col("_ey"), "x": F.col("_ex")}
    if own:  # a ray that has left its object's box meets the object no more
        box = seg.groupBy(*KEY, F.col(mask).alias("idx")).agg(*[(g(c) + k).alias(f"_{n}{c}") for c in ("y", "x") for n, g, k in (("f", F.min, -1), ("l", F.max, 1))])
        march = march.join(box, [*KEY, "idx"], "left")
        first, last = ({c: F.coalesce(f"_{n}{c}", end[c]) for c in ("y", "x")} for n, end in (("f", first), ("l", last)))
    room = lambda c: F.when(F.col(f"_g{c}") > 1e-9, (last[c] - F.col(f"_{c}")) / F.col(f"_g{c}")).when(F.col(f"_g{c}") < -1e-9, (first[c] - F.col(f"_{c}")) / F.col(f"_g{c}")).otherwise(float("inf"))
    most = F.least(room("y"), room("x"), *([] if own else [F.greatest("_ey", "_ex").cast("double")]))
    # rays are few bytes, which Spark would put together in one partition, whose task makes the steps of all
    march = march.repartition(max(seg.sparkSession.sparkContext.defaultParallelism, -(-p.count() * len(range(0, 360, step)) // RAYS)), *KEY, "idx", "angle")
    march = march.withColumn("_k", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(most).cast("int"), F.lit(0)) + 1)))
    march = march.withColumns({"y": F.bround(F.col("_y") + F.col("_k") * F.col("_gy")).cast("int"), "x": F.bround(F.col("_x") + F.col("_k") * F.col("_gx")).cast("int")})
    # Spark's estimate leaves out what explode adds, and would broadcast the steps of all rays
    on = march.hint("merge").join(seg.select(*KEY, "y", "x", F.col(mask).alias("_v")), [*KEY, "y", "x"])
    on = on.withColumn("_on", F.col("_v") == F.col("idx") if own else F.col("_v") != 0)
    inside = F.max(F.when(F.col("_k") == 0, F.col("_on")))
    if edge == "up":
        hit = F.min(F.when(F.col("_on"), F.col("_k")))
    else:  # out of the mask, having been in it
        entered = F.min(F.when(F.col("_on"), F.col("_k"))).over(Window.partitionBy(*KEY, "idx", "angle"))
        on = on.withColumn("_in", entered)
        hit = F.min(F.when(~F.col("_on") & (F.col("_k") > F.col("_in")), F.col("_k")))
    out = on.groupBy(*KEY, "idx", "angle", "_gy", "_gx").agg(hit.alias("_h"), inside.alias("_i"))
    unit = F.sqrt(F.col("_gy") * F.col("_gy") + F.col("_gx") * F.col("_gx"))
    return out.select(*KEY, "idx", "angle", F.coalesce(F.col("_h") * unit, F.lit(-1.0)).alias("distance"))


def shifted_to_longest(distances: str) -> Column:
    """The array turned so that its largest value comes first."""
    k = F.array_position(distances, F.array_max(distances)).cast("int")
    return F.concat(F.slice(distances, k, F.size(distances)), F.slice(distances, F.lit(1), k - 1))
