"""Seeded watersheds: basins of a minimum spanning forest of the pixels.

Two touching pixels are joined by an edge as high as the higher one; edges are ordered by height, then by their ends, so the forest is unique. A pixel belongs to the
seed that the forest ties it to, i.e. whose way over the lowest passes is the lowest. Boruvka's rounds build it: each part without
a seed joins the part beyond its least edge. Within tiles this goes on as long as a part's least edge lies inside; what is
left then, parts along the borders of tiles, is joined by rounds of joins over a graph that is contracted each time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators import graph, labels, pixelwise
from pixelmill.session import checkpoint_folder

KEY = ["img"]
ROW = 1 << 31


def pixel_edges(px: DataFrame, value: str) -> DataFrame:
    """Pairs of pixels that touch: (img, a, b, v_a, v_b), pixels named y * 2 ** 31 + x. Pixels that aren't there have no edges."""
    parts = []
    for along, other, step in (("x", "y", 1), ("y", "x", ROW)):
        w = Window.partitionBy(*KEY, other).orderBy(along)
        near = px.select(*KEY, (F.col("y").cast("long") * ROW + F.col("x")).alias("a"), F.col(value).alias("v_a"), F.lead(along).over(w).alias("_at"), F.col(along).alias("_own"), F.lead(value).over(w).alias("v_b"))
        parts.append(near.where(F.col("_at") == F.col("_own") + 1).select(*KEY, "a", (F.col("a") + step).alias("b"), "v_a", "v_b"))
    return reduce(DataFrame.union, parts)


def _contract(left: pa.Table, right: pa.Table) -> pa.Table:
    """Parts of one tile: join parts without a seed over their least edges, as long as these lie within."""
    ids = left.column("node").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    n = len(ids)
    label = left.column("label").fill_null(-1).to_numpy()[order].copy()
    a, b, w = (right.column(c).to_numpy() for c in ("_a", "_b", "_w"))
    by = np.lexsort((b, a, w))
    a, b = a[by], b[by]
    at, bt = np.searchsorted(ids, a), np.searchsorted(ids, b)
    in_a, in_b = (at < n) & (ids[np.minimum(at, n - 1)] == a), (bt < n) & (ids[np.minimum(bt, n - 1)] == b)
    rank = np.arange(len(a))
    inner, cross = in_a & in_b, in_a ^ in_b
    own = np.where(in_a, at, bt)[cross]
    part, never = np.arange(n), len(a)
    while True:
        pa_, pb = part[at[inner]], part[bt[inner]]
        open_ = pa_ != pb
        pa_, pb, r = pa_[open_], pb[open_], rank[inner][open_]
        least = np.full(n, never)
        np.minimum.at(least, pa_, r)
        np.minimum.at(least, pb, r)
        np.minimum.at(least, part[own], rank[cross])
        to = np.arange(n)
        for one, other in ((pa_, pb), (pb, pa_)):
            mine = (least[one] == r) & (label[one] < 0)
            to[one[mine]] = other[mine]
        if (to == np.arange(n)).all():
            break
        root = (to[to] == np.arange(n)) & (np.arange(n) < to)  # two parts that chose one edge
        to[root] = np.flatnonzero(root)
        while (to[to] != to).any():
            to = to[to]
        np.maximum.at(label, to, label)
        part = to[part]
    img = left.column("img")[0].as_py() if n else None
    return pa.table({"img": pa.array([img] * n, left.schema.field("img").type), "node": ids, "part": ids[part], "label": label[part]})


def watershed(px: DataFrame, height: str, seeds: DataFrame, mask: str | None = None, tile: int = 256) -> DataFrame:
    """Adds ``basin``: the label of the seed that floods a pixel, 0 where none does or ``mask`` isn't 1.

    ``seeds(img, y, x, label)`` with labels above 0; those off the mask count for nothing, of several on a pixel the smallest counts. Null heights
    are as high as can be. Results don't depend on ``tile``.
    """
    checkpoint_folder(px.sparkSession)
    kind = dict(px.dtypes)["img"]
    on = px if mask is None else px.where(F.col(mask) == 1)
    on = on.select(*KEY, "y", "x", F.coalesce(F.col(height).cast("double"), F.lit(float("inf"))).alias("_h"))
    given = seeds.groupBy(*KEY, "y", "x").agg(F.min("label").cast("long").alias("label"))
    node = F.col("y").cast("long") * ROW + F.col("x")
    dealt = on.join(given, [*KEY, "y", "x"], "left").select(*KEY, node.alias("node"), "label")
    edges = pixel_edges(on, "_h").select(*KEY, "a", "b", F.greatest("v_a", "v_b").alias("w")).checkpoint()

    def place(c: str):
        return F.expr(f"{c} div {ROW} div {tile} * {ROW} + {c} % {ROW} div {tile}")

    ends = edges.select(F.col("img").alias("_img"), F.explode(F.array_distinct(F.array(place("a"), place("b")))).alias("_tile"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("w").alias("_w"))
    parts = dealt.withColumn("_tile", place("node")).groupBy(*KEY, "_tile").cogroup(ends.groupBy("_img", "_tile")).applyInArrow(_contract, f"img {kind}, node long, part long, label long").checkpoint()
    known = parts.where("label > 0").select(*KEY, "part", "label").distinct()
    e = _contracted(edges, parts.select(*KEY, F.col("node").alias("old"), F.col("part").alias("new")), known)
    maps = []
    while not e.isEmpty():
        both = e.union(e.select(*KEY, F.col("d").alias("c"), F.col("c").alias("d"), "w", "a", "b")).join(known.select(*KEY, F.col("part").alias("c")), [*KEY, "c"], "left_anti")
        best = both.groupBy(*KEY, "c").agg(F.min(F.struct("w", "a", "b", "d")).alias("m")).select(*KEY, F.col("c").alias("src"), F.col("m.d").alias("dst")).checkpoint()
        if best.isEmpty():
            break
        touched = best.select(*KEY, F.col("src").alias("node")).union(best.select(*KEY, "dst")).distinct()
        joined = graph.components(best, touched).select(*KEY, F.col("node").alias("old"), F.col("component").alias("new")).checkpoint()
        maps.append(joined)
        moved = known.join(joined.withColumnRenamed("old", "part"), [*KEY, "part"], "left")
        known = moved.select(*KEY, F.coalesce("new", "part").alias("part"), "label").checkpoint()
        e = _contracted(e.select(*KEY, F.col("c").alias("a"), F.col("d").alias("b"), "w", F.col("a").alias("_a"), F.col("b").alias("_b")), joined, known, True)
    whole = None
    for m in reversed(maps):  # from the last, smallest round to the first
        whole = m if whole is None else m.join(whole.select(*KEY, F.col("old").alias("new"), F.col("new").alias("_last")), [*KEY, "new"], "left").select(*KEY, "old", F.coalesce("_last", "new").alias("new")).unionByName(whole)
    if whole is not None:
        whole = whole.dropDuplicates([*KEY, "old"])
        parts = parts.join(whole.withColumnRenamed("old", "part"), [*KEY, "part"], "left").select(*KEY, "node", F.coalesce("new", "part").alias("part"))
    named = parts.select(*KEY, "node", "part").join(known, [*KEY, "part"]).select(*KEY, F.expr(f"node div {ROW}").cast(dict(px.dtypes)["y"]).alias("y"), F.expr(f"node % {ROW}").cast(dict(px.dtypes)["x"]).alias("x"), F.col("label").alias("basin"))
    return px.join(named, [*KEY, "y", "x"], "left").fillna(0, ["basin"])


def _contracted(edges: DataFrame, names: DataFrame, known: DataFrame, again: bool = False) -> DataFrame:
    """Edges (img, c, d, w, a, b) between parts, the least of each pair, without those between two parts that have seeds."""
    keep = ["_a", "_b"] if again else []
    for end, name in (("a", "c"), ("b", "d")):
        edges = edges.join(names.select(*KEY, F.col("old").alias(end), F.col("new").alias(name)), [*KEY, end], "left").withColumn(name, F.coalesce(name, end))
    a, b = keep or ("a", "b")
    rows = edges.where("c <> d").select(*KEY, F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d"), F.struct("w", F.col(a).alias("a"), F.col(b).alias("b")).alias("m"))
    rows = rows.groupBy(*KEY, "c", "d").agg(F.min("m").alias("m"))
    for name in ("c", "d"):
        rows = rows.join(known.select(*KEY, F.col("part").alias(name), F.lit(True).alias(f"s_{name}")), [*KEY, name], "left")
    return rows.where("s_c IS NULL OR s_d IS NULL").select(*KEY, "c", "d", "m.w", "m.a", "m.b").checkpoint()


def object_watershed(px: DataFrame, segm: str, centres: DataFrame) -> DataFrame:
    """(img, y, x, object): what ``segm`` has above 0, its holes filled, parted among centres (img, idx, y, x) by the watershed of the distance to the outside.

    Objects are numbered from 1 as their centres by idx; 0 is the background, and regions without a centre.
    """
    on = pixelwise.fill_holes(px.select(*KEY, "y", "x", (F.col(segm) > 0).cast("int").alias("m")), "m")
    deep = labels.distance_to(on.withColumn("_out", 1 - F.col("m")), "_out").withColumn("_h", -F.coalesce(F.col("d2"), F.lit(0)))
    w = Window.partitionBy(*KEY).orderBy("idx")
    seeds = centres.select(*KEY, F.round("y").cast("int").alias("y"), F.round("x").cast("int").alias("x"), F.row_number().over(w).alias("label"))
    return watershed(deep, "_h", seeds, "m").select(*KEY, "y", "x", F.col("basin").alias("object"))
