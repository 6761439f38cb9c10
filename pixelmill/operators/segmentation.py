"""Superpixels, class maps and region growing as rounds of joins and grouped aggregations over all images at once."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.functions import color
from pixelmill.operators import features, filters, graph, maxflow, ml, watershed
from pixelmill.session import checkpoint_folder

KEY = ["img"]
#: Pixels of a partition that meets centres.
PIXELS = 250_000
#: Segments of a partition that a class model is fitted to.
ROWS = 20_000
#: Texture banks by name: scales, orientations, reach.
BANKS = {"tLM": ((2**0.5, 2.0, 2 * 2**0.5, 4.0), 8, 8), "tLM_short": ((2**0.5, 2.0), 4, 6)}


def superpixels(px: DataFrame, channels: list[str], size: int = 10, compactness: float = 10.0, rounds: int = 5, axes: tuple[str, ...] = ("y", "x"), spacing: dict[str, float] | None = None) -> DataFrame:
    """Adds ``sp``: superpixels of about ``size`` pixels along each axis, by clustering in colour and place; with axes z, y, x those of volumes.

    Centres start on a grid. In a round each pixel meets the centres of its own and the neighbouring cells by an equi-join, takes the
    nearest (d_colour^2 + compactness^2 * d_place^2 / size^2, the smallest number of equals), and centres move to their
    pixels' means. A pixel so sees at most 9 (in volumes 27) starting cells, whatever the image's size. ``spacing`` is the length of a step along an axis.
    """
    checkpoint_folder(px.sparkSession)
    scale = {a: (spacing or {}).get(a, 1.0) for a in axes}
    place = {a: F.floor(F.col(a) * scale[a] / size) for a in axes}
    px = px.checkpoint()
    ends = px.groupBy(*KEY).agg(*[(F.floor(F.max(a) * scale[a] / size) + 1).alias(f"_n_{a}") for a in axes])
    cells = px.join(ends, KEY).withColumns({f"_c_{a}": c for a, c in place.items()})
    own = F.lit(0)
    for a in axes:
        own = own * F.col(f"_n_{a}") + F.col(f"_c_{a}")
    at = [f"_c_{a}" for a in axes]
    cells = cells.withColumn("_own", own.cast("int")).select(*KEY, *at, "_own", *axes, *channels).checkpoint()
    mean = [F.avg(c).alias(f"_m_{c}") for c in (*channels, *axes)]
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    homes = [F.col(f"_c_{a}").alias(f"_h_{a}") for a in axes]
    centres = cells.groupBy(*KEY, F.col("_own").alias("sp"), *homes).agg(*mean).checkpoint()
    home = centres.select(*KEY, "sp", *[f"_h_{a}" for a in axes])
    # dealt by the number of pixels, so that a task's memory doesn't grow with the input
    base = cells.drop("_own").repartition(max(px.sparkSession.sparkContext.defaultParallelism, -(-cells.count() // PIXELS)), *KEY, *at)
    for _ in range(rounds):
        # merge joins, as Spark's estimate leaves out what explode adds: neither spread centres nor a grid of pixels are broadcast
        spread = centres
        for a in axes:
            spread = spread.withColumn("_d", F.explode(around)).withColumn(f"_c_{a}", F.col(f"_h_{a}") + F.col("_d")).drop("_d", f"_h_{a}")
        sq = lambda c, k=1.0: (F.col(c) - F.col(f"_m_{c}")) * (F.col(c) - F.col(f"_m_{c}")) * (k * k)
        d = sum(sq(c) for c in channels) + sum(sq(a, scale[a]) for a in axes) * (compactness**2 / size**2)
        # a pixel is grouped by its cell and channels, too: it stays where it met the centres, and has what their means need
        near = base.join(spread.hint("merge"), [*KEY, *at]).groupBy(*KEY, *at, *axes, *channels).agg(F.min(F.struct(d.alias("d"), "sp"))["sp"].alias("sp"))
        centres = near.groupBy(*KEY, "sp").agg(*mean).join(home, [*KEY, "sp"]).checkpoint()
    return px.join(near.select(*KEY, *axes, "sp").hint("merge"), [*KEY, *axes])


def segment_classes(px: DataFrame, segment: str, channels: list[str], classes: int, regularisation: float = 1.0, kind: str = "model", model: PipelineModel | None = None, axes: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Class maps: (img, segment, label, proba). Colour statistics of segments, a class model of all images (or a given one),
    edge weights of ``kind``, and labels of low unary and pairwise cost; without regularisation the most probable class. With axes z, y, x for volumes.
    """
    return classified(px, segment, features.segment_statistics(px, segment, channels, ("mean", "std")), classes, regularisation, kind, model, axes)


def classified(px: DataFrame, segment: str, stats: DataFrame, classes: int, regularisation: float = 1.0, kind: str = "model", model: PipelineModel | None = None, axes: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """As ``segment_classes``, from any features ``stats(img, segment, ...)``: all its other columns."""
    checkpoint_folder(px.sparkSession)
    names = [c for c in stats.columns if c not in (*KEY, segment)]
    rows = stats.select(*KEY, segment, F.array(*[F.col(c).cast("double") for c in names]).alias("features")).checkpoint()
    # dealt by their number and in order, as the start values of a model are a sample of partitions; last digits of features still follow the order of sums
    rows = rows.repartition(max(1, -(-rows.count() // ROWS)), *KEY, segment).sortWithinPartitions(*KEY, segment).checkpoint()
    model = model or ml.class_model(rows, classes)
    made = ml.probabilities(model, rows).select(*KEY, segment, "features", "proba").checkpoint()
    unary = made.select(*KEY, segment, F.posexplode("proba").alias("cls", "p")).select(*KEY, segment, "cls", graph.unary_cost(F.col("p")).alias("cost")).checkpoint()
    if regularisation <= 0:
        labels = graph.best_labels(unary, [*KEY, segment])
    else:
        centres = features.centroids(px, segment, axes)
        edges = graph.edge_weights(graph.adjacency(px, segment, axes), kind, made, centres, segment, axes=axes).checkpoint()
        labels = maxflow.graph_cut(unary, edges, graph.pairwise_matrix(classes, regularisation), segment)
    return labels.join(made.select(*KEY, segment, "proba"), [*KEY, segment])


def selected_features(px: DataFrame, segment: str, channels: list[str], wanted: dict[str, tuple[str, ...]], depth: tuple[str, ...] = ()) -> DataFrame:
    """Features of segments by kind and statistic: (img, segment, <kind>_<channel>_...), for grey and colour images and (with ``depth``) volumes.

    Kinds: ``color``, statistics of the channels; ``color_hsv`` and other spaces of ``color.convert``, of the channels in that space (three channels from 0 to 1); the banks of
    ``BANKS``, statistics of the responses of each channel.
    """
    parts = []
    for kind, statistics in wanted.items():
        if kind in BANKS:
            bank = filters.filter_bank(*BANKS[kind])
            part = features.segment_statistics(filters.bank_responses(px, channels, bank, depth), segment, [f"{c}_{f}" for c in channels for f in bank], statistics)
            parts.append(part.select(*KEY, segment, *[F.col(f"{c}_{f}_{s}").alias(f"{kind}_{c}_{f}_{s}") for c in channels for s in statistics for f in bank]))
        elif kind.partition("_")[0] == "color":
            space = kind.partition("_")[2]
            part = features.segment_statistics(color.convert(px, channels, space) if space else px, segment, channels, statistics)
            parts.append(part.select(*KEY, segment, *[F.col(c).alias(f"{kind}_{c}") for c in part.columns if c not in (*KEY, segment)]))
        else:
            raise ValueError(f"unknown kind of features {kind}")
    return reduce(lambda a, b: a.join(b, [*KEY, segment]), parts)


def segment_images(px: DataFrame, channels: list[str], classes: int, size: int = 10, compactness: float = 10.0, wanted: dict[str, tuple[str, ...]] | None = None, regularisation: float = 1.0, kind: str = "model", model: PipelineModel | None = None, axes: tuple[str, ...] = ("y", "x"), each: bool = False) -> DataFrame:
    """``px`` with ``sp`` and ``label``: superpixels, their features, classes and a graph cut, in one call, for images or (axes z, y, x) volumes.

    ``wanted`` as for ``selected_features``, else mean and deviation of the channels. One model is fitted to the superpixels of all images, or ``model`` is used;
    with ``each`` every image is scaled to its own mean and deviation before, so that images of other light have classes of their own.
    """
    checkpoint_folder(px.sparkSession)
    sp = superpixels(px, channels, size, compactness, axes=axes).checkpoint()
    stats = selected_features(sp, "sp", channels, wanted or {"color": ("mean", "std")}, tuple(a for a in axes if a not in ("y", "x")))
    if each:
        w = Window.partitionBy(*KEY)
        names = [c for c in stats.columns if c not in (*KEY, "sp")]
        stats = stats.select(*KEY, "sp", *[(F.when(F.stddev_pop(c).over(w) > 0, (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).otherwise(0.0)).alias(c) for c in names])
    found = classified(sp, "sp", stats, classes, regularisation, kind, model, axes)
    return sp.join(found.select(*KEY, "sp", "label"), [*KEY, "sp"])


def grow_regions(unary: DataFrame, edges: DataFrame, seeds: DataFrame, matrix: list[list[float]], segment: str) -> DataFrame:
    """Grow objects from seed segments (img, segment, label): (img, segment, label), 0 where none came.

    Costs are those of ``unary`` (img, segment, cls, cost), class 0 the background. In a round the segments beside an object may join it;
    of these each that lowers the cost does, unless a neighbour gains more in the same round. Rounds go on until nothing changes.
    """
    return graph.grown(unary, edges, seeds, matrix, segment)


def object_pixels(px: DataFrame, segm: str, centres: DataFrame, foreground: tuple[float, ...] = (0.1, 0.9), regularisation: float = 1.0, seed: int = 0, shape: float = 0.0, radius: tuple[float, float] = (50.0, 10.0), tile: int = 256) -> DataFrame:
    """Objects around centres (img, idx, y, x) by a graph cut over pixels: (img, y, x, object), 0 the background, else a centre's place by idx from 1.

    ``foreground[c]`` is the chance that a pixel of class c in ``segm`` is part of an object. ``shape`` weighs a prior of size: the chance that a normal length of mean and
    deviation ``radius`` exceeds the distance to the centre. Pixels of ``segm`` above 0 within ``seed`` of a centre (with 0 the centre's own) cost nothing there. Touching pixels
    of different objects cost ``regularisation``; without it each pixel takes its cheapest, the smallest of equals. Images of more than ``maxflow.BLOCK_NODES`` pixels are cut in tiles.
    """
    if min(foreground) >= 1:
        raise ValueError("no chance may be 1 for all classes")
    checkpoint_folder(px.sparkSession)
    top = px.agg(F.max(segm)).first()[0]
    if top is not None and top >= len(foreground):
        raise ValueError("a class of the segmentation has no chance of its own")
    kinds = dict(px.dtypes)
    order = Window.partitionBy(*KEY).orderBy("idx")
    rounded = centres.select(*KEY, F.bround("y").cast("int").alias("_y"), F.bround("x").cast("int").alias("_x"), F.row_number().over(order).alias("cls"))
    share = F.array(*map(F.lit, map(float, foreground)))[F.col(segm)]
    base = px.select(*KEY, "y", "x", segm, (F.col("y").cast("long") * watershed.ROW + F.col("x")).alias("node"), share.alias("_p"))

    @F.pandas_udf("double")
    def beyond(d: pd.Series) -> pd.Series:
        mean, std = radius
        return d.map(lambda v: 0.5 * math.erfc((math.floor(v) - mean) / (std * math.sqrt(2))) + 1e-9)

    d2 = (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")) + (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x"))
    near = base.join(rounded, KEY)
    own = -F.log("_p") - (shape * F.log(beyond(F.sqrt(d2.cast("double")))) if shape else F.lit(0.0))
    seeded = (d2 <= seed * seed) & (F.col(segm) > 0) if seed else d2 == 0
    outside = base.select(*KEY, "node", F.lit(0).alias("cls"), (-(1 + shape) * F.log(1 - F.col("_p"))).alias("cost"))
    unary = outside.unionByName(near.select(*KEY, "node", "cls", F.when(seeded, 0.0).otherwise(own).alias("cost")))
    if regularisation > 0:
        most = (rounded.agg(F.max("cls")).first()[0] or 0) + 1
        edges = watershed.pixel_edges(px.withColumn("_one", F.lit(1)), "_one").select(*KEY, F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w"))
        block = F.expr(f"node div {watershed.ROW} div {tile} * {watershed.ROW} + node % {watershed.ROW} div {tile}")
        found = maxflow.graph_cut(unary.withColumn("_block", block), edges, graph.pairwise_matrix(most, regularisation), "node", block="_block")
    else:
        found = graph.best_labels(unary, [*KEY, "node"])
    return found.select(*KEY, F.expr(f"node div {watershed.ROW}").cast(kinds["y"]).alias("y"), F.expr(f"node % {watershed.ROW}").cast(kinds["x"]).alias("x"), F.col("label").cast("int").alias("object"))


def filter_response(px: DataFrame, channel: str, kernel: list[tuple[int, int, float]], name: str = "response") -> DataFrame:
    """Adds the response of a filter, given as (dy, dx, weight), with the image mirrored at its border."""
    return filters.convolve(px, channel, {name: kernel})


def texture(px: DataFrame, channel: str, segment: str, sigmas: tuple[float, ...] = (1.0,), orientations: int = 4, reach: int = 3, statistics: tuple[str, ...] = ("mean", "energy"), depth: tuple[str, ...] = ()) -> DataFrame:
    """Texture of segments: (img, segment, <family>_<statistic>...) of the largest response of each family of ``filters.filter_bank``."""
    bank = filters.filter_bank(sigmas, orientations, reach)
    return features.segment_statistics(filters.bank_response(px, channel, bank, depth), segment, list(bank), statistics)


def dilate(px: DataFrame, mask: str, radius: int, shrink: bool = False) -> DataFrame:
    """A 0/1 mask grown by a disk (or shrunk, pixels beyond the image not counting)."""
    disk = [(dy, dx, 1.0) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    marked = px.withColumn("_m", (F.col(mask) == (0 if shrink else 1)).cast("int"))
    near = (F.col("_near") > 0.5).cast("int")
    return filters.convolve(marked, "_m", {"_near": disk}, mirror=False).withColumn(mask, 1 - near if shrink else near).drop("_m", "_near")


def opened(px: DataFrame, mask: str, radius: int) -> DataFrame:
    """A mask shrunk, then grown again: parts thinner than the disk go."""
    return dilate(dilate(px, mask, radius, shrink=True), mask, radius)
