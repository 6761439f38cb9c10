"""Review of found centres against annotated objects, centres that hold their segments, and scores of several methods at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators import labels, metrics

KEY = ["img"]


def _placed(points: DataFrame, px: DataFrame, column: str, name: str) -> DataFrame:
    """Points with the value of the pixel that they lie in, null off the raster."""
    at = px.select(*KEY, F.col("y").cast("long").alias("_y"), F.col("x").cast("long").alias("_x"), F.col(column).alias(name))
    return points.withColumns({"_y": F.floor("y").cast("long"), "_x": F.floor("x").cast("long")}).join(at, [*KEY, "_y", "_x"], "left").drop("_y", "_x")


def clear_false_positives(points: DataFrame, px: DataFrame, objects: str) -> DataFrame:
    """Points (img, idx, y, x, label) with ``change``: those that lie in no object (``objects`` above 0), or off the raster, have label 0 and change 1."""
    off = F.coalesce(F.col("_o"), F.lit(0)) <= 0
    return _placed(points, px, objects, "_o").withColumns({"label": F.when(off, 0).otherwise(F.col("label")), "change": off.cast("int")}).drop("_o")


def add_missed_objects(points: DataFrame, px: DataFrame, objects: str) -> DataFrame:
    """Points (img, idx, y, x, label, change) and, for each object that no point lies in, its centroid with label 1 and change 1, numbered on from the image's last point in the order of objects."""
    held = _placed(points, px, objects, "_o").where("_o > 0").select(*KEY, "_o").distinct()
    mass = px.where(F.col(objects) > 0).groupBy(*KEY, F.col(objects).alias("_o")).agg((F.sum("y") / F.count("*")).alias("y"), (F.sum("x") / F.count("*")).alias("x"))
    missed = mass.join(held, [*KEY, "_o"], "left_anti").withColumn("_k", F.row_number().over(Window.partitionBy(*KEY).orderBy("_o")))
    last = points.groupBy(*KEY).agg(F.max("idx").alias("_last"))
    new = missed.join(last, KEY, "left").select(*KEY, (F.coalesce("_last", F.lit(0)) + F.col("_k")).alias("idx"), "y", "x", F.lit(1).alias("label"), F.lit(1).alias("change"))
    return points.select(*KEY, "idx", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), "label", "change").union(new)


def _centre_segments(px: DataFrame, centres: DataFrame, segment: str) -> DataFrame:
    """Segments that centres (img, label, y, x) lie in, with the largest label of several in one."""
    return _placed(centres, px, segment, "_s").where("_s is not null").groupBy(*KEY, F.col("_s").alias(segment)).agg(F.max("label").alias("_label"))


def with_centre_labels(segments: DataFrame, px: DataFrame, centres: DataFrame, segment: str = "lb") -> DataFrame:
    """Segments (img, segment, label, ...) in which those under a centre (img, label, y, x) have its label, so that no object vanishes; of several the largest label."""
    return segments.join(_centre_segments(px, centres, segment), [*KEY, segment], "left").withColumn("label", F.coalesce("_label", "label")).drop("_label")


def centre_costs(segments: DataFrame, px: DataFrame, centres: DataFrame, segment: str = "lb", offset: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """Costs (img, segment, cls, cost) of segments (img, segment, proba, label) to be background (cls 0) or any of the image's objects, and the segments with centres' labels.

    The cost is -log of the chance (plus ``offset``): ``proba`` is that of the foreground, the same for all objects of an image. A null chance counts as one half.
    """
    p = F.coalesce(F.col("proba").cast("double"), F.lit(0.5))
    of = centres.select(*KEY, F.col("label").alias("cls")).distinct().where("cls > 0")
    front = segments.join(of, KEY).select(*KEY, segment, "cls", (-F.log(p + offset)).alias("cost"))
    back = segments.select(*KEY, segment, F.lit(0).cast(dict(of.dtypes)["cls"]).alias("cls"), (-F.log(1 - p + offset)).alias("cost"))
    return back.union(front), with_centre_labels(segments, px, centres, segment)


def method_scores(seg: DataFrame, truth: str, pred: str, relabel: bool = True) -> DataFrame:
    """Scores of segmentations by several methods (img, method, y, x, truth, pred): (img, method, ars, jaccard, accuracy).

    With ``relabel`` each label but 0, the background, is first named as the true one that it overlaps most, each name once; those that overlap none are -1. The Jaccard index is the mean over true labels but the smallest, 0 if
    there are no others. Precision, recall and F1 averaged over pixels are the accuracy.
    """
    both = seg.select(F.struct("img", "method").alias("img"), "y", "x", truth, pred)
    if relabel:
        on = labels.relabel_unique(both.where((F.col(truth) != 0) & (F.col(pred) != 0)), truth, pred).select(*KEY, pred, "new").distinct()
        both = both.join(on, [*KEY, pred], "left").withColumn(pred, F.when(F.col(pred) == 0, 0).otherwise(F.coalesce("new", F.lit(-1)))).drop("new")
    c = both.groupBy(*KEY).agg((F.sum((F.col(truth) == F.col(pred)).cast("long")) / F.count("*")).alias("accuracy"), F.min(truth).alias("_least"))
    j = metrics.jaccard(both, truth, pred).join(both.select(*KEY, F.col(truth).alias("label")).distinct(), [*KEY, "label"]).join(c, KEY)
    mean = j.groupBy(*KEY).agg(F.coalesce(F.avg(F.when(F.col("label") != F.col("_least"), F.col("jaccard"))), F.lit(0.0)).alias("jaccard"))
    out = metrics.adjusted_rand(both, truth, pred).join(mean, KEY).join(c, KEY)
    return out.select("img.img", "img.method", "ars", "jaccard", "accuracy")


def method_summary(scores: DataFrame) -> DataFrame:
    """A row a method: number of images, mean and sample deviation of each score."""
    names = ("ars", "jaccard", "accuracy")
    return scores.groupBy("method").agg(F.count("*").alias("images"), *[f(n).alias(f"{n}_{k}") for n in names for k, f in (("mean", F.avg), ("std", F.stddev_samp))])
