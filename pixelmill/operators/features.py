"""Statistics of segments: one grouped aggregation for all statistics that are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["img"]
STATISTICS = ("mean", "std", "energy", "median", "meanGrad")
INTEGRAL = {"tinyint", "smallint", "int", "bigint"}


def _clean(df: DataFrame, channels: list[str]) -> DataFrame:
    """Missing values count as 0, as does minus zero."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)) + 0.0 if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c), F.lit(0)) for c in channels})


def gradient_twice(channel: str, depth: list[str]) -> Column:
    """Twice the sum of central differences along y and x (one-sided at the border, 0 along an axis of one pixel)."""
    total = F.lit(0)
    for axis, other in (("y", "x"), ("x", "y")):
        w = Window.partitionBy(*KEY, *depth, other).orderBy(axis)
        before, after, v = F.lag(channel).over(w), F.lead(channel).over(w), F.col(channel)
        total = total + F.when(before.isNotNull() & after.isNotNull(), after - before).when(after.isNotNull(), 2 * (after - v)).when(before.isNotNull(), 2 * (v - before)).otherwise(0)
    return total


def segment_statistics(px: DataFrame, segment: str, channels: list[str], statistics: tuple[str, ...] = STATISTICS, dense: bool = False, prefix: str = "") -> DataFrame:
    """Rows (img, segment, <channel>_<statistic>...) of pixels (img, [z,] y, x, channels, segment).

    std is that of the population, energy the mean square, median interpolates, meanGrad is the mean of the summed gradient along y and x.
    Sums of whole numbers stay whole until one division, so equal inputs give equal results on any cluster. ``dense`` adds missing segment
    numbers with zeros. Negative segments are left out.
    """
    if not statistics or not channels:
        raise ValueError("some statistics and channels have to be chosen")
    unknown = set(statistics) - set(STATISTICS)
    if unknown:
        raise ValueError(f"unknown statistics: {sorted(unknown)}")
    px = _clean(px, channels)
    if "meanGrad" in statistics:
        depth = ["z"] if "z" in px.columns else []
        for c in channels:
            px = px.withColumn(f"_g_{c}", gradient_twice(c, depth))
    n = F.count("*")
    aggs = []
    for s in statistics:
        for c in channels:
            whole = px.schema[c].dataType.simpleString() in INTEGRAL
            v = F.col(c)
            made = {
                "mean": F.sum(v) / n,
                "std": F.sqrt((n * F.sum(v * v) - F.sum(v) * F.sum(v)).cast("double")) / n if whole else F.stddev_pop(v),
                "energy": F.sum(v * v) / n,
                "median": F.median(v),
                "meanGrad": F.sum(f"_g_{c}") / (2 * n) if s == "meanGrad" else None,
            }[s]
            aggs.append(made.cast("double").alias(f"{prefix}{c}_{s}"))
    out = px.where(F.col(segment) >= 0).groupBy(*KEY, segment).agg(*aggs)
    return fill_segments(out, segment, 0.0) if dense else out


def fill_segments(rows: DataFrame, segment: str, value: float) -> DataFrame:
    """Adds the segment numbers from 0 that are missing in an image, with one value in all other columns."""
    top = rows.groupBy(*KEY).agg(F.max(segment).alias("_m"))
    grid = top.select(*KEY, F.explode(F.sequence(F.lit(0), F.col("_m")).cast("array<int>")).alias(segment))
    return grid.join(rows, [*KEY, segment], "left").fillna(value)


def centroids(px: DataFrame, segment: str, axes: tuple[str, ...] = ("y", "x"), dense: bool = False) -> DataFrame:
    """Rows (img, segment, n, c_<axis>...); missing segments, if asked for, are at -1."""
    n = F.count("*")
    out = px.where(F.col(segment) >= 0).groupBy(*KEY, segment).agg(n.alias("n"), *[(F.sum(a) / n).alias(f"c_{a}") for a in axes])
    return fill_segments(out, segment, -1) if dense else out


def main_axis(px: DataFrame, segment: str) -> DataFrame:
    """Rows (img, segment, c_y, c_x, theta): centroid and angle of the main axis, in whole degrees from 0 to 359."""
    m = px.groupBy(*KEY, segment).agg(
        F.avg("y").alias("c_y"), F.avg("x").alias("c_x"), F.var_pop("y").alias("_a"), F.var_pop("x").alias("_b"), F.covar_pop("y", "x").alias("_c"))
    theta = F.degrees(0.5 * F.atan2(2 * F.col("_c"), F.col("_b") - F.col("_a")))
    return m.select(*KEY, segment, "c_y", "c_x", F.pmod(F.bround(theta), F.lit(360.0)).alias("theta"))


def disk_histogram(px: DataFrame, label: str, pts: DataFrame, radii: list[int], rings: bool = True) -> DataFrame:
    """Label counts around points: (img, idx, radius, label, n, size), within disks or the rings between them."""
    n = near_points(px, [label], pts, radii, rings).groupBy(*KEY, "idx", "radius", label).agg(F.count("*").alias("n"))
    return n.withColumn("size", F.sum("n").over(Window.partitionBy(*KEY, "idx", "radius")))


def disk_means(px: DataFrame, values: list[str], pts: DataFrame, radii: list[int], rings: bool = True) -> DataFrame:
    """Means of values, as of class probabilities, around points: (img, idx, radius, size, values...)."""
    return near_points(px, values, pts, radii, rings).groupBy(*KEY, "idx", "radius").agg(F.count("*").alias("size"), *[(F.sum(v) / F.count("*")).alias(v) for v in values])


def near_points(px: DataFrame, columns: list[str], pts: DataFrame, radii: list[int], rings: bool) -> DataFrame:
    """Pixels within the largest radius of points (img, idx, y, x), with the radius of the ring, or of each disk, that they are in.

    Points reach the cells of a grid as wide as the largest disk, so pixels and points meet by an equi-join on the cell.
    """
    r = max(radii)
    cell = lambda c: F.floor(F.col(c) / r).cast("int")
    p = pts.select(*KEY, "idx", F.col("y").alias("_y"), F.col("x").alias("_x"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    p = p.withColumn("_dy", F.explode(around)).withColumn("_dx", F.explode(around))
    p = p.withColumn("_cy", cell("_y") + F.col("_dy")).withColumn("_cx", cell("_x") + F.col("_dx"))
    near = px.select(*KEY, "y", "x", *columns, cell("y").alias("_cy"), cell("x").alias("_cx")).join(p, [*KEY, "_cy", "_cx"])
    d2 = (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")) + (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x"))
    near = near.withColumn("_d2", d2).where(F.col("_d2") <= r * r)
    order = sorted(radii)
    if rings:
        ring = F.lit(None).cast("int")
        for q in reversed(order):
            ring = F.when(F.col("_d2") <= q * q, q).otherwise(ring)
        near = near.withColumn("radius", ring)
    else:
        near = near.withColumn("radius", F.explode(F.filter(F.array(*map(F.lit, order)), lambda q: F.col("_d2") <= q * q)))
    return near
