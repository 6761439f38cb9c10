"""Label rasters: histograms, overlaps, relabelling, contours and distance maps.

Rasters are rows (img, y, x, label columns); negative labels mean unknown. All operators group by ``KEY``, so any number of
images is handled at once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.session import checkpoint_folder

KEY = ["img"]
BAND = 16


def histogram_counts(seg: DataFrame, segment: str, label: str, dense: bool = True) -> DataFrame:
    """Pixels of each label in each segment: (img, segment, label, n); dense rows hold zeros, too."""
    counts = seg.where((F.col(label) >= 0) & (F.col(segment) >= 0)).groupBy(*KEY, segment, label).agg(F.count("*").alias("n"))
    if not dense:
        return counts
    top = counts.groupBy(*KEY).agg(F.max(segment).alias("_s"), F.max(label).alias("_l"))
    grid = top.select(*KEY, F.explode(F.sequence(F.lit(0), F.col("_s")).cast("array<int>")).alias(segment), "_l")
    grid = grid.select(*KEY, segment, F.explode(F.sequence(F.lit(0), F.col("_l")).cast("array<int>")).alias(label))
    return grid.join(counts, [*KEY, segment, label], "left").fillna(0, ["n"])


def histogram_norm(seg: DataFrame, segment: str, label: str) -> DataFrame:
    """As ``histogram_counts``, with each segment's shares (0 for a segment without pixels)."""
    total = F.sum("n").over(Window.partitionBy(*KEY, segment))
    return histogram_counts(seg, segment, label).withColumn("ratio", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def assign_by_max(seg: DataFrame, segment: str, label: str) -> DataFrame:
    """Each segment's most frequent label, the smallest of equals: (img, segment, label, purity)."""
    counts = histogram_counts(seg, segment, label, dense=False)
    best = counts.groupBy(*KEY, segment).agg(F.max_by(label, F.struct("n", -F.col(label))).alias(label), F.max("n").alias("_n"), F.sum("n").alias("_t"))
    return best.select(*KEY, segment, label, (F.col("_n") / F.col("_t")).alias("purity"))


def assign_by_threshold(seg: DataFrame, segment: str, label: str, threshold: float = 0.75) -> DataFrame:
    """As ``assign_by_max``, but -1 unless the share is above the threshold (equality is not enough)."""
    return assign_by_max(seg, segment, label).withColumn(label, F.when(F.col("purity") > threshold, F.col(label)).otherwise(-1))


def purity_filter(assigned: DataFrame, label: str, purity: float) -> DataFrame:
    """-1 where the purity is below the bound (equality is kept)."""
    return assigned.withColumn(label, F.when(F.col("purity") < purity, -1).otherwise(F.col(label)))


def overlap_matrix(seg: DataFrame, ref: str, est: str) -> DataFrame:
    """Pixels of each pair of labels of two segmentations, unknown ones left out: (img, ref, est, n)."""
    return seg.where((F.col(ref) >= 0) & (F.col(est) >= 0)).groupBy(*KEY, ref, est).agg(F.count("*").alias("n"))


def relabel_merge(seg: DataFrame, ref: str, est: str, keep_background: bool = False) -> DataFrame:
    """Relabel ``est`` by the ``ref`` label that overlaps most; several labels may get one name. Unknown pixels stay.

    The table of new names runs over the longer side of the overlap matrix: with more estimated than reference labels
    it gives each estimated label its best reference label, otherwise row numbers are looked up by estimated label.
    """
    n = overlap_matrix(seg, ref, est).where(f"{ref} > 0 and {est} > 0" if keep_background else "true")
    top = seg.groupBy(*KEY).agg((F.max(ref) + 1).alias("_r"), (F.max(est) + 1).alias("_e"))
    by_est = n.groupBy(*KEY, est).agg(F.max_by(ref, F.struct("n", -F.col(ref))).alias("_c"))
    by_ref = n.groupBy(*KEY, F.col(ref).alias(est)).agg(F.max_by(est, F.struct("n", -F.col(est))).alias("_d"))
    seen = seg.where(F.col(est) >= 0).select(*KEY, est).distinct()
    zero = F.lit(1 if keep_background else 0)
    lut = seen.join(top, KEY).join(by_est, [*KEY, est], "left").join(by_ref, [*KEY, est], "left")
    new = F.when(F.col("_r") > F.col("_e"), F.coalesce("_d", zero)).otherwise(F.coalesce("_c", zero))
    if keep_background:
        new = F.when(F.col(est) == 0, 0).otherwise(new)
    lut = lut.select(*KEY, est, new.cast("int").alias("new"))
    return seg.join(lut, [*KEY, est], "left").withColumn("new", F.coalesce("new", est))


def relabel_unique(seg: DataFrame, ref: str, est: str) -> DataFrame:
    """Relabel ``est`` one to one: again and again the largest overlap left (first in row order of equals) names a label.

    The greedy choice depends on order; every round takes, at once, all overlaps that are the best left of both their row and their column, which
    are those that the one-by-one choice takes, too. Labels without partner keep theirs if it is free, else get -1.
    """
    checkpoint_folder(seg.sparkSession)
    left = overlap_matrix(seg, ref, est)
    order = F.struct("n", -F.col(ref), -F.col(est))
    done = None
    while True:  # each round takes the best overlap left of each image at least
        left = left.withColumn("_o", order)
        ranked = left.withColumn("_a", F.max("_o").over(Window.partitionBy(*KEY, ref))).withColumn("_b", F.max("_o").over(Window.partitionBy(*KEY, est)))
        taken = ranked.where("_o = _a and _o = _b").select(*KEY, ref, est).checkpoint()
        if taken.isEmpty():
            break
        done = taken if done is None else done.union(taken)
        left = left.drop("_o").join(taken.select(*KEY, ref), [*KEY, ref], "left_anti").join(taken.select(*KEY, est), [*KEY, est], "left_anti").checkpoint()
    names = seg.where(F.col(est) >= 0).select(*KEY, est).distinct()
    if done is None:
        return seg.withColumn("new", F.col(est))
    lut = names.join(done.withColumnRenamed(ref, "_new"), [*KEY, est], "left")
    used = done.select(*KEY, F.col(ref).alias(est), F.lit(True).alias("_used"))
    lut = lut.join(used, [*KEY, est], "left").select(*KEY, est, F.coalesce("_new", F.when(F.col("_used").isNull(), F.col(est)).otherwise(-1)).alias("new"))
    return seg.join(lut, [*KEY, est], "left").withColumn("new", F.coalesce("new", est))


def relabel_by_table(seg: DataFrame, label: str, table: dict[int, list[int]]) -> DataFrame:
    """New labels by {new: [old, ...]}; others become 0."""
    pairs = [F.lit(v) for new, olds in table.items() for old in olds for v in (old, new)]
    return seg.withColumn(label, F.coalesce(F.create_map(*pairs)[F.col(label)], F.lit(0)))


def mask_labels(label: str, labels: list[int], initial: Column | None = None) -> Column:
    """Whether a pixel has one of the labels, or is set in the initial mask."""
    mask = F.col(label).isin(labels)
    return mask if initial is None else mask | initial


def sequence_merge(stack: DataFrame, label: str, free: list[int], change: int = -1) -> DataFrame:
    """Over a stack of rasters: the label that a pixel keeps throughout (free ones stand for any), else ``change``."""
    kept = F.collect_set(F.when(~F.col(label).isin(free), F.col(label)))
    return stack.groupBy(*KEY, "y", "x").agg(kept.alias("_s")).select(*KEY, "y", "x", F.when(F.size("_s") == 1, F.col("_s")[0]).otherwise(change).cast("int").alias("label"))


def neighbours(seg: DataFrame, label: str, axes: tuple[str, ...] = ("y", "x")) -> list[Column]:
    """The label before and after each pixel, along each axis; null beyond the border."""
    out = []
    for axis in axes:
        w = Window.partitionBy(*KEY, *[a for a in axes if a != axis]).orderBy(axis)
        out += [F.lag(label).over(w), F.lead(label).over(w)]
    return out


def contour(seg: DataFrame, label: str, value: int, include_boundary: bool = False) -> DataFrame:
    """Adds ``contour``: inner pixels of a label with another one beside, and (if asked) its pixels at the image border."""
    around = seg
    names = []
    for k, c in enumerate(neighbours(seg, label)):
        around, names = around.withColumn(f"_n{k}", c), [*names, f"_n{k}"]
    inner = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    other = reduce(lambda a, b: a | b, [F.col(n) != value for n in names])
    hit = inner & other
    if include_boundary:
        hit = F.when(inner, other).otherwise(True)
    return around.withColumn("contour", (F.col(label).eqNullSafe(value) & hit).cast("int")).drop(*names)


def thick_boundary(seg: DataFrame, label: str) -> DataFrame:
    """Adds ``boundary``: pixels with another label beside, on both sides of it."""
    around, names = seg, []
    for k, c in enumerate(neighbours(seg, label)):
        around, names = around.withColumn(f"_n{k}", c), [*names, f"_n{k}"]
    other = reduce(lambda a, b: a | b, [F.coalesce(F.col(n) != F.col(label), F.lit(False)) for n in names])
    return around.withColumn("boundary", other.cast("int")).drop(*names)


def distance_to(seg: DataFrame, mark: str) -> DataFrame:
    """Adds ``d2``: squared distance to the nearest pixel of the image with ``mark`` = 1 (null if there is none)."""
    return nearest_mark(seg, mark).drop("_ny", "_nx")


def nearest_mark(seg: DataFrame, mark: str) -> DataFrame:
    """Adds the place (_ny, _nx) of the nearest pixel with ``mark`` = 1, of equally near ones the first in row order, and ``d2``.

    Two passes: the nearest mark along the column by windows, then, for bands of ``BAND`` rows, the best column of the row in numpy; a pixel is
    one row throughout, whatever the image's size.
    """
    down = Window.partitionBy(*KEY, "x").orderBy("y")
    at = F.when(F.col(mark) == 1, F.col("y"))
    above, below = F.last(at, True).over(down.rowsBetween(Window.unboundedPreceding, 0)), F.first(at, True).over(down.rowsBetween(0, Window.unboundedFollowing))
    col = seg.select(*KEY, "y", "x", above.alias("_a"), below.alias("_b"))
    near = F.when(F.col("_a").isNull() | (F.col("_b") - F.col("y") < F.col("y") - F.col("_a")), F.col("_b")).otherwise(F.col("_a"))
    kinds = dict(seg.dtypes)
    rows = col.select(*KEY, "y", "x", near.cast("long").alias("_m"), F.floor(F.col("y") / BAND).alias("_band"))
    best = rows.groupBy(*KEY, "_band").applyInArrow(_nearest_in_rows, f"img {kinds['img']}, y {kinds['y']}, x {kinds['x']}, d2 long, _ny {kinds['y']}, _nx {kinds['x']}")
    return seg.join(best, [*KEY, "y", "x"], "left")


def _nearest_in_rows(table: pa.Table) -> pa.Table:
    """The nearest of the marks that are known for the columns of each row, by (distance, y, x)."""
    table = table.sort_by([("y", "ascending"), ("x", "ascending")])
    y, x = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
    known, m = table.column("_m").is_valid().to_numpy(), table.column("_m").fill_null(0).to_numpy()
    d2, ny, nx = (np.full(len(y), -1, np.int64) for _ in range(3))
    cut = np.flatnonzero(np.r_[True, y[1:] != y[:-1], True])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        at = np.flatnonzero(known[a:b]) + a
        at = at[np.lexsort((x[at], m[at]))]
        for s in range(a, b, 512) if len(at) else ():
            t = min(s + 512, b)
            far = (x[s:t, None] - x[None, at]) ** 2 + (y[a] - m[None, at]) ** 2
            k = far.argmin(axis=1)
            d2[s:t], ny[s:t], nx[s:t] = far[np.arange(t - s), k], m[at[k]], x[at[k]]
    none = d2 < 0
    return pa.table({"img": table.column("img"), "y": table.column("y"), "x": table.column("x"), "d2": pa.array(d2, mask=none), "_ny": pa.array(ny, mask=none).cast(table.schema.field("y").type), "_nx": pa.array(nx, mask=none).cast(table.schema.field("x").type)})


def boundary_distance(seg: DataFrame, ref: str, est: str) -> DataFrame:
    """For thick boundary pixels of ``ref``: (img, y, x, distance) to the nearest thick boundary pixel of ``est``."""
    marks = thick_boundary(seg, ref).withColumnRenamed("boundary", "_ref")
    marks = distance_to(thick_boundary(marks, est), "boundary")
    return marks.where("_ref = 1").select(*KEY, "y", "x", F.sqrt(F.col("d2").cast("double")).alias("distance"))


def border_mode(seg: DataFrame, label: str, size: int = 1) -> DataFrame:
    """The most frequent label of the four border strips (corners count twice), the smallest of equals: (img, label)."""
    w = Window.partitionBy(*KEY)
    sized = seg.withColumn("_h", F.max("y").over(w)).withColumn("_w", F.max("x").over(w))
    strips = (F.col("y") < size, F.col("x") < size, F.col("y") > F.col("_h") - size, F.col("x") > F.col("_w") - size)
    times = reduce(lambda a, b: a + b, [s.cast("long") for s in strips])
    n = sized.groupBy(*KEY, label).agg(F.sum(times).alias("n"))
    return n.groupBy(*KEY).agg(F.max_by(label, F.struct("n", -F.col(label))).alias(label))


def background_on_border(seg: DataFrame, label: str, background: int = 0, size: int = 1) -> DataFrame:
    """Swap labels so that the border's most frequent one is the background."""
    mode = border_mode(seg, label, size).withColumnRenamed(label, "_m")
    new = F.when(F.col(label) == F.col("_m"), background).when(F.col(label) == background, F.col("_m")).otherwise(F.col(label))
    return seg.join(mode, KEY).withColumn(label, new).drop("_m")


def merge_probabilities(proba: DataFrame, table: dict[int, list[int]]) -> DataFrame:
    """Sum class probabilities (…, cls, p) by {new: [old, ...]}; an old class may count for several new ones."""
    pairs = F.array(*[F.struct(F.lit(new).alias("new"), F.lit(old).alias("old")) for new, olds in table.items() for old in olds])
    keys = [c for c in proba.columns if c not in ("cls", "p")]
    each = proba.withColumn("_m", F.explode(F.filter(pairs, lambda m: m["old"] == F.col("cls"))))
    return each.groupBy(*keys, F.col("_m.new").alias("cls")).agg(F.sum("p").alias("p"))


def merge_masks(masks: DataFrame, overlap: float = 0.7) -> DataFrame:
    """Masks (img, idx, y, x), a row a pixel, drawn over one another by idx: (img, y, x, label).

    A mask whose intersection with what is visible of one drawn before is more than ``overlap`` of their union is left out; labels count those drawn, from 1. Pixels
    under the same masks are counted together first, and only these counts, as many as there are ways masks overlap, are gone through one mask after the other.
    """
    under = masks.where("idx is not null").groupBy(*KEY, "y", "x").agg(F.sort_array(F.collect_set(F.col("idx").cast("long"))).alias("on"))
    ways = under.groupBy(*KEY, "on").agg(F.count("*").alias("n"))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        on, n = [set(r) for r in rows["on"]], rows["n"].to_numpy()
        top = np.zeros(len(n), np.int64)  # label that is visible
        drawn: dict[int, int] = {}
        for idx in sorted(set().union(*on)):
            here = np.array([idx in r for r in on])
            seen, both = np.bincount(top, n, len(drawn) + 1)[1:], np.bincount(top[here], n[here], len(drawn) + 1)[1:]
            if not (both > overlap * (seen + n[here].sum() - both)).any():
                drawn[idx] = len(drawn) + 1
                top[here] = drawn[idx]
        return pd.DataFrame({"img": rows["img"].iloc[0], "idx": list(drawn), "label": list(drawn.values())})

    labels = ways.groupBy(*KEY).applyInPandas(draw, f"img {dict(masks.dtypes)['img']}, idx long, label int")
    return under.select(*KEY, "y", "x", F.explode("on").alias("idx")).join(labels, [*KEY, "idx"]).groupBy(*KEY, "y", "x").agg(F.max("label").alias("label"))
