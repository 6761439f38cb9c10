"""Further registered queries: whole rasters, boundaries, shapes, filters, volumes and trained models."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from pixelmill.functions import color
from pixelmill.operators import boundary, datasets, features, filters, graph, labels, metrics, ml, pixelwise, segmentation, spatial
from pixelmill.plans.catalog import _ELL, CHANNELS, _ellipses, _px, query
from pixelmill.session import checkpoint_folder, scratch
from pixelmill.sources import files, rasters
from pixelmill.sources.rasters import P, R, S, V

_IN = "pow(((x - cx) * cos(theta) + (y - cy) * sin(theta)) / a, 2) + pow(((y - cy) * cos(theta) - (x - cx) * sin(theta)) / b, 2) <= 1"


@query(
    """SELECT img, y, x, round(CASE WHEN t = l THEN 0 WHEN t = c3 THEN 4 + (c1 - c2) / (t - l) WHEN t = c2 THEN 2 + (c3 - c1) / (t - l) ELSE ((c2 - c3) / (t - l) + 6) % 6 END / 6, 9) AS c1,
      round(CASE WHEN t = 0 THEN 0 ELSE (t - l) / t END, 9) AS c2, round(t, 9) AS c3 FROM q""", R,
    "q AS (SELECT *, greatest(c1, c2, c3) AS t, least(c1, c2, c3) AS l FROM (SELECT img, y, x, c1 / 500.0 AS c1, c2 / 100.0 AS c2, c3 / 100.0 AS c3 FROM r))")
def color_hsv(spark, sf):
    """Hue, saturation and value of the scaled channels."""
    px = _px(spark, sf).select("img", "y", "x", (F.col("c1") / 500).alias("c1"), (F.col("c2") / 100).alias("c2"), (F.col("c3") / 100).alias("c3"))
    return color.convert(px, CHANNELS, "hsv").withColumns({c: F.round(c, 9) for c in CHANNELS})


@query("SELECT img, y, x, round(r, 9) AS c1, round(g, 9) AS c2, round(b, 9) AS c3 FROM (SELECT img, y, x, c1 / 500.0 AS r, c2 / 100.0 AS g, c3 / 100.0 AS b FROM r)", R)
def color_back(spark, sf):
    """To hue, saturation and value, and back to red, green and blue."""
    px = _px(spark, sf).select("img", "y", "x", (F.col("c1") / 500).alias("c1"), (F.col("c2") / 100).alias("c2"), (F.col("c3") / 100).alias("c3"))
    back = color.convert_back(color.convert(px, CHANNELS, "hsv"), CHANNELS, "hsv")
    return back.withColumns({c: F.round(c, 9) for c in CHANNELS})


@query("SELECT img, lb, CASE WHEN purity < 0.8 THEN -1 ELSE annot END AS annot, purity FROM (SELECT img, lb, annot, n / sum(n) OVER (PARTITION BY img, lb) AS purity, row_number() OVER (PARTITION BY img, lb ORDER BY n DESC, annot) AS k FROM (SELECT img, lb, annot, count(*) AS n FROM r GROUP BY ALL)) WHERE k = 1", R)
def purity_filter(spark, sf):
    return labels.purity_filter(labels.assign_by_max(_px(spark, sf), "lb", "annot"), "annot", 0.8)


@query(
    "SELECT r.img, y, x, CASE WHEN annot = m THEN 0 WHEN annot = 0 THEN m ELSE annot END AS annot FROM r JOIN b USING (img)", R,
    "b AS (SELECT img, annot AS m FROM (SELECT img, annot, row_number() OVER (PARTITION BY img ORDER BY sum(CAST(y < 2 AS INT) + CAST(x < 2 AS INT) + CAST(y > 97 AS INT) + CAST(x > 97 AS INT)) DESC, annot) AS k FROM r GROUP BY img, annot) WHERE k = 1)")
def background_swap(spark, sf):
    return labels.background_on_border(_px(spark, sf), "annot", 0, 2).select("img", "y", "x", "annot")


@query(
    "SELECT CAST(f.range AS INT) AS fold, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM (SELECT ceil(count(DISTINCT label) / 3)::BIGINT AS folds, count(DISTINCT label) AS n FROM embeddings) t, range(64) f, range(3) k JOIN l ON l.place = (f.range * 3 + k.range) % t.n WHERE f.range < t.folds GROUP BY f.range",
    "l AS (SELECT vec_id, dense_rank() OVER (ORDER BY label) - 1 AS place FROM embeddings WHERE label IS NOT NULL)")
def fold_table(spark, sf):
    """Vectors of the three labels that each fold holds out; the last, short one begins again."""
    f = rasters.features(spark, sf).where("label IS NOT NULL")
    names = sorted(r[0] for r in f.select("label").distinct().collect())  # labels are classes
    held = [(fold, names[k]) for fold, places in enumerate(datasets.fold_table(len(names), 3)) for k in places]
    return f.join(spark.createDataFrame(held, "fold int, label int"), "label").groupBy("fold").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@query(
    "SELECT img, e, round(coalesce(sum(w * CASE annot WHEN 0 THEN -ln(0.2) + ln(0.8) WHEN 1 THEN -ln(0.9) + ln(0.1) ELSE -ln(0.6) + ln(0.4) END) FILTER (" + _IN + "), 0), 6) AS crit FROM s JOIN el USING (img) GROUP BY img, e", R, _ELL,
    "s AS (SELECT img, lb, avg(y) AS y, avg(x) AS x, CAST(floor(median(annot)) AS INT) AS annot, count(*) AS w FROM r GROUP BY img, lb)")
def ellipse_criterion(spark, sf):
    """How well ellipses part superpixels by the chances of their labels."""
    s = _px(spark, sf).groupBy("img", F.col("lb").alias("idx")).agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.median("annot").cast("int").alias("label"), F.count("*").alias("weight"))
    return spatial.criterion(s, _ellipses(spark, sf), (0.2, 0.9, 0.6)).withColumn("crit", F.round("crit", 6))


@query("SELECT vec_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS k, unnest(s) AS v FROM (SELECT vec_id, list_concat(e[p:], e[1:p - 1]) AS s FROM (SELECT *, list_position(e, list_max(e)) AS p FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings)))")
def shifted_rays(spark, sf):
    f = rasters.features(spark, sf)
    return f.select("vec_id", F.posexplode(spatial.shifted_to_longest("features")).alias("k", "v"))


_BOX = "b AS (SELECT img, annot, greatest(min(y) - 3, 0) AS y0, greatest(min(x) - 3, 0) AS x0, least(max(y) + 4, 100) AS y1, least(max(x) + 4, 100) AS x1 FROM (SELECT img, y, x, annot FROM r WHERE c1 > 150) WHERE annot > 0 GROUP BY img, annot)"


def _boxes(spark, sf):
    px = _px(spark, sf).withColumn("annot", F.when(F.col("c1") > 150, F.col("annot")).otherwise(0))
    return px, pixelwise.bounding_boxes(px, "annot", 3)


@query("SELECT * FROM b", R, _BOX)
def bounding_boxes(spark, sf):
    return _boxes(spark, sf)[1]


@query("SELECT r.img, b.annot AS object, r.y - y0 AS y, r.x - x0 AS x, c1 FROM r JOIN b ON r.img = b.img AND y >= y0 AND y < y1 AND x >= x0 AND x < x1", R, _BOX)
def cropped_objects(spark, sf):
    px, boxes = _boxes(spark, sf)
    return pixelwise.crop(px, boxes, "annot").select("img", "object", "y", "x", "c1")


@query("SELECT idx, greatest(y - 7, 0) AS b0, least(y + 8, 100) AS b1, greatest(y - 7, 0) - y + 7 AS w0, least(y + 8, 100) - y + 7 AS w1 FROM pts", P)
def crop_windows(spark, sf):
    """Windows of 15 rows around points, cut at the image's border."""
    p = rasters.points(spark, sf)
    cols = pixelwise.crop_window(F.col("y"), F.lit(100), 15)
    return p.select("idx", *[c.alias(n) for c, n in zip(cols, ("b0", "b1", "w0", "w1"), strict=True)])


@query("SELECT r.img, r.y, r.x, CAST(p.y IS NOT NULL AS INT) AS mask FROM r LEFT JOIN (SELECT DISTINCT img, y, x FROM pts) p USING (img, y, x)", R, P)
def mask_of_points(spark, sf):
    return pixelwise.mask_from_points(_px(spark, sf), rasters.points(spark, sf)).select("img", "y", "x", "mask")


@query("SELECT img, y, x, CAST(dense_rank() OVER (PARTITION BY img ORDER BY (c1 * 7) % 23) - 1 AS INT) AS k FROM r", R)
def relabel_sequential(spark, sf):
    px = _px(spark, sf).select("img", "y", "x", ((F.col("c1") * 7) % 23).alias("k"))
    return pixelwise.relabel_sequential(px, "k")


_NEAR = "p AS (SELECT r.img, r.y, r.x, arg_min(k.{v}, {{'d': (r.y - k.y) * (r.y - k.y) + (r.x - k.x) * (r.x - k.x), 'y': k.y, 'x': k.x}}) AS v FROM r JOIN k ON r.img = k.img GROUP BY ALL)"


@query("SELECT img, y, x, v AS annot FROM p", R, "k AS (SELECT img, y, x, annot FROM r WHERE c1 > 100)", _NEAR.format(v="annot"))
def inpaint_nearest(spark, sf):
    """Classes of dark pixels filled from the nearest bright one."""
    return pixelwise.inpaint(_px(spark, sf), F.col("c1") > 100, ["annot"]).select("img", "y", "x", "annot")


@query("SELECT img, y, x, v AS c2 FROM p", R, "k AS (SELECT img, y, x, c2 FROM r WHERE c2 IN (3, 8))", _NEAR.format(v="c2"))
def quantize_nearest_pixel(spark, sf):
    return pixelwise.quantize_nearest_pixel(_px(spark, sf), [(3,), (8,)], ["c2"]).select("img", "y", "x", "c2")


@query("SELECT y, x, median(c1) AS c1 FROM r GROUP BY y, x", R)
def median_image(spark, sf):
    return pixelwise.median_image(_px(spark, sf), "c1")


_CC = "t AS (SELECT y, x, median(c1) AS m FROM r GROUP BY y, x), cc AS (SELECT img, corr(r.c1, m) AS a, corr(f.c1, m) AS b FROM r JOIN t USING (y, x) JOIN r f USING (img) WHERE f.y = 99 - r.y AND f.x = 99 - r.x GROUP BY img)"


@query("SELECT img, round(a, 9) AS cc FROM cc", R, _CC)
def correlation(spark, sf):
    px = _px(spark, sf)
    return pixelwise.correlation(px, pixelwise.median_image(px, "c1"), "c1").withColumn("cc", F.round("cc", 9))


@query("SELECT r.img, CASE WHEN a < b THEN 99 - y ELSE y END AS y, CASE WHEN a < b THEN 99 - x ELSE x END AS x, c1 FROM r JOIN cc USING (img)", R, _CC)
def oriented(spark, sf):
    """Images turned where that makes them more like the median image."""
    px = _px(spark, sf).select("img", "y", "x", "c1")
    return pixelwise.oriented(px, pixelwise.swap_by_correlation(px, pixelwise.median_image(px, "c1"), "c1"))


@query("SELECT img, count(*) FILTER (c1 > m AND x < 33) > count(*) FILTER (c1 > m AND x >= 67) AS swap FROM r JOIN (SELECT img, avg(c1) FILTER (c1 > lo) AS m FROM r JOIN (SELECT img, min(c1) AS lo FROM r GROUP BY img) USING (img) GROUP BY img) USING (img) GROUP BY img", R)
def swap_density(spark, sf):
    return pixelwise.swap_by_density(_px(spark, sf), "c1")


@query("SELECT img, y, x, round((c1 + coalesce(CASE WHEN y < 60 THEN c2 END, 0)) / 2, 9) AS v FROM r", R)
def overlay_mean(spark, sf):
    px = _px(spark, sf)
    parts = [px.select("img", "y", "x", F.col("c1").alias("v")), px.where("y < 60").select("img", "y", "x", F.col("c2").alias("v"))]
    return pixelwise.overlay_mean(parts, ["v"]).withColumn("v", F.round("v", 9))


@query("SELECT img, y, x, CASE (y // 7 + x // 7) % 3 WHEN 0 THEN c1 WHEN 1 THEN c2 ELSE CASE WHEN y < 60 THEN c3 ELSE 0 END END AS v FROM r", R)
def overlay_chess(spark, sf):
    px = _px(spark, sf)
    parts = [px.select("img", "y", "x", F.col(c).alias("v")) for c in ("c1", "c2")] + [px.where("y < 60").select("img", "y", "x", F.col("c3").alias("v"))]
    return pixelwise.overlay_chess(parts, ["v"], 7)


_ANN = "an AS (SELECT img, CAST(e.range AS INT) AS e, 15.0 + 9 * e.range AS ay, 20.0 + 7 * e.range + img AS ax, 45.0 + 6 * e.range AS py, 50.0 + 5 * e.range AS px, 25.0 + 8 * e.range AS ly, 48.0 + 3 * e.range AS lx FROM (SELECT DISTINCT img FROM r), range(6) e)"
_PROJ = "pj AS (SELECT *, ay + t * (py - ay) AS qy, ax + t * (px - ax) AS qx FROM (SELECT *, ((ly - ay) * (py - ay) + (lx - ax) * (px - ax)) / ((py - ay) * (py - ay) + (px - ax) * (px - ax)) AS t FROM an))"


def _annotations(spark, sf):
    e = F.col("e")
    a = _px(spark, sf).select("img").distinct().withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(5))))
    cols = {"ant_y": 15.0 + 9 * e, "ant_x": 20.0 + 7 * e + F.col("img"), "post_y": 45.0 + 6 * e, "post_x": 50.0 + 5 * e, "lat_y": 25.0 + 8 * e, "lat_x": 48.0 + 3 * e}
    return a.withColumns(cols)


@query(
    "SELECT img, e, trunc((ay + py) / 2) AS cy, trunc((ax + px) / 2) AS cx, trunc(sqrt(pow(py - ay, 2) + pow(px - ax, 2)) / 2 / sqrt(2.0)) AS a, trunc(sqrt(pow(ly - qy, 2) + pow(lx - qx, 2)) / sqrt(2.0)) AS b, round(atan2(py - ay, px - ax), 9) AS theta FROM pj", R, _ANN, _PROJ)
def annotated_ellipses(spark, sf):
    return pixelwise.ellipses_of_annotations(_annotations(spark, sf)).withColumn("theta", F.round("theta", 9))


@query("SELECT r.img, y, x, e FROM r JOIN pj USING (img) WHERE (y - ay) * (py - ay) + (x - ax) * (px - ax) BETWEEN 0 AND pow(py - ay, 2) + pow(px - ax, 2) AND abs((y - ay) * (ly - qy) + (x - ax) * (lx - qx)) <= pow(ly - qy, 2) + pow(lx - qx, 2)", R, _ANN, _PROJ)
def annotated_rectangles(spark, sf):
    return pixelwise.draw_rectangles(_px(spark, sf), _annotations(spark, sf))


@query(
    "SELECT g.img, g.y, g.x, round(sum(r.c1 * CASE WHEN i.range = 0 THEN 1 - fy % 1 ELSE fy % 1 END * CASE WHEN j.range = 0 THEN 1 - fx % 1 ELSE fx % 1 END), 6) AS c1 FROM g, range(2) i, range(2) j, r WHERE r.img = g.img AND r.y = least(floor(fy) + i.range, 99) AND r.x = least(floor(fx) + j.range, 99) GROUP BY ALL", R,
    "g AS (SELECT img, CAST(a.range AS INT) AS y, CAST(b.range AS INT) AS x, least(greatest((a.range + 0.5) * 100 / 37 - 0.5, 0.0), 99.0) AS fy, least(greatest((b.range + 0.5) * 100 / 61 - 0.5, 0.0), 99.0) AS fx FROM (SELECT DISTINCT img FROM r), range(37) a, range(61) b)")
def resized(spark, sf):
    return pixelwise.resized(_px(spark, sf), ["c1"], 37, 61).withColumn("c1", F.round("c1", 6))


def _taps(kernel) -> str:
    return "tap(dy, dx, w) AS (VALUES " + ", ".join(f"({a}, {b}, {w!r}::DOUBLE)" for a, b, w in kernel) + ")"


_MIRROR = "CASE WHEN {0} < 0 THEN -1 - {0} WHEN {0} > 99 THEN 199 - {0} ELSE {0} END"
_FILTERED = "SELECT o.img, o.y, o.x, round({head}sum(w * v.c1), 6) AS c1 FROM (SELECT img, y, x, c1, w, " + _MIRROR.format("(y + dy)") + " AS my, " + _MIRROR.format("(x + dx)") + " AS mx FROM r, tap) o JOIN r v ON v.img = o.img AND v.y = my AND v.x = mx GROUP BY o.img, o.y, o.x, o.c1"


@query(_FILTERED.format(head=""), R, _taps(filters.gaussian_taps(1.0, 2)))
def gauss_smooth(spark, sf):
    out = filters.convolve(_px(spark, sf), "c1", {"s": filters.gaussian_taps(1.0, 2)})
    return out.select("img", "y", "x", F.round("s", 6).alias("c1"))


@query(_FILTERED.format(head="o.c1 - "), R, _taps(filters.gaussian_taps(1.0)))
def subtract_smooth(spark, sf):
    return filters.subtract_smooth(_px(spark, sf), "c1", 1.0).select("img", "y", "x", F.round("c1", 6).alias("c1"))


@query(_FILTERED.format(head=""), R, _taps(filters.oriented_taps(1.5, math.pi / 4, 1, 3)))
def edge_response(spark, sf):
    out = filters.convolve(_px(spark, sf), "c1", {"s": filters.oriented_taps(1.5, math.pi / 4, 1, 3)})
    return out.select("img", "y", "x", F.round("s", 6).alias("c1"))


@query(
    "SELECT o.img, o.z, o.y, o.x, round(sum(w * v.c1), 6) AS c1 FROM (SELECT img, z, y, x, w, " + _MIRROR.format("(y + dy)") + " AS my, " + _MIRROR.format("(x + dx)") + " AS mx FROM vol, tap) o JOIN vol v ON v.img = o.img AND v.z = o.z AND v.y = my AND v.x = mx GROUP BY o.img, o.z, o.y, o.x",
    V, _taps(filters.laplacian_taps(1.0, 2)))
def volume_response(spark, sf):
    """A Laplacian of Gaussian in each slice of volumes."""
    out = filters.convolve(rasters.volume(spark, sf), "c1", {"s": filters.laplacian_taps(1.0, 2)}, depth=("z",))
    return out.select("img", "z", "y", "x", F.round("s", 6).alias("c1"))


@query(
    "SELECT p.idx, CASE WHEN d2 <= 1 THEN 1 WHEN d2 <= 9 THEN 3 ELSE 5 END AS radius, count(*) AS size, sum(c2) / count(*) AS c2, sum(c3) / count(*) AS c3 FROM (SELECT p.idx, r.c2, r.c3, (r.y - p.y) * (r.y - p.y) + (r.x - p.x) * (r.x - p.x) AS d2 FROM pts p JOIN r ON r.img = p.img AND r.y BETWEEN p.y - 5 AND p.y + 5 AND r.x BETWEEN p.x - 5 AND p.x + 5) p WHERE d2 <= 25 GROUP BY ALL", R, P)
def ring_means(spark, sf):
    return features.disk_means(_px(spark, sf), ["c2", "c3"], rasters.points(spark, sf), [1, 3, 5]).drop("img")


@query("SELECT img, annot, count(*) / sum(count(*)) OVER (PARTITION BY img) AS share FROM r GROUP BY img, annot", R)
def label_shares(spark, sf):
    return metrics.label_shares(_px(spark, sf), "annot")


@query("SELECT img, lb, round(avg(CASE annot WHEN 0 THEN 0.1 WHEN 1 THEN 0.9 ELSE 0.4 END), 9) AS p FROM r GROUP BY img, lb", R)
def segment_probability(spark, sf):
    return metrics.segment_probability(_px(spark, sf), "lb", "annot", [0.1, 0.9, 0.4]).withColumn("p", F.round("p", 9))


@query(
    "SELECT vec_id AS idx, CAST(k - 1 AS INT) AS k, round(10 + cos(pi() / 2 - 2 * pi() * (k - 1) / n) * d, 6) AS y, round(20 + sin(pi() / 2 - 2 * pi() * (k - 1) / n) * d, 6) AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS k, len(embedding) AS n, CAST(unnest(embedding) AS DOUBLE) * 10 AS d FROM embeddings) WHERE d >= 0")
def reconstructed_rays(spark, sf):
    f = rasters.features(spark, sf)
    arrays = f.select(F.lit(0).alias("img"), F.col("vec_id").alias("idx"), F.lit(10).alias("y"), F.lit(20).alias("x"), F.transform("features", lambda v: v * 10).alias("distances"))
    return boundary.reconstructed(arrays).select("idx", "k", F.round("y", 6).alias("y"), F.round("x", 6).alias("x"))


@query(
    "SELECT img, annot, e, round(jaccard, 9) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY img, annot ORDER BY jaccard DESC, e) AS k FROM (SELECT img, annot, e, s / (es + os - s) AS jaccard FROM (SELECT img, e, annot, count(*) AS s FROM dr WHERE annot > 0 GROUP BY ALL) JOIN (SELECT img, e, count(*) AS es FROM dr GROUP BY ALL) USING (img, e) JOIN (SELECT img, annot, count(*) AS os FROM r GROUP BY ALL) USING (img, annot))) WHERE k = 1",
    R, _ELL, "dr AS (SELECT r.img, r.y, r.x, r.annot, e FROM r JOIN el USING (img) WHERE " + _IN + ")")
def best_overlap(spark, sf):
    """The ellipse that overlaps each class most."""
    return boundary.best_overlap(_ellipses(spark, sf), _px(spark, sf), "annot").withColumn("jaccard", F.round("jaccard", 9))


_SP = """m AS (SELECT img, lb, annot FROM (SELECT img, lb, annot, row_number() OVER (PARTITION BY img, lb ORDER BY count(*) DESC, annot) AS k FROM r GROUP BY img, lb, annot) WHERE k = 1),
e AS (SELECT a.img, a.lb, b.lb AS n FROM m a JOIN m b ON a.img = b.img AND ((abs(a.lb - b.lb) = 10) OR (abs(a.lb - b.lb) = 1 AND a.lb // 10 = b.lb // 10)))"""


@query("SELECT a.img, a.lb, a.annot AS label FROM m a JOIN (SELECT e.img, e.lb, avg(CAST(b.annot = 0 AS INT)) AS bg FROM e JOIN m b ON b.img = e.img AND b.lb = e.n GROUP BY ALL) s USING (img, lb) WHERE (annot = 0 AND bg < 1) OR (annot = 1 AND bg > 0)", R, _SP)
def boundary_superpixels(spark, sf):
    px = _px(spark, sf)
    sp = labels.assign_by_max(px, "lb", "annot").select("img", "lb", F.col("annot").alias("label"))
    return boundary.boundary_superpixels(sp, graph.adjacency(px, "lb"), "lb").select("img", "lb", "label")


@query("SELECT DISTINCT ON (s) s AS score, sum(CAST(l AS INT)) OVER o / (SELECT sum(CAST(l AS INT)) FROM q) AS tpr, sum(CAST(NOT l AS INT)) OVER o / (SELECT sum(CAST(NOT l AS INT)) FROM q) AS fpr FROM q WINDOW o AS (ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "q AS (SELECT round(CAST(embedding[1] AS DOUBLE), 2) + 0.0 AS s, label < 5 AS l FROM embeddings)")
def roc_of_feature(spark, sf):
    """The curve of a score that is there already."""
    f = rasters.features(spark, sf).select((F.round(F.col("features")[0], 2) + 0.0).alias("score"), (F.col("label") < 5).cast("int").alias("label"))
    return metrics.roc(f, "label", "score")


_CELLS = """c AS (SELECT img, y // 10 AS cy, x // 10 AS cx, avg(c1) AS m1, avg(c2) AS m2, avg(c3) AS m3, avg(y) AS my, avg(x) AS mx FROM r GROUP BY ALL)"""


@query("SELECT r.img, r.y, r.x, CAST(arg_min(cy * 10 + cx, {'d': round((c1 - m1) ** 2 + (c2 - m2) ** 2 + (c3 - m3) ** 2 + ((r.y - my) ** 2 + (r.x - mx) ** 2) * 16.0, 6), 's': cy * 10 + cx}) AS INT) AS sp FROM r JOIN c ON c.img = r.img AND abs(cy - r.y // 10) <= 1 AND abs(cx - r.x // 10) <= 1 GROUP BY ALL", R, _CELLS)
def slic_round(spark, sf):
    """The first round of superpixels, whose centres are the means of a grid's cells."""
    return segmentation.superpixels(_px(spark, sf), CHANNELS, 10, 40.0, rounds=1).select("img", "y", "x", "sp")


@query(
    "SELECT v.img, v.z, v.y, v.x, CAST(arg_min(cy * 10 + cx, {'d': round((c1 - m1) ** 2 + ((2 * (v.z - mz)) ** 2 + (v.y - my) ** 2 + (v.x - mx) ** 2) * 16.0, 6), 's': cy * 10 + cx}) AS INT) AS sp FROM vol v JOIN c ON c.img = v.img AND abs(cy - v.y // 10) <= 1 AND abs(cx - v.x // 10) <= 1 GROUP BY ALL", V,
    "c AS (SELECT img, y // 10 AS cy, x // 10 AS cx, avg(c1) AS m1, avg(z) AS mz, avg(y) AS my, avg(x) AS mx FROM vol GROUP BY ALL)")
def slic_volume_round(spark, sf):
    """The same in volumes, whose slices lie two steps apart."""
    v = rasters.volume(spark, sf).drop("lb")
    return segmentation.superpixels(v, ["c1"], 10, 40.0, rounds=1, axes=("z", "y", "x"), spacing={"z": 2.0}).select("img", "z", "y", "x", "sp")


@query("SELECT a, CAST(d.range AS INT) AS d, count(*) FILTER (v >= d.range + 1) / count(*) AS p FROM (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS a, floor(abs(CAST(unnest(embedding) AS DOUBLE)) * 10) AS v FROM embeddings), range(6) d GROUP BY a, d.range")
def shape_table(spark, sf):
    """Shares of shapes that reach beyond each distance, by angle."""
    f = rasters.features(spark, sf).select(F.transform("features", lambda v: F.floor(F.abs(v) * 10).cast("double")).alias("distances"))
    return boundary.shape_models(f, "hist", reach=6).select("a", "d", "p")


@query("SELECT img, CAST(z % 2 + 1 AS INT) AS band, CAST(z // 2 AS INT) AS z, y, x, c1 FROM vol", V)
def split_bands(spark, sf):
    return files.split_bands(rasters.volume(spark, sf)).select("img", "band", "z", "y", "x", "c1")


@query("SELECT img, CAST(x * 7 // 100 + z * 7 AS INT) AS label, CAST(sum(c1) AS BIGINT) AS c1 FROM vol GROUP BY ALL", V)
def stripes(spark, sf):
    """Brightness of volumes in stripes."""
    marks = files.stripes(spark, 100, 100, 7, 4).drop("img")
    return rasters.volume(spark, sf).join(marks, ["z", "y", "x"]).groupBy("img", "label").agg(F.sum("c1").alias("c1"))


@query("SELECT CAST(idx AS INT) AS idx, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM pts", P)
def landmarks_csv(spark, sf):
    """Points written as CSV and read back."""
    path = scratch(spark, "landmarks")
    files.write_landmarks_csv(rasters.points(spark, sf), path)
    return files.landmarks_csv(spark, f"{path}/*").select("idx", "x", "y")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(max(vec_id) AS BIGINT) AS last FROM embeddings")
def shuffled_places(spark, sf):
    """Rows in a seeded order have each place once."""
    s = datasets.shuffled(rasters.features(spark, sf), "vec_id").select("vec_id", "place")
    return s.agg(F.count_distinct("place").alias("n"), F.max("vec_id").alias("last"))


@query()
def balance_clusters(spark, sf):
    """Of each label the rows nearest to as many cluster centres as the rarest label has rows."""
    f = rasters.features(spark, sf)
    return datasets.balance_by_kmeans(f, "label", "vec_id").select("label", "vec_id")


@query(
    "SELECT r.img, r.y, r.x, CASE WHEN c1 <= 60 AND reach.img IS NOT NULL THEN 0 ELSE 1 END AS m FROM r LEFT JOIN reach USING (img, y, x)", R,
    "z AS (SELECT img, y, x FROM r WHERE c1 <= 60)",
    """reach(img, y, x) AS (SELECT img, y, x FROM z WHERE y IN (0, 99) OR x IN (0, 99)
      UNION SELECT z.img, z.y, z.x FROM reach a JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx) ON TRUE JOIN z ON z.img = a.img AND z.y = a.y + dy AND z.x = a.x + dx)""")
def fill_holes(spark, sf):
    px = _px(spark, sf).select("img", "y", "x", (F.col("c1") > 60).cast("int").alias("m"))
    return pixelwise.fill_holes(px, "m")


@query()
def thin_points(spark, sf):
    pts = rasters.points(spark, sf).groupBy("img", "y", "x").agg(F.min("idx").alias("idx"))
    return spatial.thin_points(pts, 4.0)


def _objects(spark, sf):
    """The three largest regions of each image whose surroundings are bright, as labels 1 to 3."""
    px = _px(spark, sf).select("img", "y", "x", "c1")
    box = [(dy, dx, 1 / 121) for dy in range(-5, 6) for dx in range(-5, 6)]
    checkpoint_folder(spark)
    smooth = segmentation.filter_response(px, "c1", box, "s").checkpoint()
    t = smooth.groupBy("img").agg((F.avg("s") + F.stddev_pop("s") / 2).alias("t"))
    found = pixelwise.regions(smooth.join(t, "img").withColumn("m", (F.col("s") > F.col("t")).cast("int")), "m").select("img", "y", "x", "c1", "region")
    order = Window.partitionBy("img").orderBy(F.desc("n"), "region")
    sized = found.where("region IS NOT NULL").groupBy("img", "region").agg(F.count("*").alias("n")).withColumn("annot", F.row_number().over(order)).where("annot <= 3")
    return found.join(sized.select("img", "region", "annot"), ["img", "region"], "left").select("img", "y", "x", "c1", F.coalesce("annot", F.lit(0)).alias("annot")).checkpoint()


def _middles(px):
    """The pixels of objects that are nearest to their centroids."""
    mean = px.where("annot > 0").groupBy("img", "annot").agg(F.avg("y").alias("my"), F.avg("x").alias("mx"))
    d = (F.col("y") - F.col("my")) * (F.col("y") - F.col("my")) + (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx"))
    return px.join(mean, ["img", "annot"]).groupBy("img", "annot").agg(F.min_by(F.struct("y", "x"), F.struct(d, "y", "x")).alias("p")).select("img", "annot", "p.y", "p.x")


@query()
def object_shapes(spark, sf):
    return boundary.object_shapes(_objects(spark, sf), "annot", 20)


@query()
def straightened_objects(spark, sf):
    px = _objects(spark, sf)
    return pixelwise.straightened(px, "annot", ["annot"], 2)


def _one(spark, sf):
    """The largest object of an image as label 1, with holes and dots where brightness says so; and its centre."""
    px = _objects(spark, sf).withColumn("annot", (F.col("annot") == 1).cast("int"))
    centre = _middles(px).select("img", F.lit(0).alias("idx"), "y", "x")
    return px.withColumn("annot", F.when(F.col("c1") % 101 == 17, 1 - F.col("annot")).otherwise(F.col("annot"))).drop("c1"), centre


@query()
def boundary_points(spark, sf):
    px, centre = _one(spark, sf)
    return boundary.boundary_points(px, "annot", centre, "mean", 2, 3.0, 2, 2, 10)


@query()
def ransac_ellipse(spark, sf):
    """Ellipses of one object an image by random samples of its boundary."""
    px, centre = _one(spark, sf)
    pts = boundary.boundary_points(px, "annot", centre, "dist", 2, 3.0, 2, 2, 10).checkpoint()
    cell = (F.floor(F.col("y") / 4) * 25 + F.floor(F.col("x") / 4)).cast("int")
    sp = px.groupBy("img", cell.alias("idx")).agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.mode("annot").alias("label"), F.count("*").alias("weight"))
    return boundary.ransac_ellipses(pts, sp, (0.1, 0.9), 0.5, 2.0, 20)


@query()
def shape_growing(spark, sf):
    """Objects grown from seeds with a shape prior that was learned from the objects of all images."""
    px = _objects(spark, sf).withColumn("lb", (F.floor(F.col("y") / 5) * 20 + F.floor(F.col("x") / 5)).cast("int"))
    table = boundary.mean_table(boundary.shape_models(boundary.object_shapes(px, "annot", 10), "mixture", 2, 40))
    share = px.groupBy("img", "lb").agg(F.avg((F.col("annot") > 0).cast("double")).alias("p"))
    cls = F.explode(F.array(*[F.struct(F.lit(k).alias("cls"), (1 - F.col("p") if k == 0 else F.col("p")).alias("q")) for k in range(4)])).alias("c")
    unary = share.select("img", "lb", cls).select("img", "lb", "c.cls", graph.unary_cost(F.col("c.q")).alias("cost"))
    seeds = _middles(px).select("img", (F.floor(F.col("y") / 5) * 20 + F.floor(F.col("x") / 5)).cast("int").alias("lb"), F.col("annot").alias("label")).groupBy("img", "lb").agg(F.min("label").alias("label"))
    edges = graph.adjacency(px, "lb").withColumn("w", F.lit(1.0))
    return boundary.grow_shapes(px, unary, edges, seeds, graph.pairwise_matrix(4, 0.5), table, 36, 40, "lb", 0.3)


@query()
def supervised_segments(spark, sf):
    """Superpixels of each quarter of an image classified by a model of all other quarters, and how often it is right."""
    px = _px(spark, sf)
    stats = features.segment_statistics(px, "lb", CHANNELS, ("mean", "std", "energy"))
    names = [c for c in stats.columns if c not in ("img", "lb")]
    rows = stats.select("img", "lb", F.array(*names, F.col("lb").cast("double")).alias("features")).join(labels.assign_by_max(px, "lb", "annot").select("img", "lb", F.col("annot").alias("label")), ["img", "lb"])
    rows = rows.withColumn("part", (F.col("img") * 4 + F.floor(F.col("lb") / 25)).cast("int"))
    parts = rows.agg(F.count_distinct("part")).first()[0]
    made = ml.leave_groups_out(rows, "part", "decision tree", -(-parts // 4))
    return made.groupBy("img").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


@query()
def volume_classes(spark, sf):
    """Classes of the segments of volumes, by their grey values and their neighbours in three dimensions."""
    return segmentation.segment_classes(rasters.volume(spark, sf), "lb", ["c1"], 2, 0.3, axes=("z", "y", "x"))


@query("SELECT a.id, b.id AS near FROM info a JOIN info b ON a.stack = b.stack WHERE a.stage IN (1, 5) AND b.stage IN (1, 5) AND abs(a.slice_index - b.slice_index) <= CASE b.stage WHEN 1 THEN 1 ELSE 3 END", S)
def slice_groups_of_stage(spark, sf):
    return spatial.slice_groups(rasters.slices(spark, sf), [1, 5])
