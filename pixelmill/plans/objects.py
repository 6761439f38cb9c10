"""Registered queries that find objects: active contours, spectral classes of shapes, centre candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pixelmill.operators import boundary, candidates, contours, features, ml, review, spectral
from pixelmill.plans.catalog import _px, query
from pixelmill.session import checkpoint_folder
from pixelmill.sources import rasters
from pixelmill.sources.rasters import P, R


@query()
def active_contours(spark, sf):
    """Contours that start as disks at the centroids of the classes and part dark from bright."""
    px = _px(spark, sf).select("img", "y", "x", "c1", "annot")
    centres = px.where("annot > 0").groupBy("img", F.col("annot").alias("idx")).agg(F.avg("y").alias("y"), F.avg("x").alias("x"))
    return contours.active_contours(contours.disk_starts(px, centres, 15), "c1", "start").select("img", "y", "x", "start", "contour", "rounds", "settled")


@query()
def spectral_clusters(spark, sf):
    return spectral.cluster(rasters.features(spark, sf).select("vec_id", "features"), 4).select("vec_id", "cluster")


@query()
def spectral_shapes(spark, sf):
    """How far superpixel-sized objects reach, by spectral classes of their ray vectors."""
    px = _px(spark, sf).withColumn("object", F.when(F.col("annot") > 0, F.col("lb") + 1).otherwise(0))
    return boundary.shape_models(boundary.object_shapes(px, "object", 30), "spectral", 3, 20)


_OWN = "o AS (SELECT img, y, x, CASE WHEN annot > 0 THEN lb + 1 ELSE 0 END AS ob FROM r)"
#: Depths of all pixels of objects; q is any pixel next to or in the object's box, which holds the nearest one that isn't the object's.
_DEEP = """bx AS (SELECT img, ob, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1, sum(y) / count(*) AS cy, sum(x) / count(*) AS cx, max(y) - min(y) AS hy FROM o WHERE ob > 0 GROUP BY img, ob),
fr AS (SELECT bx.img, bx.ob, o.y, o.x, o.ob = bx.ob AS own FROM bx JOIN o ON o.img = bx.img AND o.y BETWEEN y0 AND y1 AND o.x BETWEEN x0 AND x1),
di AS (SELECT p.img, p.ob, p.y, p.x, CAST(min((p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x)) AS DOUBLE) AS d2 FROM fr p JOIN fr q ON p.img = q.img AND p.ob = q.ob WHERE p.own AND NOT q.own GROUP BY ALL),
dp AS (SELECT img, ob, y, x, sqrt(d2) / sqrt(max(d2) OVER (PARTITION BY img, ob)) AS depth, sum(y - y0) OVER (PARTITION BY img, ob) / count(*) OVER (PARTITION BY img, ob) + y0 AS cy, sum(x - x0) OVER (PARTITION BY img, ob) / count(*) OVER (PARTITION BY img, ob) + x0 AS cx FROM di JOIN bx USING (img, ob))"""
_REGION = """a{k} AS (SELECT img, ob, floor(sqrt(count(*) / pi())) AS r FROM dp WHERE depth > {v} GROUP BY img, ob),
m{k} AS (SELECT img, ob, y, x FROM dp JOIN a{k} USING (img, ob) WHERE depth > {v} AND (y - dp.cy) * (y - dp.cy) + (x - dp.cx) * (x - dp.cx) < r * r),
e{k} AS (SELECT m.* FROM m{k} m JOIN a{k} USING (img, ob) WHERE NOT EXISTS (SELECT 1 FROM fr f LEFT JOIN m{k} n ON f.img = n.img AND f.ob = n.ob AND f.y = n.y AND f.x = n.x
  WHERE n.y IS NULL AND f.img = m.img AND f.ob = m.ob AND (f.y - m.y) * (f.y - m.y) + (f.x - m.x) * (f.x - m.x) <= floor(r * 0.15) * floor(r * 0.15))),
g{k} AS (SELECT DISTINCT f.img, f.y, f.x, {k} AS level FROM fr f JOIN e{k} e ON f.img = e.img AND f.ob = e.ob JOIN a{k} a ON a.img = e.img AND a.ob = e.ob
  WHERE (f.y - e.y) * (f.y - e.y) + (f.x - e.x) * (f.x - e.x) <= floor(r * 0.15) * floor(r * 0.15))"""


def _objects(spark, sf, *more):
    return _px(spark, sf).select("img", "y", "x", F.when(F.col("annot") > 0, F.col("lb") + 1).otherwise(0).alias("ob"), "annot", *more)


@query(
    "SELECT o.img, o.y, o.x, ob, coalesce(max(level), 0) AS level FROM o LEFT JOIN (SELECT img, y, x, 1 AS level FROM dp WHERE depth > 0 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3) l ON o.img = l.img AND o.y = l.y AND o.x = l.x GROUP BY o.img, o.y, o.x, ob",
    R, _OWN, _DEEP, _REGION.format(k=2, v=0.4), _REGION.format(k=3, v=0.8))
def center_levels(spark, sf):
    """Nested regions around the centres of objects: superpixels without their background."""
    return candidates.center_levels(_objects(spark, sf), "ob").select("img", "y", "x", "ob", "level")


def _candidates(spark, sf):
    """Superpixel centres with their features, and whether they lie in the inner regions of the objects."""
    checkpoint_folder(spark)
    px = _objects(spark, sf, "lb").checkpoint()
    sp = features.centroids(px, "lb")
    px = px.drop("lb")
    points = sp.select("img", F.col("lb").alias("idx"), *[F.floor(f"c_{c}").cast("int").alias(c) for c in ("y", "x")]).checkpoint()
    made = candidates.point_features(px, "annot", points, [0, 1, 2], (3, 6, 12), 30, (("up", (0,)),))
    return px, candidates.label_close_points(made, regions=candidates.center_levels(px, "ob"))


@query()
def candidate_features(spark, sf):
    rows = _candidates(spark, sf)[1]
    return rows.select("img", "idx", "label", F.posexplode("features").alias("k", "v"))


@query()
def candidate_centers(spark, sf):
    """Centres found end to end: learned from the inner regions, predicted for all candidates, clustered and held against the objects' centroids."""
    px, rows = _candidates(spark, sf)
    rows = rows.withColumn("label", (F.col("label") >= 2).cast("int")).checkpoint()
    found, centres = candidates.detect(ml.train(rows, "random forest"), rows.drop("label"), 5.0)
    truth = px.where("ob > 0").groupBy("img", F.col("ob").alias("idx")).agg(F.avg("y").alias("y"), F.avg("x").alias("x"))
    return candidates.evaluate(centres, truth, 10.0)


@query(
    """SELECT p.img, idx, CAST(p.y AS DOUBLE) AS y, CAST(p.x AS DOUBLE) AS x, CAST(coalesce(v, 0) > 0 AS INT) AS label, CAST(coalesce(v, 0) <= 0 AS INT) AS change FROM pts p LEFT JOIN t ON p.img = t.img AND p.y = t.y AND p.x = t.x
    UNION ALL SELECT m.img, coalesce(n.last, 0) + row_number() OVER (PARTITION BY m.img ORDER BY v), m.y, m.x, 1, 1
    FROM (SELECT img, v, sum(y) / count(*) AS y, sum(x) / count(*) AS x FROM t WHERE v > 0 AND (img, v) NOT IN (SELECT (t.img, v) FROM pts JOIN t USING (img, y, x)) GROUP BY img, v) m LEFT JOIN (SELECT img, max(idx) AS last FROM pts GROUP BY img) n USING (img)""",
    R, P, "t AS (SELECT img, y, x, CASE WHEN annot = 1 THEN y * 2 + x // 50 + 1 ELSE 0 END AS v FROM r)")
def reviewed_points(spark, sf):
    """Points off the objects (halves of rows of one class) set to 0, and a point added for each object that has none."""
    px = _px(spark, sf).select("img", "y", "x", F.when(F.col("annot") == 1, F.col("y") * 2 + F.floor(F.col("x") / 50) + 1).otherwise(0).cast("int").alias("v"))
    return review.add_missed_objects(review.clear_false_positives(rasters.points(spark, sf).withColumn("label", F.lit(1)), px, "v"), px, "v")


_SCORED = """sg AS (SELECT img, 'bright' AS method, annot AS t, CASE WHEN c1 > 60 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS p FROM r
  UNION ALL SELECT img, 'left', annot, coalesce(lag(annot) OVER (PARTITION BY img, y ORDER BY x), 0) FROM r),
cf AS (SELECT img, method, t, p, count(*) AS n FROM sg GROUP BY ALL),
ft AS (SELECT img, method, t, sum(n) AS n, coalesce(sum(n) FILTER (t = p), 0) AS i FROM cf GROUP BY img, method, t),
fp AS (SELECT img, method, p, sum(n) AS n FROM cf GROUP BY img, method, p),
jc AS (SELECT ft.img, ft.method, t, ft.n AS support, i, i / (ft.n + coalesce(fp.n, 0) - i) AS j, min(t) OVER (PARTITION BY ft.img, ft.method) AS least FROM ft LEFT JOIN fp ON ft.img = fp.img AND ft.method = fp.method AND t = p),
rd AS (SELECT img, method, sum(n * (n - 1) / 2) AS s, sum(n) AS m FROM cf GROUP BY img, method),
ra AS (SELECT img, method, sum(n * (n - 1) / 2) AS a FROM ft GROUP BY img, method),
rb AS (SELECT img, method, sum(n * (n - 1) / 2) AS b FROM fp GROUP BY img, method)"""


@query(
    """SELECT img, method, CASE WHEN (a + b) / 2 = a * b / (m * (m - 1) / 2) THEN 1 ELSE (s - a * b / (m * (m - 1) / 2)) / ((a + b) / 2 - a * b / (m * (m - 1) / 2)) END AS ars, jaccard, accuracy
    FROM rd JOIN ra USING (img, method) JOIN rb USING (img, method) JOIN (SELECT img, method, coalesce(avg(j) FILTER (t <> least), 0) AS jaccard, sum(i) / sum(support) AS accuracy FROM jc GROUP BY img, method) USING (img, method)""",
    R, _SCORED)
def method_scores(spark, sf):
    """Two ways to guess the classes, by brightness and from the pixel on the left, scored an image."""
    px = _px(spark, sf)
    bright = px.select("img", F.lit("bright").alias("method"), "y", "x", "annot", F.when(F.col("c1") > 60, 2).when(F.col("c1") > 0, 1).otherwise(0).alias("found"))
    left = px.select("img", F.lit("left").alias("method"), "y", "x", "annot", F.coalesce(F.lag("annot").over(Window.partitionBy("img", "y").orderBy("x")), F.lit(0)).alias("found"))
    return review.method_scores(bright.union(left), "annot", "found", relabel=False)


@query(
    "SELECT img, lb, cls, round(-ln(CASE WHEN cls = 0 THEN 1 - p ELSE p END + 1e-9), 9) AS cost FROM s, range(4) c(cls)", R,
    "s AS (SELECT img, lb, sum(CAST(annot > 0 AS INT)) / count(*) AS p FROM r GROUP BY img, lb)")
def centre_costs(spark, sf):
    """Costs of superpixels to belong to one of three objects, or none, by their share of foreground."""
    px = _px(spark, sf)
    segments = px.groupBy("img", "lb").agg((F.sum((F.col("annot") > 0).cast("int")) / F.count("*")).alias("proba")).withColumn("label", F.lit(0))
    centres = px.groupBy("img", (F.col("annot") + 1).cast("long").alias("label")).agg(F.avg("y").alias("y"), F.avg("x").alias("x"))
    return review.centre_costs(segments, px, centres)[0].withColumn("cost", F.round("cost", 9))
