"""Registered queries that part images: minimum cuts, watersheds, and what is built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelmill.operators import bayes, ensembles, features, graph, labels, maxflow, neighbours, segmentation, watershed
from pixelmill.plans.catalog import CHANNELS, _px, query
from pixelmill.session import checkpoint_folder
from pixelmill.sources import rasters
from pixelmill.sources.rasters import R

#: Costs of superpixels to be dark (0) or bright (1), and of borders where the classes on both sides agree; all whole numbers.
_U = """mean AS (SELECT img, CAST(sum(c1) // count(*) AS BIGINT) AS t FROM r GROUP BY img),
u AS (SELECT img, lb, CAST(sum(greatest(c1 - t, 0)) AS BIGINT) AS u0, CAST(sum(greatest(t - c1, 0)) AS BIGINT) AS u1 FROM r JOIN mean USING (img) GROUP BY img, lb),
w AS (SELECT img, a, b, 40 * count(*) AS w FROM (
    SELECT img, lb AS a, annot AS p, lead(lb) OVER h AS b, lead(annot) OVER h AS q FROM r WINDOW h AS (PARTITION BY img, y ORDER BY x)
    UNION ALL SELECT img, lb, annot, lead(lb) OVER v, lead(annot) OVER v FROM r WINDOW v AS (PARTITION BY img, x ORDER BY y)) WHERE a <> b AND p = q GROUP BY img, a, b)"""


def _dark_and_bright(spark, sf):
    """Unary costs (img, lb, cls, cost) and edges (img, src, dst, w) of the superpixels."""
    px = _px(spark, sf)
    t = px.groupBy("img").agg(F.expr("CAST(sum(c1) div count(*) AS LONG)").alias("t"))
    sums = px.join(t, "img").groupBy("img", "lb").agg(F.sum(F.greatest(F.col("c1") - F.col("t"), F.lit(0))).alias("u0"), F.sum(F.greatest(F.col("t") - F.col("c1"), F.lit(0))).alias("u1"))
    unary = sums.select("img", "lb", F.posexplode(F.array("u0", "u1")).alias("cls", "cost")).withColumn("cost", F.col("cost").cast("double"))
    pairs = watershed.pixel_edges(px.withColumn("v", F.struct("lb", "annot")), "v").where("v_a.lb <> v_b.lb AND v_a.annot = v_b.annot")
    edges = pairs.groupBy("img", F.col("v_a.lb").alias("src"), F.col("v_b.lb").alias("dst")).agg((40.0 * F.count("*")).alias("w"))
    return unary, edges


@query(
    "SELECT img, CAST(min(cost) AS DOUBLE) AS energy FROM dp WHERE i = 99 GROUP BY img", R, _U,
    """cell AS (SELECT u.img, u.lb AS i, u0, u1, coalesce(l.w, 0) AS wl, coalesce(t.w, 0) AS wu FROM u
      LEFT JOIN w l ON l.img = u.img AND l.b = u.lb AND l.a = u.lb - 1 LEFT JOIN w t ON t.img = u.img AND t.b = u.lb AND t.a = u.lb - 10)""",
    # row by row through the 10 x 10 superpixels; the state holds the classes of the last ten
    """dp(img, i, m, cost) AS (SELECT DISTINCT img, -1, 0, 0::BIGINT FROM u
      UNION ALL SELECT d.img, d.i + 1, ((d.m << 1) | z.range) & 1023,
        CAST(min(d.cost + CASE z.range WHEN 0 THEN u0 ELSE u1 END + CASE WHEN d.m & 1 <> z.range THEN wl ELSE 0 END + CASE WHEN (d.m >> 9) & 1 <> z.range THEN wu ELSE 0 END) AS BIGINT)
      FROM dp d JOIN cell c ON c.img = d.img AND c.i = d.i + 1, range(2) z GROUP BY d.img, d.i, ((d.m << 1) | z.range) & 1023)""")
def cut_energy(spark, sf):
    """The energy of the minimum cut of each image's superpixels in two classes; the twin tries all classes of a row of superpixels after the other."""
    unary, edges = _dark_and_bright(spark, sf)
    matrix = graph.pairwise_matrix(2, 1.0)
    return graph.energy(unary, edges, maxflow.graph_cut(unary, edges, matrix), matrix)


@query(
    "SELECT img, y, x, coalesce(label, 0) AS basin FROM r LEFT JOIN lab ON lab.id = r.img * 10000 + r.y * 100 + r.x", R,
    "m AS (SELECT img, img * 10000 + y * 100 + x AS id, y, x, lb, c1 FROM r WHERE annot > 0)",
    "seed AS (SELECT id, lb + 1 AS label FROM (SELECT *, row_number() OVER (PARTITION BY img, lb ORDER BY c1 DESC, y, x) AS k FROM m) WHERE k = 1)",
    """e AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.img ORDER BY greatest(-a.c1, -b.c1), a.id, b.id) AS rk
      FROM m a JOIN m b ON a.img = b.img AND ((a.y = b.y AND b.x = a.x + 1) OR (a.x = b.x AND b.y = a.y + 1))),
    f AS (SELECT a AS s, b AS t, rk FROM e UNION ALL SELECT b, a, rk FROM e)""",
    """low(id, rk) USING KEY (id) AS (SELECT m.id, CASE WHEN seed.id IS NULL THEN 1000000000 ELSE 0 END FROM m LEFT JOIN seed ON seed.id = m.id
      UNION SELECT f.t, min(greatest(n.rk, f.rk)) FROM low n JOIN f ON f.s = n.id JOIN recurring.low q ON q.id = f.t WHERE greatest(n.rk, f.rk) < q.rk GROUP BY f.t)""",
    """up AS (SELECT p.id, CASE WHEN x.rk < z.rk THEN e.a ELSE e.b END AS v FROM low p JOIN e ON e.rk = p.rk AND e.a // 10000 = p.id // 10000 JOIN low x ON x.id = e.a JOIN low z ON z.id = e.b WHERE p.rk > 0 AND p.rk < 1000000000)""",
    "lab(id, label) AS (SELECT id, label FROM seed UNION ALL SELECT up.id, lab.label FROM lab JOIN up ON up.v = lab.id)")
def watershed_basins(spark, sf):
    """Basins of dark valleys between the brightest pixel of each superpixel, over pixels of a class above 0."""
    px = _px(spark, sf).withColumns({"h": -F.col("c1"), "m": (F.col("annot") > 0).cast("int")})
    best = px.where("m = 1").groupBy("img", "lb").agg(F.max_by(F.struct("y", "x"), F.struct("c1", -F.col("y"), -F.col("x"))).alias("s"))
    seeds = best.select("img", "s.y", "s.x", (F.col("lb") + 1).alias("label"))
    return watershed.watershed(px, "h", seeds, "m").select("img", "y", "x", "basin")


def _bright(spark, sf):
    """Rasters with ``m``, 1 where the mean of the pixels around is above the image's, and the brightest pixels of 16 fields as centres."""
    px = _px(spark, sf)
    t = px.groupBy("img").agg(F.avg("c1").alias("t"))
    box = [(dy, dx, 1 / 49) for dy in range(-3, 4) for dx in range(-3, 4)]
    checkpoint_folder(spark)
    smooth = segmentation.filter_response(px, "c1", box, "s").checkpoint().join(t, "img").withColumn("m", (F.col("s") > F.col("t")).cast("int"))
    best = smooth.where("m = 1").groupBy("img", F.floor(F.col("y") / 25).alias("fy"), F.floor(F.col("x") / 25).alias("fx")).agg(F.max_by(F.struct("y", "x"), F.struct("s", -F.col("y"), -F.col("x"))).alias("p"))
    return smooth, best.select("img", (F.col("fy") * 4 + F.col("fx")).alias("idx"), "p.y", "p.x")


@query()
def object_pixels(spark, sf):
    """Bright regions parted among centres by a graph cut over pixels."""
    px, centres = _bright(spark, sf)
    return segmentation.object_pixels(px, "m", centres, (0.1, 0.9), 0.5, 3, 0.2, (12.0, 4.0))


@query()
def object_watershed(spark, sf):
    """Bright regions parted among centres by the watershed of their depth."""
    px, centres = _bright(spark, sf)
    return watershed.object_watershed(px, "m", centres)


@query("""SELECT id, label AS prediction, votes FROM (SELECT id, b.label, count(*) AS votes, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, b.label) AS p FROM
  (SELECT a.vec_id AS id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS k FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE b.label IS NOT NULL) b
  WHERE k <= 5 GROUP BY id, b.label) WHERE p = 1""", "v AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS v FROM embeddings)")
def nearest_labels(spark, sf):
    """The label of most of the five nearest other vectors."""
    f = rasters.features(spark, sf).withColumnRenamed("vec_id", "id")
    return neighbours.classify(f, f, 5, among=True)


@query(
    "SELECT img, y, x, CAST(max(label) AS INT) AS label FROM m JOIN (SELECT img, unnest(drawn) AS idx, generate_subscripts(drawn, 1) AS label FROM st WHERE step = 24) USING (img, idx) GROUP BY img, y, x", R,
    "q AS (SELECT img, CAST(y // 20 * 5 + x // 20 AS INT) AS f, y, x FROM r WHERE c1 > 150)",
    "box AS (SELECT img, f, min(y) AS y0, max(y) AS y1, min(x) - 4 AS x0, max(x) - f % 3 * 4 AS x1 FROM q GROUP BY img, f)",
    "m AS (SELECT box.img, f AS idx, y, x FROM box JOIN r ON r.img = box.img AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1)",
    "w AS (SELECT img, g, count(*) AS n FROM (SELECT img, y, x, list_sort(list(idx)) AS g FROM m GROUP BY ALL) GROUP BY img, g)",
    "size AS (SELECT img, idx, count(*) AS n FROM m GROUP BY img, idx)",
    # field after field: the fields drawn so far, and of each way masks overlap the last of them
    """st(img, step, drawn) AS (SELECT DISTINCT img, -1, []::INT[] FROM m UNION ALL
      SELECT s.img, s.step + 1, CASE WHEN any_value(z.n) IS NULL OR coalesce(bool_or(t.both > 0.25 * (t.seen + z.n - t.both)), FALSE) THEN any_value(s.drawn) ELSE list_append(any_value(s.drawn), CAST(s.step + 1 AS INT)) END
      FROM st s LEFT JOIN size z ON z.img = s.img AND z.idx = s.step + 1
      LEFT JOIN (SELECT a.img, a.step, list_max(list_filter(w.g, lambda i: list_contains(a.drawn, i))) AS top, sum(w.n) AS seen, coalesce(sum(w.n) FILTER (list_contains(w.g, a.step + 1)), 0) AS both
        FROM st a JOIN w ON w.img = a.img GROUP BY ALL) t ON t.img = s.img AND t.step = s.step AND t.top IS NOT NULL
      WHERE s.step < 24 GROUP BY s.img, s.step)""")
def merged_masks(spark, sf):
    """Boxes around the bright pixels of 25 fields, each a little into its neighbours, drawn over one another unless a quarter is shared."""
    px = _px(spark, sf)
    field = (F.floor(F.col("y") / 20) * 5 + F.floor(F.col("x") / 20)).cast("int")
    box = px.where("c1 > 150").groupBy("img", field.alias("idx")).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), (F.min("x") - 4).alias("x0"), F.max("x").alias("x1"))
    box = box.withColumn("x1", F.col("x1") - F.col("idx") % 3 * 4).withColumn("y", F.explode(F.sequence("y0", "y1"))).where("x0 <= x1").withColumn("x", F.explode(F.sequence("x0", "x1")))
    return labels.merge_masks(box.where("x BETWEEN 0 AND 99").select("img", "idx", "y", "x"), 0.25)


@query()
def bayesian_classes(spark, sf):
    """Classes of superpixels by a mixture that chooses their number, eight at most."""
    stats = features.segment_statistics(_px(spark, sf), "lb", CHANNELS, ("mean", "std"))
    rows = stats.select("img", "lb", F.array(*[F.col(c).cast("double") for c in stats.columns if c not in ("img", "lb")]).alias("features"))
    checkpoint_folder(spark)
    rows = rows.checkpoint()
    return bayes.probabilities(bayes.fit(rows, 8), rows).select("img", "lb", "prediction", "proba")


@query()
def boosted_labels(spark, sf):
    """The labels of vectors by boosted trees."""
    f = rasters.features(spark, sf)
    return ensembles.boosted_predictions(ensembles.boost(f), f).select("vec_id", "label", "prediction", "margin")


@query()
def kernel_labels(spark, sf):
    """The labels of vectors by a support vector machine with a Gaussian kernel."""
    f = rasters.features(spark, sf).where("label IS NOT NULL")
    return ensembles.kernel_predictions(ensembles.kernel_machine(f), f).select("vec_id", "label", "prediction")


@query()
def segmented_images(spark, sf):
    """Superpixels, colour and texture features, classes and graph cut of all images in one call."""
    return segmentation.segment_images(_px(spark, sf), CHANNELS, 3, 10, 40.0, {"color": ("mean", "std"), "tLM_short": ("mean", "energy")}, 0.5).select("img", "y", "x", "sp", "label")
