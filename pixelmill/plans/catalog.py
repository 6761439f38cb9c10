"""Registered queries over the driver tables, and their SQL twins for DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.functions import color
from pixelmill.operators import datasets, features, graph, labels, metrics, ml, segmentation, spatial
from pixelmill.sources import rasters
from pixelmill.sources.rasters import P, R, S, V

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
CHANNELS = ["c1", "c2", "c3"]
PALETTE = [(0, 0, 0), (30, 5, 4), (80, 15, 12), (200, 40, 30)]


def query(sql: str | None = None, *views: str):
    """Register a query (spark, sf_dir) under its name, with DuckDB SQL over the views."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (f"WITH {'RECURSIVE ' if any('UNION' in v for v in views) else ''}{', '.join(views)} " if views else "") + sql
        return f

    return put


def _px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.pixels(spark, sf_dir)


@query(
    """SELECT img, lb, c1_mean, c1_std, CASE WHEN purity < 0.7 THEN -1 ELSE annot END AS annot, purity FROM s JOIN b USING (img, lb) WHERE k = 1""", R,
    "s AS (SELECT img, lb, sum(c1) / count(*) AS c1_mean, sqrt(CAST(count(*) * sum(c1 * c1) - sum(c1) * sum(c1) AS DOUBLE)) / count(*) AS c1_std FROM r GROUP BY img, lb)",
    "h AS (SELECT img, lb, annot, count(*) AS n FROM r GROUP BY ALL)",
    "b AS (SELECT img, lb, annot, n / sum(n) OVER (PARTITION BY img, lb) AS purity, row_number() OVER (PARTITION BY img, lb ORDER BY n DESC, annot) AS k FROM h)")
def training_set(spark, sf):
    """Each superpixel's majority class, rejected where it isn't pure, with colour statistics."""
    px = _px(spark, sf)
    stats = features.segment_statistics(px, "lb", ["c1"], ("mean", "std"))
    majority = labels.purity_filter(labels.assign_by_max(px, "lb", "annot"), "annot", 0.7)
    return stats.join(majority, ["img", "lb"])


def _statistic(name: str, expr: str):
    cols = ", ".join(f"CAST({expr.replace('#', c)} AS DOUBLE) AS {c}_{name}" for c in CHANNELS)

    def run(spark, sf):
        return features.segment_statistics(_px(spark, sf), "lb", CHANNELS, (name,))

    QUERIES[f"seg_{name}"] = run
    ORACLE[f"seg_{name}"] = f"WITH {R} SELECT img, lb, {cols} FROM r GROUP BY img, lb"

    def run3(spark, sf):
        return features.segment_statistics(rasters.volume(spark, sf), "lb", ["c1"], (name,))

    QUERIES[f"vol_{name}"] = run3
    ORACLE[f"vol_{name}"] = f"WITH {V} SELECT img, lb, CAST({expr.replace('#', 'c1')} AS DOUBLE) AS c1_{name} FROM vol GROUP BY img, lb"


for _name, _expr in (("mean", "sum(#) / count(*)"), ("std", "sqrt(CAST(count(*) * sum(# * #) - sum(#) * sum(#) AS DOUBLE)) / count(*)"), ("energy", "sum(# * #) / count(*)"), ("median", "median(#)")):
    _statistic(_name, _expr)

_GRAD = """SELECT img, lb, sum(
  CASE WHEN ya IS NULL THEN 2 * (yb - c1) WHEN yb IS NULL THEN 2 * (c1 - ya) ELSE yb - ya END
  + CASE WHEN xa IS NULL THEN 2 * (xb - c1) WHEN xb IS NULL THEN 2 * (c1 - xa) ELSE xb - xa END) / (2 * count(*)) AS c1_meanGrad FROM (
  SELECT img, lb, c1, lag(c1) OVER wy AS ya, lead(c1) OVER wy AS yb, lag(c1) OVER wx AS xa, lead(c1) OVER wx AS xb
  FROM %s WINDOW wy AS (PARTITION BY img, %s x ORDER BY y), wx AS (PARTITION BY img, %s y ORDER BY x)) GROUP BY img, lb"""


@query(_GRAD % ("r", "", ""), R)
def seg_mean_grad(spark, sf):
    return features.segment_statistics(_px(spark, sf), "lb", ["c1"], ("meanGrad",))


@query(_GRAD % ("vol", "z,", "z,"), V)
def vol_mean_grad(spark, sf):
    return features.segment_statistics(rasters.volume(spark, sf), "lb", ["c1"], ("meanGrad",))


@query("SELECT img, annot, count(*) AS n, sum(y) / count(*) AS c_y, sum(x) / count(*) AS c_x FROM r GROUP BY img, annot", R)
def seg_centroid(spark, sf):
    return features.centroids(_px(spark, sf), "annot")


@query("SELECT img, g.lb, coalesce(n, 0) AS n FROM (SELECT img, CAST(i.range AS INT) AS lb FROM (SELECT img, max(lb) AS m FROM r WHERE lb % 3 = 0 GROUP BY img), range(100) i WHERE i.range <= m) g LEFT JOIN (SELECT img, lb, count(*) AS n FROM r WHERE lb % 3 = 0 GROUP BY img, lb) c USING (img, lb)", R)
def seg_size(spark, sf):
    """Sizes with absent segments as 0, where two segments of three are unknown."""
    seg = _px(spark, sf).withColumn("lb", F.when(F.col("lb") % 3 == 0, F.col("lb")).otherwise(-1))
    n = seg.where("lb >= 0").groupBy("img", "lb").agg(F.count("*").alias("n"))
    return features.fill_segments(n, "lb", 0)


@query("SELECT img, annot AS segment, round(0.5 * atan2(2 * covar_pop(y, x), var_pop(x) - var_pop(y)), 6) AS angle FROM r GROUP BY img, annot", R)
def main_axis(spark, sf):
    px = _px(spark, sf)
    m = px.groupBy("img", F.col("annot").alias("segment")).agg(F.covar_pop("y", "x").alias("c"), F.var_pop("y").alias("a"), F.var_pop("x").alias("b"))
    return m.select("img", "segment", F.round(0.5 * F.atan2(2 * F.col("c"), F.col("b") - F.col("a")), 6).alias("angle"))


_H = "h AS (SELECT img, lb, annot, count(*) AS n FROM r GROUP BY ALL), d AS (SELECT g.img, g.lb, g.annot, coalesce(n, 0) AS n FROM (SELECT img, CAST(i.range AS INT) AS lb, CAST(j.range AS INT) AS annot FROM (SELECT DISTINCT img FROM r), range(100) i, range(3) j) g LEFT JOIN h USING (img, lb, annot))"
_BEST = "b AS (SELECT img, lb, annot, n / sum(n) OVER (PARTITION BY img, lb) AS purity, row_number() OVER (PARTITION BY img, lb ORDER BY n DESC, annot) AS k FROM h)"


@query("SELECT * FROM d", R, _H)
def hist_counts(spark, sf):
    return labels.histogram_counts(_px(spark, sf), "lb", "annot")


@query("SELECT *, n / sum(n) OVER (PARTITION BY img, lb) AS ratio FROM d", R, _H)
def hist_norm(spark, sf):
    return labels.histogram_norm(_px(spark, sf), "lb", "annot")


@query("SELECT img, lb, annot, purity FROM b WHERE k = 1", R, _H, _BEST)
def assign_max(spark, sf):
    return labels.assign_by_max(_px(spark, sf), "lb", "annot")


@query("SELECT img, lb, CASE WHEN purity > 0.75 THEN annot ELSE -1 END AS annot, purity FROM b WHERE k = 1", R, _H, _BEST)
def assign_threshold(spark, sf):
    return labels.assign_by_threshold(_px(spark, sf), "lb", "annot")


def _two(spark, sf):
    """Two segmentations: classes by region and noise, and by coarse blocks."""
    return _px(spark, sf).withColumn("est", (F.floor(F.col("y") / 34) * 3 + F.floor(F.col("x") / 34)).cast("int"))


_TWO = "t AS (SELECT *, CAST((y // 34) * 3 + x // 34 AS INT) AS est FROM r)"


@query("SELECT img, annot, est, count(*) AS n FROM t GROUP BY ALL", R, _TWO)
def overlap_matrix(spark, sf):
    return labels.overlap_matrix(_two(spark, sf), "annot", "est")


@query("SELECT img, y, x, new FROM t JOIN (SELECT img, est, annot AS new, row_number() OVER (PARTITION BY img, est ORDER BY count(*) DESC, annot) AS k FROM t GROUP BY img, est, annot) USING (img, est) WHERE k = 1", R, _TWO)
def relabel_merge(spark, sf):
    return labels.relabel_merge(_two(spark, sf), "annot", "est").select("img", "y", "x", "new")


@query()
def relabel_unique(spark, sf):
    return labels.relabel_unique(_two(spark, sf), "annot", "est").select("img", "y", "x", "new")


@query("SELECT img, y, x, CASE annot WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS annot FROM r", R)
def relabel_dict(spark, sf):
    return labels.relabel_by_table(_px(spark, sf), "annot", {2: [1], 1: [2]}).select("img", "y", "x", "annot")


@query("SELECT img, y, x, annot IN (0, 2) OR c1 > 100 AS m FROM r", R)
def mask_labels(spark, sf):
    return _px(spark, sf).select("img", "y", "x", labels.mask_labels("annot", [0, 2], F.col("c1") > 100).alias("m"))


@query("SELECT img, y, x, CAST(CASE WHEN count(DISTINCT l) = 1 THEN max(l) ELSE -1 END AS INT) AS label FROM (SELECT img, y, x, nullif(CASE WHEN s.range = 0 THEN annot WHEN c1 > 20 THEN annot ELSE (annot + 1) % 3 END, 0) AS l FROM r, range(2) s) GROUP BY img, y, x", R)
def sequence_merge(spark, sf):
    px = _px(spark, sf)
    other = px.withColumn("annot", F.when(F.col("c1") > 20, F.col("annot")).otherwise((F.col("annot") + 1) % 3))
    return labels.sequence_merge(px.unionByName(other), "annot", [0])


@query("SELECT img, y, x, CAST(annot = 1 AND ya IS NOT NULL AND yb IS NOT NULL AND xa IS NOT NULL AND xb IS NOT NULL AND (ya <> 1 OR yb <> 1 OR xa <> 1 OR xb <> 1) AS INT) AS contour FROM n", R, "n AS (SELECT *, lag(annot) OVER wy AS ya, lead(annot) OVER wy AS yb, lag(annot) OVER wx AS xa, lead(annot) OVER wx AS xb FROM r WINDOW wy AS (PARTITION BY img, x ORDER BY y), wx AS (PARTITION BY img, y ORDER BY x))")
def contour_map(spark, sf):
    return labels.contour(_px(spark, sf), "annot", 1).select("img", "y", "x", "contour")


@query(
    "SELECT img, y, x, sqrt(CAST(min((y - my) * (y - my) + (x - mx) * (x - mx)) AS DOUBLE)) AS distance FROM r JOIN k USING (img) GROUP BY img, y, x", R,
    "n AS (SELECT *, lag(annot) OVER wy AS ya, lead(annot) OVER wy AS yb, lag(annot) OVER wx AS xa, lead(annot) OVER wx AS xb FROM r WINDOW wy AS (PARTITION BY img, x ORDER BY y), wx AS (PARTITION BY img, y ORDER BY x))",
    "k AS (SELECT img, y AS my, x AS mx FROM n WHERE annot = 1 AND ya IS NOT NULL AND yb IS NOT NULL AND xa IS NOT NULL AND xb IS NOT NULL AND (ya <> 1 OR yb <> 1 OR xa <> 1 OR xb <> 1))")
def distance_map(spark, sf):
    """Distance to the contour of a class."""
    px = labels.contour(_px(spark, sf), "annot", 1)
    return labels.distance_to(px, "contour").select("img", "y", "x", F.sqrt(F.col("d2").cast("double")).alias("distance"))


_THICK = "w AS (SELECT *, lag(e) OVER wy AS a1, lead(e) OVER wy AS a2, lag(e) OVER wx AS a3, lead(e) OVER wx AS a4, lag(lb) OVER wy AS b1, lead(lb) OVER wy AS b2, lag(lb) OVER wx AS b3, lead(lb) OVER wx AS b4 FROM (SELECT *, CAST((y // 34) * 3 + x // 34 AS INT) AS e FROM r) WINDOW wy AS (PARTITION BY img, x ORDER BY y), wx AS (PARTITION BY img, y ORDER BY x)), f AS (SELECT img, y, x, coalesce(a1 <> e, false) OR coalesce(a2 <> e, false) OR coalesce(a3 <> e, false) OR coalesce(a4 <> e, false) AS er, coalesce(b1 <> lb, false) OR coalesce(b2 <> lb, false) OR coalesce(b3 <> lb, false) OR coalesce(b4 <> lb, false) AS lr FROM w)"


@query("SELECT a.img, a.y, a.x, sqrt(CAST(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS DOUBLE)) AS distance FROM f a JOIN f b ON a.img = b.img WHERE a.er AND b.lr GROUP BY ALL", R, _THICK)
def boundary_distance(spark, sf):
    return labels.boundary_distance(_two(spark, sf), "est", "lb")


@query("SELECT img, annot FROM (SELECT img, annot, row_number() OVER (PARTITION BY img ORDER BY sum(CAST(y < 1 AS INT) + CAST(x < 1 AS INT) + CAST(y > 98 AS INT) + CAST(x > 98 AS INT)) DESC, annot) AS k FROM r GROUP BY img, annot) WHERE k = 1", R)
def boundary_mode(spark, sf):
    return labels.border_mode(_px(spark, sf), "annot")


@query("SELECT img, y, x, CAST(CASE WHEN cls = 0 THEN 1 ELSE 0 END AS INT) AS cls, sum(p) AS p FROM (SELECT img, y, x, 0 AS cls, c1 / 2.0 AS p FROM r UNION ALL SELECT img, y, x, 1, c2 / 4.0 FROM r UNION ALL SELECT img, y, x, 2, c3 / 4.0 FROM r) GROUP BY ALL", R)
def merge_proba(spark, sf):
    px = _px(spark, sf)
    p = F.array(*[F.struct(F.lit(k).alias("cls"), (F.col(c) / d).alias("p")) for k, (c, d) in enumerate((("c1", 2), ("c2", 4), ("c3", 4)))])
    return labels.merge_probabilities(px.select("img", "y", "x", F.explode(p).alias("s")).select("img", "y", "x", "s.*"), {0: [1, 2], 1: [0]})


@query("SELECT img, y, x, CASE WHEN hi > lo THEN (c1 - lo) / (hi - lo) ELSE 0 END AS c1 FROM r JOIN (SELECT img, min(c1) AS lo, max(c1) AS hi FROM r GROUP BY img) USING (img)", R)
def scale_range(spark, sf):
    return color.scale_range(_px(spark, sf), "c1").select("img", "y", "x", "c1")


@query("SELECT img, y, x, round(CASE WHEN hi > lo THEN (least(greatest(CAST(c1 AS DOUBLE), lo), hi) - lo) / (hi - lo) ELSE 0 END, 9) AS c1 FROM r JOIN (SELECT img, quantile_cont(c1, 0.02) AS lo, quantile_cont(c1, 0.98) AS hi FROM r GROUP BY img) USING (img)", R)
def scale_quantile(spark, sf):
    return color.scale_quantiles(_px(spark, sf), "c1").select("img", "y", "x", F.round("c1", 9).alias("c1"))


@query("SELECT DISTINCT img, c1, c2, c3 FROM r", R)
def distinct_colors(spark, sf):
    return color.distinct_colors(_px(spark, sf), CHANNELS)


@query("SELECT c2, c3, CAST(sum(n) AS BIGINT) AS n FROM (SELECT img, c2, c3, count(*) AS n, sum(count(*)) OVER (PARTITION BY img) AS t FROM r GROUP BY img, c2, c3) WHERE n >= 0.002 * t GROUP BY ALL", R)
def frequent_colors(spark, sf):
    return color.frequent_colors(_px(spark, sf), ["c2", "c3"], 0.002)


@query("SELECT img, y, x, coalesce(label, -1) AS label FROM r LEFT JOIN (VALUES (0, 0, 10), (5, 4, 11), (3, 2, 12)) p(c2, c3, label) USING (c2, c3)", R)
def colors_to_labels(spark, sf):
    palette = spark.createDataFrame([(0, 0, 10), (5, 4, 11), (3, 2, 12)], "c2 long, c3 long, label int")
    return color.colors_to_labels(_px(spark, sf), palette, ["c2", "c3"]).select("img", "y", "x", "label")


@query("SELECT img, y, x, red, green FROM r JOIN (VALUES (0, 0, 255), (1, 255, 0), (2, 40, 50)) p(annot, red, green) USING (annot)", R)
def labels_to_colors(spark, sf):
    palette = spark.createDataFrame([(0, 0, 255), (1, 255, 0), (2, 40, 50)], "label int, red int, green int")
    return color.labels_to_colors(_px(spark, sf), "annot", palette, ["red", "green"]).select("img", "y", "x", "red", "green")


_D = ", ".join(f"abs(c1 - {a}) + abs(c2 - {b}) + abs(c3 - {c}) AS d{k}" for k, (a, b, c) in enumerate(PALETTE))


@query(f"SELECT img, y, x, CAST(CASE WHEN d0 <= d1 AND d0 <= d2 AND d0 <= d3 THEN 0 WHEN d1 <= d2 AND d1 <= d3 THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END AS INT) AS label FROM (SELECT *, {_D} FROM r)", R)
def nearest_color(spark, sf):
    return color.nearest_color(_px(spark, sf), PALETTE, CHANNELS).select("img", "y", "x", "label")


_E = "e AS (SELECT DISTINCT img, least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT img, lb AS a, lead(lb) OVER (PARTITION BY img, y ORDER BY x) AS b FROM r UNION ALL SELECT img, lb, lead(lb) OVER (PARTITION BY img, x ORDER BY y) FROM r) WHERE a <> b)"
_C = "c AS (SELECT img, lb, sum(y) / count(*) AS cy, sum(x) / count(*) AS cx FROM r GROUP BY img, lb)"
_F = "f AS (SELECT img, lb, sum(c1) / count(*) / 100 AS p0, sum(c2) / count(*) / 20 AS p1, sum(c3) / count(*) / 20 AS p2 FROM r GROUP BY img, lb)"
_J = "j AS (SELECT e.img, src, dst, abs(a.p0 - b.p0) + abs(a.p1 - b.p1) + abs(a.p2 - b.p2) AS l1, sqrt(((a.p0 - b.p0) * (a.p0 - b.p0) + (a.p1 - b.p1) * (a.p1 - b.p1)) + (a.p2 - b.p2) * (a.p2 - b.p2)) AS l2, greatest((a.p0 - b.p0) * (a.p0 - b.p0), (a.p1 - b.p1) * (a.p1 - b.p1), (a.p2 - b.p2) * (a.p2 - b.p2)) AS lT FROM e JOIN f a ON e.img = a.img AND e.src = a.lb JOIN f b ON e.img = b.img AND e.dst = b.lb)"


def _edges(spark, sf):
    return graph.adjacency(_px(spark, sf), "lb")


def _proba(spark, sf):
    m = features.segment_statistics(_px(spark, sf), "lb", CHANNELS, ("mean",))
    return m.select("img", "lb", F.array(F.col("c1_mean") / 100, F.col("c2_mean") / 20, F.col("c3_mean") / 20).alias("proba"))


@query("SELECT * FROM e", R, _E)
def adjacency_2d(spark, sf):
    return _edges(spark, sf)


@query("SELECT DISTINCT img, least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT img, lb AS a, lead(lb) OVER (PARTITION BY img, z, y ORDER BY x) AS b FROM vol UNION ALL SELECT img, lb, lead(lb) OVER (PARTITION BY img, z, x ORDER BY y) FROM vol UNION ALL SELECT img, lb, lead(lb) OVER (PARTITION BY img, y, x ORDER BY z) FROM vol) WHERE a <> b", V)
def adjacency_3d(spark, sf):
    return graph.adjacency(rasters.volume(spark, sf), "lb", ("z", "y", "x"))


@query("SELECT img, src AS segment, dst AS neighbour FROM e UNION SELECT img, dst, src FROM e", R, _E)
def neighbours(spark, sf):
    return graph.neighbour_lists(_edges(spark, sf)).select("img", "segment", F.explode("neighbours").alias("neighbour"))


@query("SELECT e.img, src, dst, sqrt((a.cy - b.cy) * (a.cy - b.cy) + (a.cx - b.cx) * (a.cx - b.cx)) AS distance FROM e JOIN c a ON e.img = a.img AND src = a.lb JOIN c b ON e.img = b.img AND dst = b.lb", R, _E, _C)
def spatial_dist(spark, sf):
    return graph.spatial_distance(_edges(spark, sf), features.centroids(_px(spark, sf), "lb"), "lb")


def _weights(kind: str, column: str):
    def run(spark, sf):
        w = graph.edge_weights(_edges(spark, sf), kind, _proba(spark, sf))
        return w.select("img", "src", "dst", F.round("w", 7).alias("w"))

    QUERIES[f"edge_{kind[6:].lower()}"] = run
    ORACLE[f"edge_{kind[6:].lower()}"] = f"WITH {R}, {_E}, {_F}, {_J} SELECT img, src, dst, round(greatest(least(CASE WHEN v > 0 THEN exp(-d / (2 * v)) ELSE 1 END, 1000), 0.001), 7) AS w FROM (SELECT img, src, dst, {column} AS d, var_pop({column}) OVER (PARTITION BY img) AS v FROM j)"


for _kind, _col in (("model_l1", "l1"), ("model_l2", "l2"), ("model_lT", "lT")):
    _weights(_kind, _col)

_T = "m AS (SELECT img, lb, annot FROM (SELECT img, lb, annot, row_number() OVER (PARTITION BY img, lb ORDER BY count(*) DESC, annot) AS k FROM r GROUP BY img, lb, annot) WHERE k = 1), q AS (SELECT a.annot AS l1, b.annot AS l2 FROM e JOIN m a ON e.img = a.img AND src = a.lb JOIN m b ON e.img = b.img AND dst = b.lb), tr AS (SELECT l1, l2, count(*) / CASE WHEN l1 = l2 THEN 2 ELSE 1 END AS n FROM (SELECT l1, l2 FROM q UNION ALL SELECT l2, l1 FROM q) GROUP BY l1, l2)"


def _transitions(spark, sf):
    return graph.transitions(_edges(spark, sf), labels.assign_by_max(_px(spark, sf), "lb", "annot"), "lb", "annot")


@query("SELECT * FROM tr", R, _E, _T)
def transitions(spark, sf):
    return _transitions(spark, sf)


@query("SELECT l1, l2, round(ln(1 / greatest(s.r, t.r, 1e-9)), 9) AS cost FROM g s JOIN (SELECT l1 AS l2, l2 AS l1, r FROM g) t USING (l1, l2)", R, _E, _T, "g AS (SELECT a.l1, b.l1 AS l2, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY b.l1) AS r FROM (SELECT DISTINCT l1 FROM tr) a CROSS JOIN (SELECT DISTINCT l1 FROM tr) b LEFT JOIN tr ON tr.l1 = a.l1 AND tr.l2 = b.l1)")
def pairwise_cost(spark, sf):
    return graph.pairwise_from_transitions(_transitions(spark, sf)).withColumn("cost", F.round("cost", 9))


@query("SELECT img, lb, annot AS cls, round(abs(-ln(greatest(least(n / t, 0.99), 0.01))), 9) AS cost FROM (SELECT *, sum(n) OVER (PARTITION BY img, lb) AS t FROM d)", R, _H)
def unary_cost(spark, sf):
    h = labels.histogram_norm(_px(spark, sf), "lb", "annot")
    return h.select("img", "lb", F.col("annot").alias("cls"), F.round(graph.unary_cost(F.col("ratio")), 9).alias("cost"))


@query("SELECT img, lb, annot AS label FROM (SELECT img, lb, annot, row_number() OVER (PARTITION BY img, lb ORDER BY least(greatest(n / t, 0.01), 0.99) DESC, annot) AS k FROM (SELECT *, sum(n) OVER (PARTITION BY img, lb) AS t FROM d)) WHERE k = 1", R, _H)
def argmin_labels(spark, sf):
    h = labels.histogram_norm(_px(spark, sf), "lb", "annot")
    return graph.best_labels(h.select("img", "lb", F.col("annot").alias("cls"), graph.unary_cost(F.col("ratio")).alias("cost")), ["img", "lb"])


@query("SELECT img, e.src, e.dst, CASE WHEN a.annot = b.annot THEN 0 WHEN a.annot = 0 OR b.annot = 0 THEN -ln(0.05) ELSE -ln(0.01) END AS cost FROM e JOIN m a USING (img) JOIN m b USING (img) WHERE e.src = a.lb AND e.dst = b.lb", R, _E, _T)
def pairwise_penalty(spark, sf):
    return graph.pairwise_penalty(_edges(spark, sf), labels.assign_by_max(_px(spark, sf), "lb", "annot"), "lb", "annot")


_PRED = "z AS (SELECT *, CAST((y // 25 + x // 35) % 3 AS INT) AS pred, CAST(annot > 0 AS INT) AS bt, CAST((y // 25 + x // 35) % 3 > 0 AS INT) AS bp FROM r)"


def _pred(spark, sf):
    px = _px(spark, sf).withColumn("pred", ((F.floor(F.col("y") / 25) + F.floor(F.col("x") / 35)) % 3).cast("int"))
    return px.withColumns({"bt": (F.col("annot") > 0).cast("int"), "bp": (F.col("pred") > 0).cast("int")})


@query("SELECT img, annot, pred, count(*) AS n FROM z GROUP BY ALL", R, _PRED)
def confusion(spark, sf):
    return metrics.confusion(_pred(spark, sf), "annot", "pred")


@query("SELECT img, round((s - a * b / tt) / ((a + b) / 2 - a * b / tt), 9) AS ars FROM (SELECT img, sum(n * (n - 1) / 2) AS s, sum(n) * (sum(n) - 1) / 2 AS tt FROM q GROUP BY img) JOIN (SELECT img, sum(m * (m - 1) / 2) AS a FROM (SELECT img, annot, sum(n) AS m FROM q GROUP BY ALL) GROUP BY img) USING (img) JOIN (SELECT img, sum(m * (m - 1) / 2) AS b FROM (SELECT img, pred, sum(n) AS m FROM q GROUP BY ALL) GROUP BY img) USING (img)", R, _PRED, "q AS (SELECT img, annot, pred, count(*) AS n FROM z GROUP BY ALL)")
def ars(spark, sf):
    return metrics.adjusted_rand(_pred(spark, sf), "annot", "pred").withColumn("ars", F.round("ars", 9))


@query("SELECT img, tp, tn, fp, fn, CASE WHEN fp + fn = 0 THEN 0 ELSE (fp + fn) / (tp + fn) END AS fpfn_tpfn, CASE WHEN tp + fn = 0 THEN 0 ELSE (tp + fp) / (tp + fn) END AS tpfp_tpfn FROM (SELECT img, count(*) FILTER (bt = 1 AND bp = 1) AS tp, count(*) FILTER (bt = 0 AND bp = 0) AS tn, count(*) FILTER (bt = 1 AND bp = 0) AS fp, count(*) FILTER (bt = 0 AND bp = 1) AS fn FROM z GROUP BY img)", R, _PRED)
def tp_tn_fp_fn(spark, sf):
    return metrics.tp_tn_fp_fn(_pred(spark, sf), "bt", "bp")


_PC = "pc AS (SELECT img, l AS label, CAST(count(*) FILTER (annot = l) AS BIGINT) AS support, count(*) FILTER (pred = l) AS found, count(*) FILTER (annot = l AND pred = l) AS tp FROM z, (VALUES (0), (1), (2)) v(l) GROUP BY img, l)"


@query("SELECT img, label, support, CASE WHEN found > 0 THEN tp / found ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN support + found > 0 THEN 2 * tp / (support + found) ELSE 0 END AS f1 FROM pc", R, _PRED, _PC)
def prf_class(spark, sf):
    return metrics.per_class(_pred(spark, sf), "annot", "pred")


@query("SELECT img, round(avg(tp / found), 9) AS precision_macro, round(avg(tp / support), 9) AS recall_macro, round(sum(tp) / sum(support), 9) AS accuracy FROM pc GROUP BY img", R, _PRED, _PC)
def prf_macro(spark, sf):
    a = metrics.averages(_pred(spark, sf), "annot", "pred")
    return a.select("img", *[F.round(c, 9).alias(c) for c in ("precision_macro", "recall_macro", "accuracy")])


@query("SELECT img, label, tp / (support + found - tp) AS jaccard FROM pc", R, _PRED, _PC)
def jaccard(spark, sf):
    return metrics.jaccard(_pred(spark, sf), "annot", "pred")


@query("SELECT 'c1' AS name, count(c1) AS count, round(avg(c1), 6) AS mean, round(stddev_samp(c1), 6) AS std, CAST(min(c1) AS DOUBLE) AS min, quantile_cont(c1, 0.25) AS q25, median(c1) AS median, quantile_cont(c1, 0.75) AS q75, CAST(max(c1) AS DOUBLE) AS max FROM r UNION ALL SELECT 'c2', count(c2), round(avg(c2), 6), round(stddev_samp(c2), 6), CAST(min(c2) AS DOUBLE), quantile_cont(c2, 0.25), median(c2), quantile_cont(c2, 0.75), CAST(max(c2) AS DOUBLE) FROM r", R)
def stat_summary(spark, sf):
    d = metrics.describe(_px(spark, sf), ["c1", "c2"])
    return d.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("SELECT a.id, b.id AS near FROM info a JOIN info b ON a.stack = b.stack WHERE a.stage IN (2, 3, 4) AND b.stage IN (2, 3, 4) AND abs(a.slice_index - b.slice_index) <= CASE b.stage WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 3 END", S)
def band_join(spark, sf):
    return spatial.slice_groups(rasters.slices(spark, sf), [2, 3, 4])


_CEN = """cen AS (SELECT img, CAST(y // 20 * 5 + x // 20 AS INT) AS c, y AS cy, x AS cx FROM
  (SELECT *, row_number() OVER (PARTITION BY img, y // 20, x // 20 ORDER BY c1 DESC, y, x) AS k FROM r) WHERE k = 1)"""


def _centres(spark, sf):
    """The brightest pixel of each of 25 fields of an image."""
    field = (F.floor(F.col("y") / 20) * 5 + F.floor(F.col("x") / 20)).cast("int").alias("c")
    best = _px(spark, sf).groupBy("img", field).agg(F.max_by(F.struct("y", "x"), F.struct("c1", -F.col("y"), -F.col("x"))).alias("p"))
    return best.select("img", "c", F.col("p.y").alias("cy"), F.col("p.x").alias("cx"))


@query("SELECT img, idx, y, x, c, sqrt(CAST(d2 AS DOUBLE)) AS distance FROM (SELECT p.img, idx, y, x, c, (y - cy) * (y - cy) + (x - cx) * (x - cx) AS d2, row_number() OVER (PARTITION BY idx ORDER BY (y - cy) * (y - cy) + (x - cx) * (x - cx), c) AS k FROM pts p JOIN cen USING (img)) WHERE k = 1", P, R, _CEN)
def nearest_center(spark, sf):
    return spatial.nearest(rasters.points(spark, sf), _centres(spark, sf))


@query("SELECT img, idx, CAST(min((y - cy) * (y - cy) + (x - cx) * (x - cx)) <= 36 AS INT) AS label FROM pts JOIN cen USING (img) GROUP BY img, idx", P, R, _CEN)
def label_points(spark, sf):
    return spatial.label_points(spatial.nearest(rasters.points(spark, sf), _centres(spark, sf)), 6).select("img", "idx", "label")


_DISK = "q AS (SELECT p.img, p.idx, r.annot, (r.y - p.y) * (r.y - p.y) + (r.x - p.x) * (r.x - p.x) AS d2 FROM pts p JOIN r ON p.img = r.img AND r.y BETWEEN p.y - 4 AND p.y + 4 AND r.x BETWEEN p.x - 4 AND p.x + 4)"


@query("SELECT img, idx, radius, annot, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY img, idx, radius) AS BIGINT) AS size FROM (SELECT *, unnest([1, 2, 4]) AS radius FROM q) WHERE d2 <= radius * radius GROUP BY img, idx, radius, annot", R, P, _DISK)
def disk_hist(spark, sf):
    return features.disk_histogram(_px(spark, sf), "annot", rasters.points(spark, sf), [1, 2, 4], rings=False)


@query("SELECT img, idx, radius, annot, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY img, idx, radius) AS BIGINT) AS size FROM (SELECT *, CASE WHEN d2 <= 1 THEN 1 WHEN d2 <= 4 THEN 2 ELSE 4 END AS radius FROM q WHERE d2 <= 16) GROUP BY img, idx, radius, annot", R, P, _DISK)
def ring_hist(spark, sf):
    return features.disk_histogram(_px(spark, sf), "annot", rasters.points(spark, sf), [1, 2, 4])


@query("SELECT DISTINCT img, y // 3 AS a, c2 // 5 AS b FROM r", R)
def unique_rows(spark, sf):
    return _px(spark, sf).select("img", F.floor(F.col("y") / 3).cast("int").alias("a"), F.floor(F.col("c2") / 5).alias("b")).distinct()


@query("SELECT label, min(count(*)) OVER () AS n FROM embeddings GROUP BY label")
def balance_sizes(spark, sf):
    return datasets.sizes(datasets.balance(rasters.features(spark, sf), "label", "vec_id"), [], "label")


@query("SELECT vec_id, CAST((dense_rank() OVER (ORDER BY label) - 1) // 3 AS INT) AS fold FROM embeddings")
def folds_group(spark, sf):
    return datasets.group_folds(rasters.features(spark, sf), "label", 3).select("vec_id", "fold")


_RAY = "ray AS (SELECT vec_id AS id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS angle, CAST(floor(abs(CAST(unnest(embedding) AS DOUBLE)) * 1000) AS BIGINT) AS dist FROM embeddings)"


def _rays(spark, sf):
    f = rasters.features(spark, sf)
    return f.select(F.col("vec_id").alias("id"), F.posexplode("features").alias("angle", "v")).select("id", "angle", F.floor(F.abs("v") * 1000).cast("long").alias("dist"))


@query("SELECT angle, bin, (t - sum(n) OVER (PARTITION BY angle ORDER BY bin)) / t AS beyond FROM (SELECT g.angle, CAST(i.range AS INT) AS bin, t, coalesce(n, 0) AS n FROM g CROSS JOIN range(10) i LEFT JOIN (SELECT angle, least((dist - lo) * 10 // (hi - lo), 9) AS bin, count(*) AS n FROM ray JOIN g USING (angle) GROUP BY ALL) c ON c.angle = g.angle AND c.bin = i.range)", _RAY, "g AS (SELECT angle, min(dist) AS lo, max(dist) AS hi, count(*) AS t FROM ray GROUP BY angle)")
def ray_cdf_hist(spark, sf):
    return ml.ray_histogram(_rays(spark, sf))


@query("SELECT img, lo + (b + 0.5) * (hi - lo) / 256 AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY CASE WHEN c < t THEN CAST(s * t - u * c AS DOUBLE) * CAST(s * t - u * c AS DOUBLE) / CAST(c * (t - c) AS DOUBLE) ELSE -1 END DESC, b) AS k FROM (SELECT img, lo, hi, b, CAST(sum(n) OVER o AS BIGINT) AS c, CAST(sum(n * b) OVER o AS BIGINT) AS s, CAST(sum(n) OVER w AS BIGINT) AS t, CAST(sum(n * b) OVER w AS BIGINT) AS u FROM (SELECT img, lo, hi, least((c1 - lo) * 256 // (hi - lo), 255) AS b, count(*) AS n FROM r JOIN (SELECT img, min(c1) AS lo, max(c1) AS hi FROM r GROUP BY img) USING (img) GROUP BY ALL) WINDOW o AS (PARTITION BY img ORDER BY b), w AS (PARTITION BY img))) WHERE k = 1", R)
def otsu(spark, sf):
    return ml.otsu(_px(spark, sf), ["img"], "c1")


_ELL = """el AS (SELECT img, CAST(y // 20 AS INT) AS e, CAST(sum(y) AS DOUBLE) / count(*) AS cy, CAST(sum(x) AS DOUBLE) / count(*) AS cx,
  CAST(8 + count(*) % 9 AS DOUBLE) AS a, CAST(6 AS DOUBLE) AS b, CAST(y // 20 AS DOUBLE) / 2 AS theta FROM r JOIN (SELECT img, sum(c1) // count(*) AS t FROM r GROUP BY img) USING (img) WHERE c1 > t GROUP BY img, y // 20)"""


def _ellipses(spark, sf):
    """Ellipses around the centre of the bright pixels of each fifth of an image, longer or shorter by their number."""
    n, px = F.count("*"), _px(spark, sf)
    mean = px.groupBy("img").agg(F.expr("sum(c1) div count(*)").alias("t"))
    bright = px.join(mean, "img").where("c1 > t").groupBy("img", F.floor(F.col("y") / 20).cast("int").alias("e")).agg((F.sum("y") / n).alias("cy"), (F.sum("x") / n).alias("cx"), (8.0 + n % 9).alias("a"))
    return bright.select("img", "e", "cy", "cx", "a", F.lit(6.0).alias("b"), (F.col("e") / 2).alias("theta"))


@query("SELECT img, e, annot, shared, shared / least(es, os) AS ratio FROM (SELECT img, e, annot, count(*) AS shared FROM dr WHERE annot > 0 GROUP BY ALL) JOIN (SELECT img, e, count(*) AS es FROM dr GROUP BY ALL) USING (img, e) JOIN (SELECT img, annot, count(*) AS os FROM r GROUP BY ALL) USING (img, annot)", R, _ELL, "dr AS (SELECT img, y, x, annot, e FROM r JOIN el USING (img) WHERE pow(((x - cx) * cos(theta) + (y - cy) * sin(theta)) / a, 2) + pow(((y - cy) * cos(theta) - (x - cx) * sin(theta)) / b, 2) <= 1)")
def ellipse_overlap(spark, sf):
    return spatial.ellipse_overlap(_px(spark, sf), _ellipses(spark, sf), "annot")


_CELL = "((({a}) % 36 * 7 + least({d}, 19) * 3) % 11) / 10.0"


@query(
    "SELECT img, y, x, c1, round(CASE WHEN far THEN " + _CELL.format(a="a", d="d") + " ELSE (1 - s) * ((1 - t) * " + _CELL.format(a="a", d="d") + " + t * " + _CELL.format(a="a", d="d + 1")
    + ") + s * ((1 - t) * " + _CELL.format(a="a + 1", d="d") + " + t * " + _CELL.format(a="a + 1", d="d + 1") + ") END, 9) AS prior FROM w", R,
    """o AS (SELECT img, y, x, c1, sqrt(CAST((y - 50 - img) * (y - 50 - img) + (x - 40) * (x - 40) AS DOUBLE)) AS dist,
      ((810 - degrees(atan2(CAST(x - 40 AS DOUBLE), CAST(y - 50 - img AS DOUBLE)))) % 360) / 10 AS ang FROM r)""",
    """u AS (SELECT *, dist >= 19 AS far, CAST(CASE WHEN dist >= 19 THEN round_even(ang, 0) ELSE floor(ang) END AS INT) AS a, CAST(CASE WHEN dist >= 19 THEN 19 ELSE floor(dist) END AS INT) AS d FROM o)""",
    "w AS (SELECT *, ang - a AS s, dist - d AS t FROM u)")
def shape_prior(spark, sf):
    """A table of 36 angles and 20 distances, looked up from a centre in each image."""
    cells = spark.range(36 * 20).select((F.col("id") % 36).cast("int").alias("a"), F.floor(F.col("id") / 36).cast("int").alias("d"))
    table = cells.withColumn("p", (F.col("a") * 7 + F.col("d") * 3) % 11 / 10)
    px = _px(spark, sf).withColumns({"dx": F.col("y") - 50 - F.col("img"), "dy": F.col("x") - 40})
    return ml.shape_prior(px, table, 36, 20).select("img", "y", "x", "c1", F.round("prior", 9).alias("prior"))


@query("SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS feature, round(CAST(unnest(embedding) AS DOUBLE), 3) + 0.0 AS v FROM embeddings")
def rounded_features(spark, sf):
    f = rasters.features(spark, sf).select("label", F.transform("features", lambda v: F.round(v, 3) + 0.0).alias("features"))
    return f.select("label", F.posexplode("features").alias("feature", "v"))


@query(
    "SELECT img, count(*) AS objects, count(*) FILTER (n = 0) AS missed, count(*) FILTER (n > 1) AS multiple FROM (SELECT r.img, lb, count(cy) AS n FROM r LEFT JOIN c ON r.y = cy + r.img AND r.x = cx WHERE lb > 0 GROUP BY r.img, lb) GROUP BY img", R,
    "c AS (SELECT CAST(a.range * 17 + 3 AS INT) AS cy, CAST(b.range * 7 + 2 AS INT) AS cx FROM range(5) a, range(14) b)")
def missed_objects(spark, sf):
    """Of the segments of every image, those without a centre and those with several."""
    px = _px(spark, sf)
    at = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    centres = px.select("img").distinct().withColumn("a", at(5)).withColumn("b", at(14)).select("img", (F.col("a") * 17 + 3 + F.col("img")).alias("y"), (F.col("b") * 7 + 2).alias("x"))
    return spatial.centres_in_objects(centres, px, "lb")


@query("SELECT img, y, x, CAST(max(m) AS INT) AS m FROM (SELECT a.img, a.y, a.x, b.m FROM q a JOIN q b ON a.img = b.img AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 4) GROUP BY img, y, x", R, "q AS (SELECT img, y, x, CAST(c1 > 60 AS INT) AS m FROM r)")
def dilated_mask(spark, sf):
    return segmentation.dilate(_px(spark, sf).select("img", "y", "x", (F.col("c1") > 60).cast("int").alias("m")), "m", 2)


@query("SELECT p.img, idx, angle, CASE WHEN m0 THEN 0 ELSE d END AS distance FROM (SELECT img, idx, angle, coalesce(round(min(CASE WHEN r.c1 > 60 THEN k * u END), 6), -1) AS d, bool_or(k = 0 AND r.c1 > 60) AS m0 FROM mk JOIN r USING (img, y, x) GROUP BY ALL) p", R, "cen AS (SELECT img, CAST(a.range AS BIGINT) AS idx, CAST((a.range * 17 + img * 5) % 100 AS INT) AS py, CAST(a.range * 29 % 100 AS INT) AS px FROM (SELECT DISTINCT img FROM r), range(30) a)", "an AS (SELECT CAST(i.range * 30 AS INT) AS angle, sin(radians(i.range * 30)) / greatest(abs(sin(radians(i.range * 30))), abs(cos(radians(i.range * 30)))) AS gy, cos(radians(i.range * 30)) / greatest(abs(sin(radians(i.range * 30))), abs(cos(radians(i.range * 30)))) AS gx FROM range(12) i)", "mk AS (SELECT img, idx, angle, k.range AS k, sqrt(gy * gy + gx * gx) AS u, CAST(round_even(py + k.range * gy, 0) AS INT) AS y, CAST(round_even(px + k.range * gx, 0) AS INT) AS x FROM cen, an, range(143) k)")
def rays(spark, sf):
    px = _px(spark, sf).withColumn("m", (F.col("c1") > 60).cast("int"))
    i = F.col("idx")
    pts = px.select("img").distinct().withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(29)).cast("array<long>")))
    pts = pts.select("img", "idx", ((i * 17 + F.col("img") * 5) % 100).cast("int").alias("y"), (i * 29 % 100).cast("int").alias("x"))
    return spatial.rays(px, "m", pts, 30).withColumn("distance", F.round("distance", 6))


@query()
def gmm_proba(spark, sf):
    f = rasters.features(spark, sf)
    return ml.probabilities(ml.class_model(f, 3, pca=4), f).select("vec_id", "prediction", "proba")


@query()
def kmeans_labels(spark, sf):
    f = rasters.features(spark, sf)
    return ml.probabilities(ml.class_model(f, 10, kind="kmeans"), f).select("vec_id", "prediction")


@query()
def rf_predict(spark, sf):
    train, held = datasets.hold_out(rasters.features(spark, sf), "vec_id", 0.3)
    return ml.probabilities(ml.train(train, "random forest", pca=8), held).select("vec_id", "label", "prediction", "proba")


@query()
def cv_scores(spark, sf):
    f = rasters.features(spark, sf).withColumn("fold", F.pmod(F.xxhash64("vec_id"), F.lit(3)).cast("int"))
    return ml.cross_scores(f, "naive Bayes", "fold")


@query()
def roc_curve(spark, sf):
    train, held = datasets.hold_out(rasters.features(spark, sf).withColumn("label", (F.col("label") < 5).cast("int")), "vec_id", 0.3)
    made = ml.probabilities(ml.train(train, "logistic regression"), held)
    return metrics.roc(made.select("label", F.col("proba")[1].alias("score")), "label", "score")


@query("SELECT feature, round(b / 9 / (w / (t - 10)), 6) AS f_score FROM (SELECT feature, sum(n * (m - mm) * (m - mm)) AS b, sum(n * s) AS w, sum(n) AS t FROM (SELECT feature, label, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM x GROUP BY ALL) JOIN (SELECT feature, avg(v) AS mm FROM x GROUP BY feature) USING (feature) GROUP BY feature)", "x AS (SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS feature, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)")
def feature_scores(spark, sf):
    return ml.feature_scores(rasters.features(spark, sf), "label").select("feature", F.round("f_score", 6).alias("f_score"))


@query()
def texture_lm(spark, sf):
    """Statistics of segments over the whole filter bank: four scales, eight orientations of edges and bars, Gaussians and Laplacians."""
    return segmentation.texture(_px(spark, sf), "c1", "lb", (2**0.5, 2.0, 2 * 2**0.5, 4.0), 8, 8)


@query()
def slic(spark, sf):
    return segmentation.superpixels(_px(spark, sf), CHANNELS, 10, 40.0).select("img", "y", "x", "sp")


@query()
def graph_cut(spark, sf):
    return segmentation.segment_classes(_px(spark, sf), "lb", CHANNELS, 3, 0.5)


@query()
def region_grow(spark, sf):
    px = _px(spark, sf)
    h = labels.histogram_norm(px, "lb", "annot").where("annot < 3")
    unary = h.select("img", "lb", F.col("annot").alias("cls"), graph.unary_cost(F.col("ratio")).alias("cost"))
    seeds = px.select("img").distinct().withColumn("s", F.explode(F.array(F.struct(F.lit(22).alias("lb"), F.lit(1).alias("label")), F.struct(F.lit(77).alias("lb"), F.lit(2).alias("label"))))).select("img", "s.*")
    return segmentation.grow_regions(unary, _edges(spark, sf).withColumn("w", F.lit(1.0)), seeds, graph.pairwise_matrix(3, 0.3), "lb")


@query(
    """SELECT img, lab AS cluster, count(*) AS n, sum(y) / count(*) AS y, sum(x) / count(*) AS x FROM (SELECT u.*, label AS lab FROM u JOIN lab USING (idx)) GROUP BY img, lab""", P,
    "u AS (SELECT img, min(idx) AS idx, y, x FROM pts GROUP BY img, y, x)",
    "e AS (SELECT a.idx AS s, b.idx AS t FROM u a JOIN u b ON a.img = b.img AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 2 AND a.idx <> b.idx)",
    """lab(idx, label) USING KEY (idx) AS (SELECT idx, idx AS label FROM u
      UNION SELECT e.t, min(n.label) FROM lab n JOIN e ON e.s = n.idx JOIN recurring.lab r ON r.idx = e.t WHERE n.label < r.label GROUP BY e.t)""")
def center_clusters(spark, sf):
    """Points that steps of at most the diagonal of a pixel join; of points at one place the first."""
    pts = rasters.points(spark, sf).groupBy("img", "y", "x").agg(F.min("idx").alias("idx"))
    return spatial.cluster_points(pts, math.sqrt(2))


@query()
def ellipse_fit(spark, sf):
    drawn = spatial.draw_ellipses(_px(spark, sf), _ellipses(spark, sf))
    edge = labels.contour(_px(spark, sf).join(drawn.where("e < 2"), ["img", "y", "x"], "left").fillna(-1, ["e"]), "e", 1).where("contour = 1")
    return spatial.ellipse_from_points(edge.select("img", "e", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")), ["img", "e"])
