import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.operators import boundary, candidates, spatial, spectral
from pixelmill.plans import objects  # noqa: F401  adds to the catalog
from pixelmill.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def rows_of(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, features array<double>")


def test_rings_are_parted(spark):
    rng = np.random.default_rng(2)
    a = rng.random(400) * 2 * np.pi
    r = np.where(np.arange(400) < 130, 1.0, 4.0) + rng.normal(0, 0.05, 400)
    x = np.c_[r * np.cos(a), r * np.sin(a)]
    got = {g["id"]: g["cluster"] for g in spectral.cluster(rows_of(spark, x), 2, gamma=8.0, landmarks=300).collect()}
    inner, outer = {got[k] for k in range(130)}, {got[k] for k in range(130, 400)}
    assert len(inner) == len(outer) == 1 and inner != outer


def test_like_dense_eigenvectors(spark):
    """With every vector a landmark, coordinates are the eigenvectors of the whole matrix; nulls, NaN and repeated rows have their place."""
    x = np.random.default_rng(0).normal(size=(60, 3))
    x[7] = x[3]
    df = rows_of(spark, x).union(spark.createDataFrame([(100, None), (101, [1.0, float("nan"), 0.0]), (102, [1.0, None, 0.0])], "id long, features array<double>"))
    placed, values = spectral.coordinates(df, 4, gamma=0.7)
    got = {r["id"]: r["coordinates"] for r in placed.collect()}
    assert got[100] is got[101] is got[102] is None
    w = np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(-1))
    d = w.sum(1)
    lam, v = np.linalg.eigh(w / np.sqrt(d[:, None] * d[None]))
    want = v[:, ::-1][:, :4] / np.sqrt(d)[:, None]
    mine = np.array([got[k] for k in range(60)])
    assert np.allclose(values, lam[::-1][:4], atol=1e-8)
    assert np.allclose(np.abs(mine), np.abs(want), atol=1e-5)
    out = {r["id"]: r["cluster"] for r in spectral.cluster(df, 3, gamma=0.7).collect()}
    assert out[100] is None and out[3] == out[7] and len(out) == 63


def test_spectral_of_little(spark):
    none = spark.createDataFrame([], "id long, features array<double>")
    assert spectral.cluster(none, 2).count() == 0
    same_rows = spectral.cluster(rows_of(spark, np.ones((5, 2))), 2).collect()
    assert {r["cluster"] for r in same_rows} == {0}
    shapes = spark.createDataFrame([(0, k, [float(v) for v in r]) for k, r in enumerate([[9, 9, 9], [9, 8, 9], [2, 2, 2], [2, 3, 2]])], "img int, object int, distances array<double>")
    models = boundary.shape_models(shapes, "spectral", 2, 12)
    assert sorted(r[0] for r in models.select("weight", "model").distinct().collect()) == [0.5, 0.5]


def test_point_features(spark):
    """Rings and rays of a point in a square with a frame of zeros."""
    img = np.zeros((21, 21), int)
    img[4:17, 4:17] = 1
    px = spark.createDataFrame([(0, y, x, int(img[y, x])) for y in range(21) for x in range(21)], "img int, y int, x int, annot int")
    points = spark.createDataFrame([(0, 1, 10, 10), (0, 2, 6, 10)], "img int, idx int, y int, x int")
    got = {r["idx"]: r["features"] for r in candidates.point_features(px, "annot", points, [0, 1], [2, 4], 90, (("up", (0,)), ("up", (9,)))).collect()}
    assert got[1] == [0.0, 1.0, 0.0, 1.0, 7.0, 7.0, 7.0, 7.0]
    assert got[2][0:2] == [0.0, 1.0] and 0 < got[2][2] < 1 and sorted(got[2][4:]) == [3.0, 7.0, 7.0, 11.0] and got[2][4] == 11.0
    both = candidates.point_features(px, "annot", points, [0, 1], None, 90, (("up", (0,)), ("up", (9,))), closer=False)
    assert {r["idx"]: r["features"][4:] for r in both.collect()}[1] == [-1.0] * 4
    flat = spark.createDataFrame([([0.0, 4.0, 0.0, 0.0],)], "d array<double>").select(candidates.smoothed_rays("d", 0.5).alias("s")).first()[0]
    assert abs(sum(flat) - 4) < 1e-9 and flat[0] == pytest.approx(flat[2]) and flat[1] > 3


def test_labels_of_points_and_evaluation(spark):
    points = spark.createDataFrame([(0, 1, 3.0, 4.0), (0, 2, 20.0, 20.0), (0, 3, 90.0, 90.0), (1, 1, 0.0, 0.0)], "img int, idx int, y double, x double")
    centres = spark.createDataFrame([(0, 7, 0.0, 0.0), (0, 8, 21.0, 20.0)], "img int, idx int, y double, x double")
    got = {(r["img"], r["idx"]): r["label"] for r in candidates.label_close_points(points, centres, 5.0).collect()}
    assert got == {(0, 1): 1, (0, 2): 1, (0, 3): 0, (1, 1): 0}
    regions = spark.createDataFrame([(0, 3, 4, 2)], "img int, y int, x int, level int")
    got = {(r["img"], r["idx"]): r["label"] for r in candidates.label_close_points(points, regions=regions).collect()}
    assert got == {(0, 1): 2, (0, 2): 0, (0, 3): 0, (1, 1): 0}
    assert {r["label"] for r in candidates.label_close_points(points).collect()} == {-1}
    found = points.withColumnRenamed("idx", "cluster")
    rows = {r["img"]: tuple(r)[1:] for r in candidates.evaluate(found, centres, 5.0).collect()}
    assert rows == {0: (2, 3, 2, 1, 0), 1: (0, 1, 0, 1, 0)}


def test_centres_are_found(spark):
    r = QUERIES["candidate_centers"](spark, SF).agg(F.sum("centres"), F.sum("tp"), F.sum("fp")).first()
    assert r[0] > 0 and r[1] > 0


def test_levels_round_circles_as_places_of_the_image(spark):
    """A pixel on the circle to the last digit; places counted from the box gave it another level than the SQL twin."""
    px = objects._objects(spark, "/root/testdata/sf0.1").where("img = 0")
    assert candidates.center_levels(px, "ob").where("y = 16 and x = 37").first()["level"] == 1


def test_levels_in_memory_as_by_rows(spark, monkeypatch):
    """Objects of all sizes, some touching, with holes, or as large as their image; boxes are one group an image, without passes of their own for each level."""
    rng = np.random.default_rng(5)
    y, x = np.mgrid[:60, :70]
    one = np.where((y - 25) ** 2 + (x - 30) ** 2 < 500, 1, 0) + np.where((y > 50) & (x > 5), 2, 0)
    one[rng.random(one.shape) < 0.02] = 3
    two = np.full((6, 40), 4)
    three = np.where(np.mgrid[:5, :90][1] > 3, 7, 0)
    rows = [(i, a, b, int(v)) for i, img in enumerate((one, two, three)) for (a, b), v in np.ndenumerate(img)]
    px = spark.createDataFrame(rows, "img int, y int, x int, o int")
    made = candidates.center_levels(px, "o")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
    got = sorted(map(tuple, made.collect()))
    monkeypatch.setattr(candidates, "MOST", 900)
    mixed = sorted(map(tuple, candidates.center_levels(px, "o").collect()))
    monkeypatch.setattr(candidates, "MOST", -1)
    assert got == mixed == sorted(map(tuple, candidates.center_levels(px, "o").collect()))
    assert {r[-1] for r in got} == {0, 1, 2, 3} and len(got) == len(rows)
    assert candidates.center_levels(px.limit(0), "o").count() == 0


def test_rays_are_dealt_before_their_steps(spark, monkeypatch):
    """Points of one partition; Spark would make the steps of all rays in its task."""
    px = spark.createDataFrame([(0, y, x, int(y == 9)) for y in range(10) for x in range(10)], "img int, y int, x int, m int")
    points = spark.createDataFrame([(0, k, k, 5) for k in range(10)], "img int, idx int, y int, x int").coalesce(1)
    monkeypatch.setattr(spatial, "RAYS", 10)
    made = spatial.rays(px, "m", points, 90)
    assert "RepartitionByExpression [img" in made._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["idx"], r["angle"]): r["distance"] for r in made.collect()}
    assert len(got) == 40 and got[(2, 90)] == 7.0 and got[(2, 270)] == -1.0 and got[(9, 0)] == 0.0


def test_affinities_are_added_in_slices(spark):
    rows = spark.range(2500).repartition(1).select(F.array(F.col("id").cast("double")).alias("features"))
    # a part adds its rows' number squared, which is far larger where all rows come at once
    assert 2500 <= spectral._added(rows, 1, 1, lambda x: np.array([[len(x) ** 2.0]]))[0, 0] <= 2500 * 1024
