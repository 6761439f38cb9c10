"""Operators on whole rasters, boundaries and shapes, against numpy and against shapes that are known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.operators import boundary, datasets, filters, graph, labels, ml, pixelwise, ranks, segmentation, spatial
from pixelmill.sources import files


def raster(spark, a, name="v"):
    return spark.createDataFrame([(0, int(y), int(x), v.item()) for (y, x), v in np.ndenumerate(a)], f"img int, y int, x int, {name} {'double' if a.dtype.kind == 'f' else 'int'}")


def image(df, name, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["y"], r["x"]] = r[name]
    return out


def test_convolution_over_tile_borders(spark, monkeypatch):
    monkeypatch.setattr(filters, "TILE", 7)
    a = np.random.default_rng(1).normal(size=(20, 17))
    taps = [(dy, dx, float(3 * dy - dx + 0.5)) for dy in range(-3, 4) for dx in range(-3, 4)]
    got = image(filters.convolve(raster(spark, a), "v", {"k": taps}), "k", a.shape)
    padded = np.pad(a, 3, mode="symmetric")
    want = sum(w * padded[3 + dy : 23 + dy, 3 + dx : 20 + dx] for dy, dx, w in taps)
    assert np.allclose(got, want)


def test_bank_has_balanced_kernels():
    bank = filters.filter_bank((1.0, 2.0), 4)
    assert len(bank) == 10 and sum(map(len, bank.values())) == 22
    for family, kernels in bank.items():
        for taps in kernels.values():
            assert sum(abs(w) for *_, w in taps) == pytest.approx(1) and sum(w for *_, w in taps) == pytest.approx(1 if "gauss" in family else 0, abs=1e-9)
    assert sum(map(abs, filters.gaussian_1d(1.5, 1))) == pytest.approx(1)


def test_nearest_mark_and_inpainting(spark):
    rng = np.random.default_rng(2)
    a, m = rng.integers(0, 9, (23, 19)), (rng.random((23, 19)) < 0.06).astype(int)
    px = raster(spark, a).join(raster(spark, m, "m"), ["img", "y", "x"])
    marks = [(int(y), int(x)) for y, x in np.argwhere(m)]
    got = {(r["y"], r["x"]): (r["d2"], r["_ny"], r["_nx"]) for r in labels.nearest_mark(px, "m").collect()}
    for (y, x), g in got.items():
        assert g == min(((y - p) ** 2 + (x - q) ** 2, p, q) for p, q in marks)
    filled = image(pixelwise.inpaint(px, F.col("m") == 1, ["v"]), "v", a.shape)
    assert all(filled[k] == a[g[1], g[2]] for k, g in got.items())


def test_regions_and_holes(spark):
    a = np.zeros((12, 14), int)
    a[2:9, 2:9] = 1
    a[4:6, 4:7] = 0  # a hole
    a[9, 8] = a[8, 9] = 1
    a[8, 8] = 0  # open at its corner only, so a hole too
    a[3, 12] = a[0, 0] = 1
    got = image(pixelwise.fill_holes(raster(spark, a), "v"), "v", a.shape)
    want = a.copy()
    want[4:6, 4:7] = want[8, 8] = 1
    assert (got == want).all()
    named = pixelwise.regions(raster(spark, a), "v")
    assert named.where("v = 1").select("region").distinct().count() == 5 and named.where("v = 0 and region is not null").count() == 0


@pytest.mark.parametrize("n", [1, 2, 30, 400])
def test_components_like_union_find(spark, n):
    rng = np.random.default_rng(n)
    pairs = [(0, int(a), int(b)) for a, b in rng.integers(0, n, (n, 2))] + [(1, k, k + 1) for k in range(n)]
    root = {(g, k): (g, k) for g in (0, 1) for k in range(n + 1)}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for g, a, b in pairs:
        low, high = sorted((find((g, a)), find((g, b))))
        root[high] = low
    nodes = spark.createDataFrame([(g, k) for g in (0, 1) for k in range(n + 1)], "img int, node int")
    got = graph.components(spark.createDataFrame(pairs, "img int, src int, dst int"), nodes).collect()
    assert len(got) == 2 * (n + 1) and all(find((r["img"], r["node"])) == (r["img"], r["component"]) for r in got)


def test_running_sums_and_ranks(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k), int(v)) for k, v in zip(rng.permutation(500), rng.integers(-5, 9, 500))]
    df = spark.createDataFrame(rows, "k int, v int").repartition(4)
    got = {r["k"]: (r["s"], r["n"]) for r in ranks.running(df, [F.desc("k")], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    assert all(got[k] == (sum(v for j, v in rows if j >= k), 500 - k) for k, _ in rows)
    assert {r["k"]: r["rank"] for r in ranks.ranked(df, [F.col("k")]).collect()} == {k: k for k, _ in rows}
    groups = spark.createDataFrame([(f"g{k % 11:02d}",) for k in range(40)], "g string")
    assert {(r["g"], r["fold"]) for r in datasets.group_folds(groups, "g", 3).collect()} == {(f"g{k:02d}", k // 3) for k in range(11)}


def ellipse_raster(spark, cy, cx, a, b, theta, shape=(70, 90)):
    y, x = np.indices(shape)
    u, v = (x - cx) * math.cos(theta) + (y - cy) * math.sin(theta), (y - cy) * math.cos(theta) - (x - cx) * math.sin(theta)
    return raster(spark, ((u / a) ** 2 + (v / b) ** 2 <= 1).astype(int), "annot")


def test_ransac_finds_the_ellipse_among_outliers(spark):
    px = ellipse_raster(spark, 34, 45, 30, 18, 0.5)
    rng = np.random.default_rng(3)
    t = rng.random(60) * 2 * math.pi
    y = 34 + 30 * np.cos(t) * math.sin(0.5) + 18 * np.sin(t) * math.cos(0.5)
    x = 45 + 30 * np.cos(t) * math.cos(0.5) - 18 * np.sin(t) * math.sin(0.5)
    pts = [(0, 0, k, float(p), float(q)) for k, (p, q) in enumerate(zip(y, x))] + [(0, 0, 100 + k, *map(float, rng.random(2) * 60)) for k in range(6)]
    sp = px.groupBy("img", (F.floor(F.col("y") / 5) * 20 + F.floor(F.col("x") / 5)).cast("int").alias("idx")).agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.mode("annot").alias("label"), F.count("*").alias("weight"))
    e = boundary.ransac_ellipses(spark.createDataFrame(pts, "img int, idx int, k int, y double, x double"), sp, (0.1, 0.9), 0.2, 1.0, 40).first()
    assert [round(e[c]) for c in ("cy", "cx")] == [34, 45] and sorted(round(e[c]) for c in ("a", "b")) == [18, 30]


def test_boundary_points_lie_on_the_boundary(spark):
    px = ellipse_raster(spark, 34, 45, 30, 18, 0.5)
    centre = spark.createDataFrame([(0, 0, 34, 45)], "img int, idx int, y int, x int")
    pts = boundary.boundary_points(px, "annot", centre, "edge", 2.0, 3.0, 0, 0, 15).collect()
    far = [math.hypot(r["y"] - 34, r["x"] - 45) for r in pts]
    assert 20 <= len(pts) <= 24 and 16 < min(far) and max(far) < 32


def test_rays_are_filled(spark):
    full = [10 + 3 * math.sin(2 * math.pi * k / 24) for k in range(24)]
    gaps = [v if k % 4 or not k else -1.0 for k, v in enumerate(full)]
    df = spark.createDataFrame([(gaps,), ([-1.0] * 24,)], "d array<double>")
    for kind, error in (("spline", 0.05), ("cos", 1e-6), (5, 0.2)):
        a, b = [r[0] for r in df.select(boundary.interpolated(kind)("d")).collect()]
        assert max(abs(p - q) for p, q in zip(a, full)) < error and b == [-1.0] * 24


def test_shapes_are_turned_to_their_longest_ray(spark):
    s = boundary.object_shapes(ellipse_raster(spark, 34, 45, 30, 12, 0.0), "annot", 10).first()
    d = s["distances"]
    assert len(d) == 36 and d[0] == max(d) and min(d) == pytest.approx(13, abs=2) and d[18] == pytest.approx(d[0], abs=2)
    table = boundary.shape_models(spark.createDataFrame([([5.0 + k % 2, 9.0],) for k in range(40)], "distances array<double>"), "kmeans", 1, 12).collect()
    p = {(r["a"], r["d"]): r["p"] for r in table}
    assert p[0, 3] > 0.99 and p[0, 8] < 0.01 and p[1, 8] > 0.99 and p[1, 10] < 0.01 and sum({r["model"]: r["weight"] for r in table}.values()) == pytest.approx(1)


def test_straightened_object_lies_flat(spark):
    out = pixelwise.straightened(ellipse_raster(spark, 34, 45, 25, 9, 0.9), "annot", ["annot"]).agg(F.max("y"), F.max("x"), F.sum("annot")).first()
    assert abs(out[0] - 18) <= 2 and abs(out[1] - 50) <= 2 and abs(out[2] - math.pi * 25 * 9) < 25


def test_thin_points_leaves_no_close_pair(spark):
    rng = np.random.default_rng(5)
    pts = [(0, k, *map(float, rng.random(2) * 20)) for k in range(80)]
    want = {k: p for _, k, *p in pts}
    while True:
        close = min(((math.dist(want[a], want[b]), a, b) for a in want for b in want if a < b), default=(9,))
        if close[0] >= 2:
            break
        del want[close[2]]
    got = spatial.thin_points(spark.createDataFrame(pts, "img int, idx int, y double, x double"), 2.0).collect()
    assert {r["idx"] for r in got} == set(want)


def test_trained_models_are_kept_and_read(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(k, k % 2, k % 5, [float(v) for v in rng.normal(4 * (k % 2), 1, 3)] + [float(rng.normal())]) for k in range(200)]
    df = spark.createDataFrame(rows, "key int, label int, img int, features array<double>")
    model = ml.train(df, "decision tree")
    ml.save_model(model, f"file://{tmp_path}/m")
    again = ml.load_model(f"file://{tmp_path}/m")
    a, b = (sorted((r["key"], r["prediction"]) for r in ml.probabilities(m, df).collect()) for m in (model, again))
    assert a == b and len(ml.best_features(df, "label", 2).first()["features"]) == 2
    made = ml.leave_groups_out(df, "img", "decision tree")
    assert made.count() == 200 and made.where("prediction = label").count() > 180
    small = datasets.balance_by_kmeans(df, "label", "key", n=10)
    assert {r["label"]: r["count"] for r in small.groupBy("label").count().collect()} == {0: 10, 1: 10}
    clusters = ml.probabilities(ml.class_model(df, 2, kind="kmeans"), df).groupBy("label", "prediction").count().orderBy(F.desc("count")).limit(2).collect()
    assert {r["label"] for r in clusters} == {0, 1} and len({r["prediction"] for r in clusters}) == 2 and sum(r["count"] for r in clusters) > 190
    mixed = ml.probabilities(ml.class_model(df, 2), df).select("label", (F.array_position("proba", F.array_max("proba"))).alias("c")).groupBy("label", "c").count().orderBy(F.desc("count")).limit(2).collect()
    assert {r["label"] for r in mixed} == {0, 1} and len({r["c"] for r in mixed}) == 2 and sum(r["count"] for r in mixed) > 185


def test_tiff_pages(spark, tmp_path):
    import struct
    import zlib

    rng = np.random.default_rng(8)
    pages = [rng.integers(0, 60000, (6, 5), np.uint16), rng.integers(0, 255, (4, 7, 3), np.uint8)]
    out, at = bytearray(b"II*\0" + struct.pack("<I", 0)), 4
    for v in pages:
        deflate = v.ndim == 3
        strip = zlib.compress(v.tobytes()) if deflate else v.tobytes()
        place = len(out)
        out += strip
        channels = v.shape[2] if v.ndim == 3 else 1
        bits = len(out)
        out += struct.pack("<3H", *[v.itemsize * 8] * 3)
        struct.pack_into("<I", out, at, len(out))
        tags = [(256, 3, 1, v.shape[1]), (257, 3, 1, v.shape[0]), (258, 3, channels, bits if channels > 2 else v.itemsize * 8), (259, 3, 1, 8 if deflate else 1), (273, 4, 1, place), (277, 3, 1, channels), (279, 4, 1, len(strip))]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        at = len(out)
        out += struct.pack("<I", 0)
    (tmp_path / "stack.tif").write_bytes(bytes(out))
    got = {(r["z"], r["y"], r["x"]): (r["c1"], r["c2"], r["c3"]) for r in files.tiff(spark, f"{tmp_path}/*.tif").where("img = 'stack'").collect()}
    assert len(got) == 30 + 28
    assert all(got[0, y, x] == (v, v, v) for (y, x), v in np.ndenumerate(pages[0]))
    assert all(got[1, y, x] == tuple(pages[1][y, x]) for y in range(4) for x in range(7))


def test_dumps_and_triplets(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5])], "img int, features array<double>")
    files.dump(df, f"file://{tmp_path}/d")
    files.dump(df, f"file://{tmp_path}/d")
    assert files.load_dump(spark, f"file://{tmp_path}/d").collect() == df.collect()
    (tmp_path / "list.csv").write_text(",path_image,path_segm,path_centers\n0,/a/x.png,/b/x.png,/c/x.csv\n")
    assert tuple(files.csv_triplets(spark, f"file://{tmp_path}/list.csv").first()) == ("/a/x.png", "/b/x.png", "/c/x.csv", "x")


def broadcast_rows(spark, df) -> int:
    """Rows of the largest broadcast of a query that has run."""
    plan = df._jdf.queryExecution()
    plan.toRdd().count()
    most, left = 0, [plan.executedPlan()]
    while left:
        p = left.pop()
        name = p.getClass().getSimpleName()
        if name == "BroadcastExchangeExec":
            most = max(most, p.metrics().apply("numOutputRows").value())
        inner = p.executedPlan() if name == "AdaptiveSparkPlanExec" else p.plan() if name.endswith("QueryStageExec") else None
        if inner is not None:
            left.append(inner)
        children = p.children()
        left += [children.apply(k) for k in range(children.size())]
    return most


def flat(spark, images: int, side: int):
    """Images of few bytes as Spark estimates them: a row an image, exploded into pixels."""
    at = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    px = spark.range(images).select(F.col("id").cast("int").alias("img")).withColumn("y", at).withColumn("x", at)
    return px.withColumn("m", (F.col("x") > side // 2).cast("int"))


def test_rays_are_not_broadcast(spark):
    """Steps of rays are many more than Spark estimates; what is broadcast has to stay as small as the images are few."""
    px = flat(spark, 6, 40).repartition("img").cache()
    pts = px.select("img").distinct().withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumns({"y": F.col("idx") * 3, "x": F.lit(2)})
    out = spatial.rays(px, "m", pts, 30)
    assert broadcast_rows(spark, out) <= 60
    assert {r["distance"] for r in out.where("angle = 0").collect()} == {19.0}


def test_filters_do_not_broadcast_grids(spark):
    px = flat(spark, 6, 40).repartition("img").withColumn("c", F.lit(1.0))
    grid = px.select("img").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("c", F.lit(1.0))
    out = filters.convolve(grid, "c", {"s": [(0, 0, 1.0), (0, 1, 1.0)]}).select("img", "y", "x", "s")
    assert broadcast_rows(spark, out) <= 6
    assert [tuple(r) for r in out.groupBy("s").count().collect()] == [(2.0, 6 * 1600)]


def test_superpixels_and_scaled_images_are_not_broadcast(spark):
    px = flat(spark, 6, 40).repartition("img").withColumn("c", F.lit(1.0)).cache()
    grid = px.select("img").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("c", F.lit(1.0))
    assert broadcast_rows(spark, segmentation.superpixels(grid, ["c"], 10, 10.0, rounds=1).select("img", "y", "x", "sp")) <= 6
    out = pixelwise.resized(px, ["c"], 20, 30)
    assert broadcast_rows(spark, out) <= 6
    assert out.where("abs(c - 1) < 1e-9").count() == 6 * 600


def test_rectangles_of_no_width_go_as_far_as_the_image(spark):
    """With lat on the axis, which pixels are drawn must not depend on the cells by which they meet."""
    px = flat(spark, 1, 100).select("img", "y", "x")
    a = spark.createDataFrame([(0, 3, 42.0, 53.0, 63.0, 65.0, 49.0, 57.0)], "img int, e int, ant_y double, ant_x double, post_y double, post_x double, lat_y double, lat_x double")
    y, x = np.mgrid[0:100, 0:100]
    along = (y - 42) * 21 + (x - 53) * 12
    got = {(r["y"], r["x"]) for r in pixelwise.draw_rectangles(px, a).collect()}
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero((along >= 0) & (along <= 585)))))


def test_balance_by_cells_of_near_rows(spark, monkeypatch):
    """With more clusters than a cell has rows: as many rows of each label as asked for, near to all rows."""
    monkeypatch.setattr(datasets, "CELL", 32, raising=False)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 3)) + (np.arange(700) % 5)[:, None] * 9
    rows = spark.createDataFrame([(k, int(k >= 300), v.tolist()) for k, v in enumerate(x)] + [(1000 + k, 1, [1.0, 2.0, 3.0]) for k in range(200)], "key long, label int, features array<double>")
    got = datasets.balance_by_kmeans(rows, "label", "key")
    made = {r["label"]: r["keys"] for r in got.groupBy("label").agg(F.collect_set("key").alias("keys")).collect()}
    assert len(made[0]) == 300 and 200 <= len(made[1]) <= 300
    near = np.array([k for k in made[1] if k < 1000])
    off = np.sqrt(((x[300:, None] - x[near][None]) ** 2).sum(axis=2)).min(axis=1)
    assert off.mean() < 0.6 and sum(k >= 1000 for k in made[1]) >= 1
    assert sorted(made[1]) == sorted(r["key"] for r in datasets.balance_by_kmeans(rows.repartition(3), "label", "key").where("label = 1").collect())


def test_filters_and_rasters_deal_rows_by_their_number(spark, monkeypatch, tmp_path):
    from pixelmill.operators import filters
    from pixelmill.sources import rasters

    px = spark.range(64 * 64).select(F.lit(0).alias("img"), (F.col("id") % 64).cast("int").alias("y"), F.floor(F.col("id") / 64).cast("int").alias("x"), (F.col("id") % 7).alias("c"), F.array("id").alias("more"))
    monkeypatch.setattr(filters, "TILE", 4)
    monkeypatch.setattr(filters, "TILES", 1)
    out = filters.convolve(px, "c", {"same": [(0, 0, 1.0)]})
    assert out.rdd.getNumPartitions() == 256 and "Join" not in out._jdf.queryExecution().executedPlan().toString().split("ArrowEvalPython")[0].split("FlatMapGroupsInArrow")[0]
    assert out.columns == [*px.columns, "same"] and out.where("same = c and more[0] % 7 = c").count() == 64 * 64
    spark.range(100).selectExpr("id as l_orderkey", "id as l_partkey", "id as l_suppkey", "1 as l_linenumber", "1 as l_quantity", "0.1 as l_discount", "0.1 as l_tax").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(rasters, "ROWS", 1)
    assert "hashpartitioning(img" in (plan := rasters.pixels(spark, str(tmp_path))._jdf.queryExecution().toString()) and ", 100), REPARTITION_BY_NUM" in plan


def test_rays_of_an_object_end_beside_it(spark):
    """An object of few pixels in a wide image, with a gap: steps beyond the pixels next to its box are not made."""
    from pixelmill.operators import spatial

    px = spark.range(200 * 200).select(F.lit(0).alias("img"), (F.col("id") % 200).cast("int").alias("y"), F.floor(F.col("id") / 200).cast("int").alias("x"))
    at = (F.col("y").between(50, 56) & F.col("x").between(100, 106) & ~((F.col("x") == 104) & (F.col("y") == 53))).cast("int")
    px = px.withColumn("m", F.when((F.col("x") >= 198) & (F.col("y") == 53), 2).otherwise(at))
    pts = spark.createDataFrame([(0, 1, 53, 103), (0, 2, 53, 103), (0, 9, 53, 103)], "img int, idx int, y int, x int")
    found = spatial.rays(px, "m", pts, 90, "down", own=True)
    got = {(r["idx"], r["angle"]): r["distance"] for r in found.collect()}
    assert [got[1, a] for a in (0, 90, 180, 270)] == [1.0, 4.0, 4.0, 4.0]
    assert got[2, 0] == -1.0 and got[2, 90] == -1.0 and got[9, 0] == -1.0 and len(got) == 12


def test_thinning_shuffles_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "Window", None)  # a window would shuffle each pair for both its ends
    monkeypatch.setattr(spatial, "POINTS", 20)
    rng = np.random.default_rng(3)
    p = [(k, int(y), int(x)) for k, (y, x) in enumerate(rng.integers(0, 30, (120, 2)))]
    got = {r["idx"] for r in spatial.thin_points(spark.createDataFrame([(0, *r) for r in p], "img int, idx long, y int, x int"), 4.0).collect()}
    left = dict((k, (y, x)) for k, y, x in p)
    while True:
        near = [((left[a][0] - left[b][0]) ** 2 + (left[a][1] - left[b][1]) ** 2, a, b) for a in left for b in left if a < b]
        d, _, b = min(near)
        if d >= 16:
            break
        del left[b]
    assert got == set(left)


def test_images_of_grown_shapes_do_not_wait_for_each_other(spark, monkeypatch):
    """Labels that come in turns of 1 to 5 are all the same as before only after 60 turns."""
    turns = []

    def grown(unary, edges, seeds, matrix, segment):
        turns.append({r[0] for r in unary.select("img").distinct().collect()})
        return unary.select("img", "lb").distinct().withColumn("label", ((len(turns) - 1) % (F.col("img") + 1) + 1).cast("int"))

    monkeypatch.setattr(segmentation, "grow_regions", grown)
    cells = [(i, s) for i in range(5) for s in range(4)]
    px = spark.createDataFrame([(i, 0, s, s) for i, s in cells], "img int, y int, x int, lb int")
    unary = spark.createDataFrame([(i, s, k, 0.0) for i, s in cells for k in range(6)], "img int, lb int, cls int, cost double")
    seeds = spark.createDataFrame([(i, 0, 1) for i in range(5)], "img int, lb int, label int")
    edges = graph.adjacency(px, "lb").withColumn("w", F.lit(1.0))
    table = spark.createDataFrame([(a, d, 0.5) for a in range(4) for d in range(4)], "a int, d int, p double")
    given = (px, unary, edges, seeds, graph.pairwise_matrix(6, 0.5), table, 4, 4)
    got = {(r["img"], r["lb"]): r["label"] for r in boundary.grow_shapes(*given).collect()}
    assert got == dict.fromkeys(cells, 1)
    assert turns == [set(range(5)), set(range(5)), {1, 2, 3, 4}, {2, 3, 4}, {3, 4}, {4}]
    turns.clear()
    with pytest.raises(RuntimeError, match="did not settle in 5 turns"):
        boundary.grow_shapes(*given, most=5)


def test_round_regions_have_no_direction(spark, monkeypatch):
    """Seeds of 5 x 5 pixels have equal deviations and no covariance; the last digits of their sums don't turn them."""
    angles = []
    real = boundary.shape_costs
    monkeypatch.setattr(boundary, "shape_costs", lambda segments, objects, *a: (angles.append({r["angle"] for r in objects.collect()}), real(segments, objects, *a))[1])
    px = spark.range(3 * 100 * 100).repartition(7).select((F.col("id") % 3).cast("int").alias("img"), F.floor(F.col("id") / 3 % 100).cast("int").alias("y"), F.floor(F.col("id") / 300).cast("int").alias("x"))
    px = px.withColumn("lb", (F.floor(F.col("y") / 5) * 20 + F.floor(F.col("x") / 5)).cast("int"))
    unary = px.select("img", "lb").distinct().crossJoin(spark.createDataFrame([(k, 1.0 - (k == 0)) for k in range(4)], "cls int, cost double"))
    seeds = spark.createDataFrame([(i, s + i, k + 1) for i in range(3) for k, s in enumerate((143, 211, 376))], "img int, lb int, label int")
    table = spark.createDataFrame([(a, d, 0.5) for a in range(4) for d in range(4)], "a int, d int, p double")
    edges = graph.adjacency(px, "lb").withColumn("w", F.lit(1.0))
    boundary.grow_shapes(px, unary, edges, seeds, graph.pairwise_matrix(4, 0.5), table, 4, 4)
    assert angles[0] == {0}
