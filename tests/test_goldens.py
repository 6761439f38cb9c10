"""Small cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from pixelmill.functions import color
from pixelmill.operators import datasets, features, graph, labels, metrics, ml, segmentation, spatial


def raster(spark, rows, names="v"):
    """Pixels (img, y, x, names...) of nested lists, one list a name."""
    names = names.split()
    layers = [rows] if len(names) == 1 else rows
    data = [(0, y, x, *[layer[y][x] for layer in layers]) for y in range(len(layers[0])) for x in range(len(layers[0][0]))]
    kind = "double" if isinstance(layers[0][0][0], float) else "int"
    return spark.createDataFrame(data, "img int, y int, x int, " + ", ".join(f"{n} {kind}" for n in names))


def line(a, b, v, n=10):
    return [v if a <= x < b else 0 for x in range(n)]


def test_colour_statistics(spark):
    px = raster(spark, [[line(2, 6, 1)] * 2, [line(3, 7, 3)] * 2, [line(4, 9, 2)] * 2, [[0] * 5 + [1] * 5] * 2], "c1 c2 c3 lb")
    got = {r["lb"]: r for r in features.segment_statistics(px, "lb", ["c1", "c2", "c3"], ("mean", "energy", "std")).collect()}
    want = {"mean": [[0.6, 1.2, 0.4], [0.2, 1.2, 1.6]], "energy": [[0.6, 3.6, 0.8], [0.2, 3.6, 3.2]], "std": [[0.49, 1.47, 0.8], [0.4, 1.47, 0.8]]}
    for s, table in want.items():
        for k, row in enumerate(table):
            assert [got[k][f"c{c}_{s}"] for c in (1, 2, 3)] == pytest.approx(row, abs=0.005)


def test_colour_median_and_missing_values(spark):
    px = raster(spark, [[line(2, 6, 1)] * 2, [line(3, 8, 3)] * 2, [line(4, 9, 2)] * 2, [[0] * 4 + [2] * 6] * 2], "c1 c2 c3 lb")
    got = features.segment_statistics(px, "lb", ["c1", "c2", "c3"], ("median",), dense=True).orderBy("lb").collect()
    assert [tuple(r)[2:] for r in got] == [(0.5, 0, 0), (0, 0, 0), (0, 3, 2)]
    odd = spark.createDataFrame([(0, 0, 0, float("nan"), 0), (0, 0, 1, None, 0), (0, 0, 2, 3.0, 0), (0, 0, 3, 9.0, -1)], "img int, y int, x int, v double, lb int")
    assert features.segment_statistics(odd, "lb", ["v"], ("mean",)).first()["v_mean"] == 1.0
    with pytest.raises(ValueError):
        features.segment_statistics(px, "lb", ["c1"], ("mode",))


def test_volume_statistics(spark):
    rows = [(0, z, y, x, (1 if z == 0 and 2 <= x < 6 else 3 if z == 1 and 3 <= x < 7 else 0), 2 * z + (x >= 4)) for z in range(2) for y in range(3) for x in range(8)]
    vol = spark.createDataFrame(rows, "img int, z int, y int, x int, v int, lb int")
    got = features.segment_statistics(vol, "lb", ["v"], ("mean", "energy", "std", "median")).orderBy("lb").collect()
    assert [r["v_mean"] for r in got] == [0.5, 0.5, 0.75, 2.25] and [r["v_energy"] for r in got] == [0.5, 0.5, 2.25, 6.75]
    assert [r["v_std"] for r in got] == pytest.approx([0.5, 0.5, 1.299, 1.299], abs=0.001) and [r["v_median"] for r in got] == [0.5, 0.5, 0, 3]


def test_gradient(spark):
    px = raster(spark, [[[0, 1, 4, 9]] * 2, [[0, 0, 1, 1]] * 2], "v lb")
    assert [r["v_meanGrad"] for r in features.segment_statistics(px, "lb", ["v"], ("meanGrad",)).orderBy("lb").collect()] == [1.5, 4.5]


def test_histogram_assign_and_purity(spark):
    px = raster(spark, [[[0, 0, 0, 1, 1, 3]], [[2, 2, 0, 1, 0, 1]]], "sp lb")
    assert {(r["sp"], r["lb"]): r["n"] for r in labels.histogram_counts(px, "sp", "lb").collect() if r["n"]} == {(0, 2): 2, (0, 0): 1, (1, 1): 1, (1, 0): 1, (3, 1): 1}
    assert labels.histogram_counts(px, "sp", "lb").count() == 12
    assert labels.histogram_norm(px, "sp", "lb").where("sp = 2").agg(F.sum("ratio")).first()[0] == 0
    best = {r["sp"]: r["lb"] for r in labels.assign_by_max(px, "sp", "lb").collect()}
    assert best == {0: 2, 1: 0, 3: 1}
    assert {r["sp"]: r["lb"] for r in labels.assign_by_threshold(px, "sp", "lb", 0.5).collect()} == {0: 2, 1: -1, 3: 1}
    assert {r["sp"]: r["lb"] for r in labels.purity_filter(labels.assign_by_max(px, "sp", "lb"), "lb", 0.5).collect()} == best


def test_relabel_unique_is_greedy(spark):
    ref = [[0, 0, 0, 0, 1, 1, 1, 2, -1]]
    est = [[1, 1, 1, 2, 2, 2, 1, 0, 0]]
    got = labels.relabel_unique(raster(spark, [ref, est], "ref est"), "ref", "est").orderBy("x").collect()
    assert [r["new"] for r in got] == [0, 0, 0, 1, 1, 1, 0, 2, 2]


def test_contour_and_distance(spark):
    seg = [[1 if 1 <= y < 5 and x >= 2 else 0 for x in range(6)] for y in range(6)]
    px = raster(spark, seg, "lb")
    inner = {(r["y"], r["x"]) for r in labels.contour(px, "lb", 1).where("contour = 1").collect()}
    assert inner == {(1, 2), (2, 2), (3, 2), (4, 2), (1, 3), (1, 4), (4, 3), (4, 4)}
    edge = {(r["y"], r["x"]) for r in labels.contour(px, "lb", 1, True).where("contour = 1").collect()}
    assert edge == inner | {(y, 5) for y in range(1, 5)}
    far = labels.distance_to(labels.contour(px, "lb", 1), "contour").where("y = 0 and x = 0").first()["d2"]
    assert far == 5


def test_background_swap_and_sequence(spark):
    px = raster(spark, [[2, 2, 2, 2], [2, 0, 1, 2], [2, 2, 2, 2]], "lb")
    assert [r["lb"] for r in labels.background_on_border(px, "lb").where("y = 1").orderBy("x").collect()] == [0, 2, 1, 0]
    stack = raster(spark, [[1, 1, 0, 2]], "lb").union(raster(spark, [[1, 2, 2, 0]], "lb"))
    assert [r["label"] for r in labels.sequence_merge(stack, "lb", [0]).orderBy("x").collect()] == [1, -1, 2, 2]


def test_merge_probabilities(spark):
    p = spark.createDataFrame([(0, 0, 0, 0.3), (0, 0, 1, 0.4), (0, 0, 2, 0.2)], "y int, x int, cls int, p double")
    assert {r["cls"]: r["p"] for r in labels.merge_probabilities(p, {0: [1, 2], 1: [0]}).collect()} == pytest.approx({0: 0.6, 1: 0.3})


def test_graph(spark):
    px = raster(spark, [[0, 0, 1, 1, 1], [2, 2, 2, 3, 3]], "lb")
    edges = graph.adjacency(px, "lb")
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)}
    e = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 1, 3), (0, 2, 3)], "img int, src int, dst int")
    assert [r["neighbours"] for r in graph.neighbour_lists(e).orderBy("segment").collect()] == [[1], [0, 2, 3], [1, 3], [1, 2]]
    d = graph.spatial_distance(edges, features.centroids(px, "lb"), "lb").where("src = 0 and dst = 2").first()["distance"]
    assert d == pytest.approx(math.sqrt(1 + 0.25))
    w = graph.edge_weights(edges, "spatial", centres=features.centroids(px, "lb")).agg(F.avg(1 / F.col("w"))).first()[0]
    assert w == pytest.approx(1)
    assert graph.pairwise_matrix(3, 0.2) == [[0, 0.2, 0.2], [0.2, 0, 0.2], [0.2, 0.2, 0]]
    assert graph.pairwise_matrix(2, [((0, 1), 0.7)]) == [[0, 0.7], [0.7, 0]] and graph.pairwise_matrix(2, [[1.0, 2.0], [3.0, 1.0]]) == [[0, 1], [2, 0]]
    sp = spark.createDataFrame([(0, k, v) for k, v in enumerate([0, 0, 1, 1])], "img int, lb int, label int")
    t = {(r["l1"], r["l2"]): r["n"] for r in graph.transitions(edges, sp, "lb", "label").collect()}
    assert t == {(0, 0): 1, (1, 1): 1, (0, 1): 3, (1, 0): 3}
    p = {(r["src"], r["dst"]): r["cost"] for r in graph.pairwise_penalty(edges, sp, "lb", "label").collect()}
    assert p[0, 1] == 0 and p[0, 2] == pytest.approx(-math.log(0.05))
    comp = graph.components(e.where("src = 1 and dst = 2 or src = 2"), spark.createDataFrame([(0, k) for k in range(5)], "img int, node int"))
    assert {r["node"]: r["component"] for r in comp.collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4}


def test_edge_models(spark):
    sp = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.5, 0.5]), (0, 2, [0.0, 1.0])], "img int, lb int, proba array<double>")
    e = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 1, 2)], "img int, src int, dst int")
    for kind, d in (("model_l1", [1, 2, 1]), ("model_l2", [math.sqrt(0.5), math.sqrt(2), math.sqrt(0.5)]), ("model_lT", [0.25, 1, 0.25])):
        m = sum(d) / 3
        v = sum((x - m) ** 2 for x in d) / 3
        got = [r["w"] for r in graph.edge_weights(e, kind, sp).orderBy("src", "dst").collect()]
        assert got == pytest.approx([max(1e-3, math.exp(-x / (2 * v))) for x in d])
    with pytest.raises(ValueError):
        graph.edge_weights(e, "model")


def test_regularise_smooths_and_never_costs_more(spark):
    n = 6
    seg = [[y * n + x for x in range(n)] for y in range(n)]
    px = raster(spark, seg, "lb")
    edges = graph.adjacency(px, "lb").withColumn("w", F.lit(1.0))
    noisy = {8, 27}
    rows = [(0, k, c, graph_cost(0.8 if ((k % n >= 3) != (k in noisy)) == bool(c) else 0.2)) for k in range(n * n) for c in (0, 1)]
    unary = spark.createDataFrame(rows, "img int, lb int, cls int, cost double")
    matrix = graph.pairwise_matrix(2, 0.8)
    got = graph.regularise(unary, edges, matrix)
    assert all((r["label"] == 1) == (r["lb"] % n >= 3) for r in got.collect())
    plain = graph.best_labels(unary, ["img", "lb"])
    assert graph.energy(unary, edges, got, matrix).first()["energy"] < graph.energy(unary, edges, plain, matrix).first()["energy"]
    assert {r["lb"] for r in plain.collect() if (r["label"] == 1) != (r["lb"] % n >= 3)} == noisy


def graph_cost(p):
    return -math.log(p)


def test_metrics(spark):
    px = raster(spark, [[[0] * 4 + [1] * 6], [[0, 0, 0, 1, 1, 1, 1, 1, 0, 1]]], "t p")
    r = metrics.tp_tn_fp_fn(px, "t", "p").first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"]) == (5, 3, 1, 1) and r["fpfn_tpfn"] == pytest.approx(2 / 6)
    one = raster(spark, [[[7] * 5], [[7] * 5]], "t p")
    assert tuple(metrics.tp_tn_fp_fn(one, "t", "p").first())[1:5] == (5, 0, 0, 0) and metrics.adjusted_rand(one, "t", "p").first()["ars"] == 1.0
    many = raster(spark, [[[0, 1, 2]], [[0, 1, 1]]], "t p")
    assert metrics.tp_tn_fp_fn(many, "t", "p").first()["tp"] is None
    a = metrics.averages(many, "t", "p").first()
    assert a["accuracy"] == pytest.approx(2 / 3) and a["precision_macro"] == pytest.approx(0.5)
    assert {x["label"]: x["jaccard"] for x in metrics.jaccard(many, "t", "p").collect()} == {0: 1, 1: 0.5, 2: 0}
    s = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, s double")
    assert [tuple(x) for x in metrics.roc(s, "y", "s").collect()] == [(0.9, 0.5, 0.0), (0.8, 1.0, 0.5), (0.1, 1.0, 1.0)]


def test_main_axis(spark):
    for pts, want in (([(0, k) for k in range(5)], 0), ([(k, 0) for k in range(5)], 90), ([(k, k) for k in range(5)], 45), ([(k, -k) for k in range(5)], 135)):
        px = spark.createDataFrame([(0, 0, y, x) for y, x in pts], "img int, s int, y int, x int")
        assert features.main_axis(px, "s").first()["theta"] % 180 == want


def test_disk_histogram(spark):
    seg = [[2 if 3 <= y < 8 and 3 <= x < 8 else 1 if 1 <= y < 9 and 1 <= x < 9 else 0 for x in range(10)] for y in range(10)]
    pts = spark.createDataFrame([(0, 7, 4, 4)], "img int, idx int, y int, x int")
    got = {(r["radius"], r["lb"]): r["n"] for r in features.disk_histogram(raster(spark, seg, "lb"), "lb", pts, [1, 2], rings=False).collect()}
    assert got == {(1, 2): 5, (2, 2): 11, (2, 1): 2}
    ring = {(r["radius"], r["lb"]): (r["n"], r["size"]) for r in features.disk_histogram(raster(spark, seg, "lb"), "lb", pts, [1, 2]).collect()}
    assert ring == {(1, 2): (5, 5), (2, 2): (6, 8), (2, 1): (2, 8)}


def test_points(spark):
    pts = spark.createDataFrame([(0, k, float(k), float(k)) for k in range(10)], "img int, idx int, y double, x double")
    assert [r["idx"] for r in spatial.thin_points(pts, 2).orderBy("idx").collect()] == [0, 2, 4, 6, 8]
    c = spatial.cluster_points(pts.where("idx <> 4"), 1.5).orderBy("cluster").collect()
    assert [(r["cluster"], r["n"], r["y"]) for r in c] == [(0, 4, 1.5), (5, 5, 7.0)]
    info = spark.createDataFrame([(1, 1, 10, 2), (2, 1, 12, 3), (3, 1, 13, 4), (4, 2, 10, 2), (5, 1, 10, 5)], "id int, stack int, slice_index int, stage int")
    near = {(r["id"], r["near"]) for r in spatial.slice_groups(info, [2, 3, 4]).collect()}
    assert near == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 2), (3, 3), (4, 4)}


def test_ellipse(spark):
    px = raster(spark, [[0] * 60 for _ in range(50)], "v")
    el = spark.createDataFrame([(0, 0, 24.0, 30.0, 18.0, 9.0, 0.4)], "img int, e int, cy double, cx double, a double, b double, theta double")
    drawn = spatial.draw_ellipses(px, el)
    assert drawn.count() == pytest.approx(math.pi * 18 * 9, rel=0.02)
    t = [2 * math.pi * k / 40 for k in range(40)]
    pts = [(0, 24 + 18 * math.cos(u) * math.sin(0.4) + 9 * math.sin(u) * math.cos(0.4), 30 + 18 * math.cos(u) * math.cos(0.4) - 9 * math.sin(u) * math.sin(0.4)) for u in t]
    fit = spatial.ellipse_from_points(spark.createDataFrame(pts, "img int, y double, x double"), ["img"]).first()
    assert [fit[k] for k in ("cy", "cx", "a", "b")] == pytest.approx([24, 30, 18, 9]) and fit["theta"] % math.pi == pytest.approx(0.4)
    w = spark.createDataFrame([(0, 0, 24, 30, 1, 2.0), (0, 1, 0, 0, 1, 1.0), (0, 2, 24, 31, 0, 1.0)], "img int, idx int, y int, x int, label int, weight double")
    assert spatial.criterion(w, el, (0.1, 0.9)).first()["crit"] == pytest.approx(2 * math.log(0.1 / 0.9) + math.log(9))


def test_rays_and_shift(spark):
    px = raster(spark, [[1 if (y - 20) ** 2 + (x - 20) ** 2 <= 100 else 0 for x in range(41)] for y in range(41)], "m")
    pts = spark.createDataFrame([(0, 0, 20, 20), (0, 1, 20, 2)], "img int, idx int, y int, x int")
    down = {(r["idx"], r["angle"]): r["distance"] for r in spatial.rays(px, "m", pts, 90, "down").collect()}
    assert all(down[0, a] == 11 for a in (0, 90, 180, 270)) and down[1, 0] == 29 and down[1, 90] == -1
    up = {(r["idx"], r["angle"]): r["distance"] for r in spatial.rays(px, "m", pts, 90).collect()}
    assert up[0, 0] == 0 and up[1, 0] == 8 and up[1, 180] == -1
    a = spark.createDataFrame([([1.0, 5.0, 2.0, 3.0],)], "d array<double>")
    assert a.select(spatial.shifted_to_longest("d")).first()[0] == [5, 2, 3, 1]


def test_colours(spark):
    px = spark.createDataFrame([(0, 0, 0, 1.0, 0.0, 0.0), (0, 0, 1, 0.2, 0.4, 0.4), (0, 0, 2, 1.0, 1.0, 1.0)], "img int, y int, x int, r double, g double, b double")
    hsv = [tuple(x)[3:] for x in color.convert(px, ["r", "g", "b"], "hsv").orderBy("x").collect()]
    assert hsv[0] == (0, 1, 1) and hsv[1] == pytest.approx((0.5, 0.5, 0.4)) and hsv[2] == (0, 0, 1)
    lab = [tuple(x)[3:] for x in color.convert(px, ["r", "g", "b"], "lab").orderBy("x").collect()]
    assert lab[0] == pytest.approx((53.24, 80.09, 67.2), abs=0.05) and lab[2] == pytest.approx((100, 0, 0), abs=0.02)
    q = raster(spark, [[[10, 90, 51]], [[0, 0, 0]]], "a b")
    assert [r["a"] for r in color.quantize(q, [(0, 0), (100, 0)], ["a", "b"]).orderBy("x").collect()] == [0, 100, 100]
    with pytest.raises(Exception, match="palette"):
        color.colors_to_labels(q, spark.createDataFrame([(10, 0, 1)], "a int, b int, label int"), ["a", "b"], strict=True).collect()


def test_datasets(spark):
    rows = spark.createDataFrame([(k, 0 if k < 30 else 1, k % 4) for k in range(40)], "id long, label int, img int")
    got = datasets.balance(rows, "label", "id")
    assert {r["label"]: r["n"] for r in datasets.sizes(got, [], "label").collect()} == {0: 10, 1: 10} and got.select("id").distinct().count() == 20
    assert {r["n"] for r in datasets.sizes(datasets.balance(rows, "label", "id", ("img",)), ["img"], "label").collect()} == {2, 3}
    assert datasets.fold_table(5, 2) == [[0, 1], [2, 3], [4, 0]]
    a, b = datasets.hold_out(rows, "id", 0.3)
    assert a.count() + b.count() == 40 and 0 < b.count() < 30


def test_otsu_and_prior(spark):
    v = spark.createDataFrame([(0, float(x)) for x in [1, 2, 2, 3, 10, 11, 12, 11]], "img int, v double")
    assert 2.9 < ml.otsu(v, ["img"], "v").first()["threshold"] < 10
    table = spark.createDataFrame([(a, d, float(d)) for a in range(4) for d in range(5)], "a int, d int, p double")
    pts = spark.createDataFrame([(3.0, 0.0), (0.0, -2.5), (9.0, 9.0), (0.0, 0.0)], "dx double, dy double")
    assert [r["prior"] for r in ml.shape_prior(pts, table, 4, 5).orderBy("dx", "dy").collect()] == pytest.approx([2.5, 0, 3, 4])


def test_superpixels_cover_the_image(spark):
    px = raster(spark, [[0 if x < 13 else 100 for x in range(24)] for _ in range(20)], "c1")
    sp = segmentation.superpixels(px, ["c1"], 8, 10.0, rounds=3)
    assert sp.count() == 480 and 4 <= sp.select("sp").distinct().count() <= 9
    assert sp.groupBy("sp").agg(F.countDistinct("c1").alias("n")).agg(F.max("n")).first()[0] == 1


def test_grow_and_filter(spark):
    px = raster(spark, [[y * 5 + x for x in range(5)] for y in range(5)], "lb")
    edges = graph.adjacency(px, "lb").withColumn("w", F.lit(0.1))
    inside = {6, 7, 8, 11, 12, 13}
    unary = spark.createDataFrame([(0, k, c, (0.1 if (k in inside) == bool(c) else 2.0)) for k in range(25) for c in (0, 1)], "img int, lb int, cls int, cost double")
    seeds = spark.createDataFrame([(0, 7, 1)], "img int, lb int, label int")
    got = segmentation.grow_regions(unary, edges, seeds, graph.pairwise_matrix(2, 1.0), "lb")
    assert {r["lb"] for r in got.collect() if r["label"] == 1} == inside
    v = raster(spark, [[1.0, 2.0, 4.0]], "v")
    out = segmentation.filter_response(v, "v", [(0, -1, -1.0), (0, 1, 1.0)]).orderBy("x").collect()
    assert [r["response"] for r in out] == [1, 3, 2]
    m = raster(spark, [[0, 0, 0, 0, 0, 0], [0, 1, 1, 1, 0, 1], [0, 1, 1, 1, 0, 0], [0, 1, 1, 1, 0, 0], [0, 0, 0, 0, 0, 0]], "m")
    assert {(r["y"], r["x"]) for r in segmentation.opened(m, "m", 1).where("m = 1").collect()} == {(2, 2), (1, 2), (3, 2), (2, 1), (2, 3)}


def test_models(spark):
    import random

    rng = random.Random(1)
    rows = spark.createDataFrame([(k, k % 3, [k % 3 * 5 + rng.gauss(0, 0.3), rng.gauss(0, 0.3), k % 3 + rng.gauss(0, 0.1)]) for k in range(150)], "id long, label int, features array<double>")
    for name in ("random forest", "decision tree", "logistic regression", "naive Bayes"):
        assert ml.probabilities(ml.train(rows, name), rows).where("prediction = label").count() > 140
    best = ml.search(rows, "decision tree", {"maxDepth": [1, 4]}, folds=2)
    assert max(best.avgMetrics) > 0.9
    f = {r["feature"]: r["f_score"] for r in ml.feature_scores(rows, "label").collect()}
    assert f[0] > f[2] > f[1]


def test_rounds_that_do_not_settle_are_an_error(spark):
    pts = spark.createDataFrame([(0, k, 0.0, k + 0.001 * k * k) for k in range(8)], "img int, idx int, y double, x double")
    with pytest.raises(RuntimeError):
        spatial.thin_points(pts, 1.5, rounds=1)
    chain = spark.createDataFrame([(0, k, k + 1) for k in range(8)], "img int, src int, dst int")
    with pytest.raises(RuntimeError):
        graph.components(chain, spark.createDataFrame([(0, k) for k in range(9)], "img int, node int"), rounds=1)
