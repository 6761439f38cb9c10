import numpy as np
import pytest

from pixelmill.operators import bayes, labels, neighbours


def test_digamma():
    x = np.array([0.01, 0.5, 1.0, 2.0, 7.3, 1e4])
    h = 1e-5
    want = (bayes._lgamma(x * (1 + h)) - bayes._lgamma(x * (1 - h))) / (2 * x * h)
    assert np.allclose(bayes.digamma(x), want, rtol=1e-6, atol=1e-6)
    assert abs(bayes.digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-10


@pytest.mark.parametrize("live", [2, 3])
def test_live_components_and_bound(spark, live):
    """Of six components as many live as there are clusters; the bound never falls; rows fall to their cluster."""
    rng = np.random.default_rng(5)
    middle = np.array([[0.0, 0.0], [12.0, 3.0], [-4.0, 15.0]])[:live]
    of = np.arange(240) % live
    x = middle[of] + rng.normal(size=(240, 2)) @ [[1.0, 0.4], [0.0, 0.7]] + 1000
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, features array<double>").repartition(3)
    model = bayes.fit(rows, 6)
    assert model.settled and len(model.alpha) == live
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(model.bounds, model.bounds[1:]))
    got = {r["id"]: r for r in bayes.probabilities(model, rows).collect()}
    pairs = {(of[k], r["prediction"]) for k, r in got.items()}
    assert len(pairs) == live and all(abs(sum(r["proba"]) - 1) < 1e-9 for r in got.values())
    for j in range(live):
        mine = x[of == j].mean(axis=0)
        assert np.abs(model.mean - mine).max(axis=1).min() < 0.3


def test_nearest_like_brute_force(spark, monkeypatch):
    """With duplicates, ties, far queries, few pivots, blocks of few rows: the same as all distances."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(8)
    x = rng.integers(0, 6, (150, 3)).astype(float)
    q = np.vstack([rng.integers(0, 6, (40, 3)), [[100.0, 0, 0]]]).astype(float)
    rows = spark.createDataFrame([(k * 7, v.tolist()) for k, v in enumerate(x)] + [(-1, None), (-2, [1.0, None, 2.0])], "id long, features array<double>")
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "id long, features array<double>")
    for pivots in (1, 7):
        got = {}
        for r in neighbours.nearest(queries, rows, 6, pivots).collect():
            got.setdefault(r["query"], {})[r["place"]] = (r["id"], r["distance"])
        for k, v in enumerate(q):
            d = ((x - v) ** 2).sum(axis=1)
            want = sorted((a, i * 7) for i, a in enumerate(d))[:6]
            assert [got[k][p] for p in range(1, 7)] == [(i, pytest.approx(np.sqrt(a))) for a, i in want]
    own = {(r["query"], r["place"]): r["id"] for r in neighbours.nearest(rows, rows, 2, 7, among=True).collect()}
    for k, v in enumerate(x):
        d = ((x - v) ** 2).sum(axis=1)
        assert [own[k * 7, p] for p in (1, 2)] == [i * 7 for _, i in sorted((a, i) for i, a in enumerate(d) if i != k)[:2]]
    assert neighbours.nearest(queries, rows.limit(0), 3).count() == 0
    assert neighbours.nearest(queries, rows.where("id = 7"), 3).count() == len(q)


def test_merged_masks(spark):
    def masks(*arrays):
        return spark.createDataFrame([(0, i, y, x) for i, a in enumerate(arrays) for y, x in np.argwhere(a).tolist()], "img int, idx int, y int, x int")

    def drawn(*arrays, **more):
        out = np.zeros(arrays[0].shape, int)
        for r in labels.merge_masks(masks(*arrays), **more).collect():
            out[r["y"], r["x"]] = r["label"]
        return out

    a, b = np.zeros((5, 6), bool), np.zeros((5, 6), bool)
    a[:4, :4], b[2:, 2:] = True, True
    assert (drawn(a, a) == a).all()
    assert (drawn(a, b) == np.where(b, 2, a)).all()
    rng = np.random.default_rng(3)
    many = []
    for _ in range(12):
        y, x, h, w = rng.integers(0, 8), rng.integers(0, 8), rng.integers(2, 8), rng.integers(2, 8)
        m = np.zeros((14, 14), bool)
        m[y : y + h, x : x + w] = True
        many.append(m)
    want = np.zeros((14, 14), int)
    skipped = 0
    for m in many:
        if any((m & (want == j)).sum() > 0.3 * (m | (want == j)).sum() for j in range(1, want.max() + 1)):
            skipped += 1
        else:
            want[m] = want.max() + 1
    assert skipped and (drawn(*many, overlap=0.3) == want).all()


def rings(spark, n, seed):
    rng = np.random.default_rng(seed)
    of, angle = np.arange(n) % 2, rng.uniform(0, 2 * np.pi, n)
    r = np.where(of, 3.0, 1.0) + rng.normal(size=n) * 0.2
    return spark.createDataFrame([(k, [float(a * np.cos(t)), float(a * np.sin(t))], int(c)) for k, (a, t, c) in enumerate(zip(r, angle, of))], "id int, features array<double>, label int")


def accuracy(made):
    from pyspark.sql import functions as F

    return made.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def test_boosting(spark):
    """The training error is within the bound that the trees' errors give, and held-out rings are told apart by boxes."""
    from pixelmill.operators import ensembles

    train, held = rings(spark, 300, 1), rings(spark, 200, 2)
    model = ensembles.boost(train, 12, 2)
    bound = np.prod([2 * np.sqrt(e * (1 - e)) for e in model.errors])
    assert 1 - accuracy(ensembles.boosted_predictions(model, train)) <= bound + 1e-9 and len(model.trees) > 3
    assert accuracy(ensembles.boosted_predictions(model, held)) > 0.95
    three = spark.createDataFrame([(k, [float(k % 30 // 10), 0.0], k % 30 // 10) for k in range(90)], "id int, features array<double>, label int")
    assert accuracy(ensembles.boosted_predictions(ensembles.boost(three, 10, 1), three)) == 1.0
    same = train.selectExpr("id", "features", "0 AS label")
    assert accuracy(ensembles.boosted_predictions(ensembles.boost(same, 3), same)) == 1.0


def test_kernel_machine(spark):
    """Held-out rings, which no line parts, and the random features' products against the kernel."""
    from pixelmill.operators import ensembles

    train, held = rings(spark, 300, 1), rings(spark, 200, 2)
    model = ensembles.kernel_machine(train, 1.0)
    assert accuracy(ensembles.kernel_predictions(model, held)) > 0.97
    by = model[0]
    x = np.array([r["features"] for r in held.limit(60).collect()])
    z = (x - by.mean) / by.std
    exact = np.exp(-((z[:, None] - z[None]) ** 2).sum(axis=2))
    off = np.abs(by.of(x) @ by.of(x).T - exact)
    assert off.mean() < 0.08 and off.max() < 0.35


def test_random_search(spark):
    """Draws repeat, lie in the space and get fewer from round to round; depth tells, so a deep tree wins."""
    import json

    from pixelmill.operators import ml

    space = {"maxDepth": (1, 6), "impurity": ["gini", "entropy"], "minInfoGain": (1e-6, 1e-2, "log")}
    drawn = ml.draw_params(space, 20, 3)
    assert drawn == ml.draw_params(space, 20, 3) != ml.draw_params(space, 20, 4) and len({repr(d) for d in drawn}) == 20
    assert all(1 <= d["maxDepth"] <= 6 and 1e-6 <= d["minInfoGain"] <= 1e-2 for d in drawn) and len(ml.draw_params({"maxDepth": [2, 3]}, 5)) == 2
    got = ml.random_search(rings(spark, 240, 4), "decision tree", space, 6, folds=2, keep=3).collect()
    assert [sum(r["round"] == k for r in got) for k in (0, 1)] == [6, 2] and {r["share"] for r in got if r["round"] == 1} == {1.0}
    assert got[0]["round"] == 1 and got[0]["score"] == max(r["score"] for r in got if r["round"] == 1) and json.loads(got[0]["params"])["maxDepth"] > 1


def test_blocks_of_neighbours_are_measured_by_products(monkeypatch):
    """The same neighbours as by all differences, with ties, copies and vectors far from 0; only a few are measured by differences."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    b = np.vstack([rng.normal(size=(400, 8)), np.repeat(rng.normal(size=(4, 8)), 20, axis=0)]) + 1e5
    ids = rng.permutation(len(b)).astype(np.int64)
    lists = lambda x: pa.array(list(x), pa.list_(pa.float64()))
    whole, measured = neighbours._distances, []
    monkeypatch.setattr(neighbours, "_distances", lambda x, y: measured.append(1) or whole(x, y))
    got = neighbours._nearest(5, True)(pa.table({"q": ids, "v": lists(b)}), pa.table({"r": ids, "w": lists(b)}))
    assert not measured
    found = {}
    for q, r, d in zip(*(got.column(c).to_pylist() for c in ("q", "r", "d2"))):
        found.setdefault(q, []).append((d, r))
    d = ((b[:, None] - b[None]) ** 2).sum(axis=2)
    for k, one in enumerate(ids):
        assert found[one] == sorted((x, i) for x, i in zip(d[k], ids) if i != one)[:5]


def test_kernel_machines_are_fitted_together(spark, monkeypatch):
    from pixelmill.operators import ensembles

    seen, real = [], ensembles.OneVsRest
    monkeypatch.setattr(ensembles, "OneVsRest", lambda **given: seen.append(given.get("parallelism", 1)) or real(**given))
    rows = spark.createDataFrame([([float(k % 3), float(k % 3 * 2)], k % 3) for k in range(30)], "features array<double>, label int")
    got = ensembles.kernel_predictions(ensembles.kernel_machine(rows), rows).select("label", "prediction").collect()
    assert seen[0] > 1 and all(r["label"] == r["prediction"] for r in got)


def test_mixture_rounds_have_partitions_for_their_rows(spark, monkeypatch):
    from pixelmill.operators import bayes

    parts, real = [], bayes._sums
    monkeypatch.setattr(bayes, "_sums", lambda rows, *rest: parts.append(rows.rdd.getNumPartitions()) or real(rows, *rest))
    rows = spark.createDataFrame([([(k % 2) * 9.0 + k % 7 * 0.1],) for k in range(200)], "features array<double>").repartition(8)
    whole = bayes.fit(rows, 3)
    monkeypatch.setattr(bayes, "SUMS", 0)  # grouped sums
    grouped = bayes.fit(rows, 3)
    assert set(parts) == {1} and len(whole.mean) == len(grouped.mean) == 2
    assert whole.bounds == pytest.approx(grouped.bounds)
