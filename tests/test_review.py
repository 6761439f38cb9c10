import math

import pytest

from pixelmill.operators import review


@pytest.fixture
def px(spark):
    """Two objects in a row of eight pixels, each with two segments."""
    rows = [(0, 0, x, (0, 1, 1, 1, 0, 2, 2, 0)[x], x // 2) for x in range(8)]
    return spark.createDataFrame(rows, "img int, y int, x int, v int, lb int")


def test_review(spark, px):
    points = spark.createDataFrame([(0, 1, 0.0, 2.9, 1), (0, 2, 0.2, 4.1, 1), (0, 3, 9.0, 9.0, 1)], "img int, idx int, y double, x double, label int")
    cleared = review.clear_false_positives(points, px, "v")
    assert {r["idx"]: (r["label"], r["change"]) for r in cleared.collect()} == {1: (1, 0), 2: (0, 1), 3: (0, 1)}
    out = {r["idx"]: (r["y"], r["x"], r["label"], r["change"]) for r in review.add_missed_objects(cleared, px, "v").collect()}
    assert out[4] == (0.0, 5.5, 1, 1) and len(out) == 4
    every = review.add_missed_objects(cleared.limit(0), px, "v").collect()
    assert sorted((r["idx"], r["x"]) for r in every) == [(1, 2.0), (2, 5.5)]


def test_centres_hold_their_segments(spark, px):
    segments = spark.createDataFrame([(0, k, p, 0) for k, p in enumerate((0.0, 0.25, None, 1.0))], "img int, lb int, proba double, label int")
    centres = spark.createDataFrame([(0, 1, 0.0, 2.0), (0, 2, 0.0, 3.0), (0, 3, 0.0, 99.0)], "img int, label int, y double, x double")
    costs, held = review.centre_costs(segments, px, centres)
    assert {r["lb"]: r["label"] for r in held.collect()} == {0: 0, 1: 2, 2: 0, 3: 0}
    got = {(r["lb"], r["cls"]): r["cost"] for r in costs.collect()}
    assert len(got) == 16
    assert got[1, 0] == pytest.approx(-math.log(0.75), abs=1e-8) and got[1, 3] == pytest.approx(-math.log(0.25), abs=1e-8)
    assert got[2, 1] == pytest.approx(math.log(2), abs=1e-8) and got[0, 2] == pytest.approx(-math.log(1e-9))


def test_method_scores(spark, px):
    good = px.selectExpr("img", "'same' AS method", "y", "x", "v", "case v when 1 then 7 when 2 then 9 else 0 end AS p")
    none = px.selectExpr("img", "'none' AS method", "y", "x", "v", "0 AS p")
    got = {r["method"]: r for r in review.method_scores(good.union(none), "v", "p").collect()}
    assert (got["same"]["ars"], got["same"]["jaccard"], got["same"]["accuracy"]) == (1.0, 1.0, 1.0)
    assert (got["none"]["ars"], got["none"]["jaccard"], got["none"]["accuracy"]) == (0.0, 0.0, 3 / 8)
    total = {r["method"]: r for r in review.method_summary(review.method_scores(good.union(none), "v", "p")).collect()}
    assert total["same"]["images"] == 1 and total["none"]["jaccard_mean"] == 0.0 and total["none"]["ars_std"] is None
