import math
from fractions import Fraction

import numpy as np
import pytest

from pixelmill.llm import whitening
from pixelmill.llm.queries import QUERIES
from pixelmill.llm.whitening import _add_products, decompose, scatter, whiten, whole_vectors

SCHEMA = "vec_id long, embedding array<double>, n string, v int"


def table(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if c is None else float(c) for c in v], "x", 1) for k, v in rows], SCHEMA)


def exact(rows):
    """Sums and scatter by whole numbers, one entry after the other."""
    x = [[math.floor(Fraction(c) * 64) + 1_000_000 for c in r] for r in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    return x, s, [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("size", [1.0, 1e3, 1e9, 2.0**54])
def test_scatter_is_exact(spark, size):
    rows = np.random.default_rng(1).normal(size=(300, 5)) * size
    n, s, m = scatter(whole_vectors(table(spark, list(enumerate(rows)))), 5)
    x, want_s, want = exact(rows.tolist())
    assert n == 300 and [a + n * whitening.OFFSET for a in s.tolist()] == want_s and m.tolist() == want


def test_digits_carry_exactly():
    total = np.zeros((whitening.DIGITS, 2, 2), dtype=np.int64)
    y = np.array([[2**61, -(2**61) + 1], [-(2**62), 3]], dtype=np.int64)
    for _ in range(50):
        _add_products(total, y)
    whole = [[sum(int(total[k, i, j]) << (20 * k) for k in range(whitening.DIGITS)) for j in range(2)] for i in range(2)]
    want = 50 * (y.astype(object).T @ y.astype(object))
    assert whole == want.tolist()


def test_like_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = (rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 40).tolist()
    found = whiten(table(spark, list(enumerate(rows)))).toPandas()
    x, s, m = exact(rows)
    cov = np.array([[float(Fraction(c, 200 * 200)) for c in r] for r in m])
    w, q = np.linalg.eigh(cov)
    assert len(found) == 200 * 6 and set(found["n"]) == {200} and set(found["component"]) == set(range(1, 7))
    for k, part in found.groupby("component"):
        part = part.sort_values("vec_id")
        assert np.allclose(part["explained"], w[-k] / w.sum(), rtol=1e-9)
        want = [float(sum((Fraction(a) - Fraction(b, 200)) * Fraction(float(c)) for a, b, c in zip(r, s, q[:, -k]))) / math.sqrt(w[-k]) for r in x]
        assert np.allclose(part["whitened"], want, atol=1e-6) or np.allclose(part["whitened"], [-v for v in want], atol=1e-6)
        assert [int(v) for v in part["deviation"]] == [sum((200 * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    assert found["identity_error"].nunique() == 1 and found["identity_error"][0] < 1e-9


def test_components_far_below_the_largest(spark):
    """Spread of 1 beside one of 10 ** 9: the small components keep their digits."""
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    rows = (np.round(rng.normal(size=(400, 4)) * [1e9, 300, 20, 5]) @ turn).tolist()
    found = whiten(table(spark, list(enumerate(rows)))).where("component < 4").toPandas()
    x, s, m = exact(rows)
    import decimal

    decimal.getcontext().prec = 60
    values, _ = decompose(np.array(m, dtype=object), 400)
    # the determinant is the product of the eigenvalues: no rounding of the largest may reach the others
    a = [[Fraction(c, 400 * 400) for c in r] for r in m]
    det = Fraction(1)
    for k in range(4):
        det *= a[k][k]
        a = [r if i <= k else [u - r[k] / a[k][k] * v for u, v in zip(r, a[k])] for i, r in enumerate(a)]
    assert math.isclose(float(np.prod(values)), float(det), rel_tol=1e-4)
    assert found["identity_error"][0] < 1e-4


def test_odd_rows(spark):
    good = [(1, [1, 2, 3]), (2, [2, 1, 3]), (2, [2, 1, 3]), (None, [0, 0, 3])]
    bad = [(3, None), (4, [1, None, 3]), (5, [1, math.nan, 3]), (6, [math.inf, 1, 3]), (7, [1e300, 1, 3]), (8, []), (9, [1, 2])]
    found = whiten(table(spark, good + bad)).toPandas()
    assert len(found) == 4 * 3 and found["vec_id"].isna().sum() == 3 and (found["n"] == 4).all()
    last = found[found["component"] == 3]  # the third entry is constant, so nothing is left for the third component
    assert last["whitened"].isna().all() and (last["explained"] == 0).all()
    assert (found["identity_error"] < 1e-9).all() and abs(found[found["vec_id"] == 1]["explained"].sum() - 1) < 1e-9


def test_one_row_no_row_and_equal_rows(spark):
    assert whiten(table(spark, [])).count() == 0
    assert whiten(table(spark, [(1, None)])).count() == 0
    for rows in ([(1, [1, 2])], [(k, [5, 6]) for k in range(4)]):
        found = whiten(table(spark, rows)).collect()
        assert len(found) == 2 * len(rows) and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in found)


def test_deviation_beyond_a_long(spark):
    found = whiten(table(spark, [(1, [2.0**50]), (2, [-(2.0**50)])])).orderBy("vec_id").collect()
    assert found[0]["deviation"] == (2 * 64 * 2**50) ** 2 and abs(abs(found[0]["whitened"]) - 1) < 1e-12


def test_query(spark):
    found = QUERIES["op11_embedding_whitening"](spark, "/root/testdata/sf0.01").toPandas()
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    x = np.floor(np.stack(vectors["embedding"]).astype(np.float64) * 64).astype(np.int64) + 1_000_000
    off = len(x) * x - x.sum(axis=0)
    assert dict(zip(found["vec_id"], found["deviation"])) == dict(zip(vectors["vec_id"], (off**2).sum(axis=1)))
    wide = found.pivot(index="vec_id", columns="component", values="whitened")
    assert wide.shape == (len(x), 32) and np.abs(np.cov(wide.to_numpy().T, bias=True) - np.eye(32)).max() < 1e-9
    w = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(found.drop_duplicates("component").sort_values("component")["explained"], w[:32] / w.sum())
