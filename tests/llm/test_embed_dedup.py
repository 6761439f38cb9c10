import numpy as np

from pixelmill.llm import embed_dedup
from pixelmill.llm.embed_dedup import near_duplicate_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    n = len(rows)
    links, root = np.zeros(n, int), list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ok = [i is not None and lab is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) for i, v, lab in rows]
    x = [np.asarray(v, np.float32).astype(float) if k else None for k, (_, v, _) in zip(ok, rows)]
    for a in range(n):
        for b in range(a + 1, n):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for a in range(n):
        if rows[a][0] is not None:
            least[find(a)] = min(least.get(find(a), rows[a][0]), rows[a][0])
    return sorted(((i, int(links[a]), least[find(a)] if i is not None else None) for a, (i, _, _) in enumerate(rows)), key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "vec_id AS leaf", "label AS n")
    out = near_duplicate_vectors(df).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out if r["vec_id"] is not None)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str)


def make(n, seed, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        v = rng.standard_normal(dim)
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append((len(rows), [float(c) for c in np.float32(v + 0.06 * rng.standard_normal(dim))], int(rng.integers(3))))
    v = rng.standard_normal(dim)
    return rows + [(n + 100 + k, [float(c) for c in np.float32(v + 0.02 * rng.standard_normal(dim))], 1) for k in range(60)]


def test_like_brute_force(spark):
    rows = make(300, 1)
    assert run(spark, rows) == brute(rows)


def test_many_leaves_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "LEAF", 40)
    monkeypatch.setattr(embed_dedup, "BLOCK", 30)
    rows = make(400, 2)
    got, want = run(spark, rows), brute(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [1.0, 0.0], None), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [1.0, 0.0], 2), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (11, [], 1), (12, [1.0, 0.0], 1)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_links_of_a_block_that_is_compared_in_chunks(monkeypatch):
    """What an earlier chunk joined stays joined when a later one lowers the root of a part of it."""
    monkeypatch.setattr(embed_dedup, "CHUNK", 2, raising=False)
    import pyarrow as pa

    for seed in range(20):
        rng = np.random.default_rng(seed)
        angle = 0.15 * rng.permutation(30)  # a chain: each vector links with those next to it only
        x = np.stack([np.cos(angle), np.sin(angle)], 1).astype(np.float32)
        n = len(x)
        table = pa.table({"vec_id": pa.array(range(n), pa.int64()), "label": pa.array([0] * n, pa.int64()), "n": pa.array([1] * n, pa.int64()), "block": pa.array([0] * n, pa.int32()),
                          "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "leaves": pa.array([[0]] * n, pa.list_(pa.int64()))})
        got = embed_dedup._compare(0.98)((pa.scalar(0), pa.scalar(0), pa.scalar(0)), table)
        assert got.column("vec_id").to_pylist() == list(range(n)) and set(got.column("peer").to_pylist()) == {0}


def test_double_precision_and_any_label(spark):
    """Components near the threshold, tiny and huge ones, and labels that aren't whole numbers."""
    def near(c):
        return [c, (1 - c * c) ** 0.5]

    rows = [(1, [1.0, 0.0], "a"), (2, near(0.98 - 1e-10), "a"), (3, [1.0, 0.0], "b"), (4, near(0.98 + 1e-10), "b"), (5, [1e-60, 1e-60], "c"), (6, [2e-60, 2e-60], "c"), (7, [1e200, 1e200], "d"), (8, [1.0, 1.0], "d"), (9, [1.0, 1.0], "D")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert {r["vec_id"]: r["component_id"] for r in near_duplicate_vectors(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9}
    rows = [(1, [1.0, 0.0], 1.2), (2, [1.0, 0.0], 1.7), (3, [1.0, 0.0], 0.0), (4, [1.0, 0.0], -0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double")
    assert {r["vec_id"]: r["component_id"] for r in near_duplicate_vectors(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}


def test_recall_at_production_parameters(spark):
    """Pairs just above the threshold among vectors that fill many leaves; against brute force."""
    rng = np.random.default_rng(4)
    n, dim = 6000, 64
    base = rng.standard_normal((n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((n, dim))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate([base, 0.981 * base + (1 - 0.981**2) ** 0.5 * side])
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    links = {r["vec_id"]: r["n_links"] for r in near_duplicate_vectors(df).collect()}
    want = np.zeros(2 * n, int)
    for a in range(0, 2 * n, 1000):
        want[a : a + 1000] = (x[a : a + 1000] @ x.T >= 0.98).sum(1) - 1
    assert all(links[k] <= want[k] for k in links) and sum(links.values()) >= 0.9 * want.sum()
