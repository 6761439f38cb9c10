import itertools

import numpy as np
import pytest

from pixelmill.operators import graph, maxflow

POTTS3 = (1 - np.eye(3)).tolist()


def random_graph(seed, nodes, classes, density=0.6):
    rng = np.random.default_rng(seed)
    a, b = np.triu_indices(nodes, 1)
    some = rng.random(len(a)) < density
    return rng.integers(0, 80, (nodes, classes)) / 8, a[some], b[some], rng.integers(1, 40, some.sum()) / 8


def tables(spark, graphs):
    unary = [(i, n, c, float(v), n % 2) for i, (cost, *_) in enumerate(graphs) for n, r in enumerate(cost) for c, v in enumerate(r)]
    edges = [(i, int(x), int(y), float(w)) for i, (_, a, b, ws) in enumerate(graphs) for x, y, w in zip(a, b, ws)]
    return spark.createDataFrame(unary, "img int, lb long, cls int, cost double, half int"), spark.createDataFrame(edges, "img int, src long, dst long, w double")


def energy(g, labels, pair):
    cost, a, b, w = g
    labels, pair = np.array(labels), np.array(pair)
    return cost[np.arange(len(labels)), labels].sum() + (w * pair[labels[a], labels[b]]).sum()


def labels_of(df, graphs):
    out = [[0] * len(g[0]) for g in graphs]
    for r in df.collect():
        out[r["img"]][r["lb"]] = r["label"]
    return out


def test_two_labels_have_the_least_energy(spark):
    graphs = [random_graph(k, 2 + k % 11, 2) for k in range(60)]
    pair = [[0.0, 1.5], [1.5, 0.0]]
    found = labels_of(maxflow.graph_cut(*tables(spark, graphs), pair), graphs)
    for g, labels in zip(graphs, found):
        best = min(energy(g, x, pair) for x in itertools.product(range(2), repeat=len(g[0])))
        assert energy(g, labels, pair) == best


def test_no_move_lowers_the_energy_and_never_above_modes(spark):
    graphs = [random_graph(100 + k, 7, 3) for k in range(25)]
    unary, edges = tables(spark, graphs)
    modes = graph.regularise(unary, edges, POTTS3)
    found = labels_of(maxflow.graph_cut(unary, edges, POTTS3, start=modes), graphs)
    for g, labels, before in zip(graphs, found, labels_of(modes, graphs)):
        e = energy(g, labels, POTTS3)
        assert e <= energy(g, before, POTTS3)
        for to in range(3):
            for takes in itertools.product((False, True), repeat=7):
                assert e <= energy(g, np.where(takes, to, labels), POTTS3) + 1e-9


def grid(seed, side, classes):
    rng = np.random.default_rng(seed)
    at = np.arange(side * side).reshape(side, side)
    a, b = np.r_[at[:, :-1].ravel(), at[:-1].ravel()], np.r_[at[:, 1:].ravel(), at[1:].ravel()]
    return rng.integers(0, 33, (side * side, classes)) / 16, a, b, rng.integers(1, 9, len(a)) / 8


@pytest.mark.parametrize("classes", [2, 3])
def test_blocks_of_any_size_give_one_result(spark, classes):
    """One image in one group, and in tiles of 4, 5 and 12 pixels (9, 9 and 1 block), whose borders cross the objects."""
    g = grid(7, 12, classes)
    pair = (1 - np.eye(classes)).tolist()
    unary, edges = tables(spark, [g])
    want = labels_of(maxflow.graph_cut(unary, edges, pair), [g])
    for tile in (4, 5, 12):
        dealt = unary.selectExpr("*", f"(lb div 12) div {tile} * 100 + (lb % 12) div {tile} AS blk")
        assert labels_of(maxflow.graph_cut(dealt, edges, pair, block="blk", most=10), [g]) == want
    assert labels_of(maxflow.graph_cut(unary, edges, pair, block="half"), [g]) == want


def test_one_node_a_block(spark):
    """All flow goes over arcs between blocks, with excess that can't reach a sink."""
    graphs = [random_graph(300 + k, 6, 2, 0.5) for k in range(12)]
    unary, edges = tables(spark, graphs)
    want = labels_of(maxflow.graph_cut(unary, edges, (1 - np.eye(2)).tolist()), graphs)
    assert labels_of(maxflow.graph_cut(unary, edges, (1 - np.eye(2)).tolist(), block="lb", most=0), graphs) == want


def test_odd_rows(spark):
    kinds = "img int, lb long, cls int, cost double", "img int, src long, dst long, w double"
    unary = spark.createDataFrame([(0, 1, 0, 1.0), (0, 1, 1, 0.5), (0, 2, 1, 3.0), (None, 1, 0, 0.0), (0, None, 0, 1.0)], kinds[0])
    edges = spark.createDataFrame([(0, 1, 2, 9.0), (0, 1, 1, 5.0), (0, 2, 99, 5.0), (0, 2, 1, 1.0)], kinds[1])
    two = [[0.0, 1.0], [1.0, 0.0]]
    assert {(r["img"], r["lb"], r["label"]) for r in maxflow.graph_cut(unary, edges, two).collect()} == {(0, 1, 1), (0, 2, 1), (None, 1, 0)}
    assert maxflow.graph_cut(unary.limit(0), edges, two).count() == 0
    assert maxflow.graph_cut(unary, edges.limit(0), two).where("img = 0 and lb = 1").first()["label"] == 1
    with pytest.raises(ValueError):
        maxflow.graph_cut(unary, edges, [[0.0, 5.0, 1.0], [5.0, 0.0, 1.0], [1.0, 1.0, 0.0]])


def test_chain_of_superpixels(spark):
    """Ten segments in two rows, of which five lean to one class each: the cut follows them."""
    p = [0.1] * 6 + [0.9] * 4
    unary = spark.createDataFrame([(0, k, c, float(-np.log(v))) for k, q in enumerate(p) for c, v in enumerate((q, 1 - q))], "img int, lb long, cls int, cost double")
    edges = spark.createDataFrame([(0, k, k + 2, 1.0) for k in range(8)] + [(0, k, k + 1, 1.0) for k in range(0, 10, 2)], "img int, src long, dst long, w double")
    found = {r["lb"]: r["label"] for r in maxflow.graph_cut(unary, edges, [[0.0, 1.0], [1.0, 0.0]]).collect()}
    assert [found[k] for k in range(10)] == [1] * 6 + [0] * 4
