"""Minimum cuts and alpha expansion on graphs whose nodes lie in blocks.

A block (a tile of pixels, an image's segments) is one row: its nodes, the arcs within, and the arcs to other blocks. In a round each
block sends its excess on, first to the sink, then over arcs to blocks whose end has label 0, 1, ...; a node's label is a lower bound of the number of arcs
between blocks on its way to the sink. Blocks exchange what they pushed over such arcs and their labels there; a push that
would break the bound is taken back on both sides, as both know both labels. Rounds end when nothing was pushed and no label changed; then a node
whose label is finite has a way to the sink, and this side of the cut is the smallest there is, whatever the blocks.

Costs become whole numbers (``UNIT`` to one), so sums don't depend on their order, and cuts are exact in them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.session import checkpoint_folder

KEY = ["img"]
UNIT, DEAREST = 1 << 20, 1e6
#: Images of up to so many nodes are settled in one group; larger ones in rounds over blocks.
BLOCK_NODES = 1 << 16
FAR = np.int64(1) << 40
#: Rounds of pushes between two exact computations of all distances.
REFRESH = 24

STATE = "nodes array<long>, excess array<long>, sink array<long>, label array<long>, a array<int>, b array<int>, ab array<long>, ba array<long>, u array<int>, peer array<long>, far_block array<long>, away array<long>, back array<long>, pushed array<long>"


class Arcs:
    """Arcs sorted by tail, each with the place of its reverse; one arc of each node leads to the target."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray):
        m = len(a)
        tail, head = np.concatenate([a, b, np.arange(n)]), np.concatenate([b, a, np.full(n, n)])
        order = np.argsort(tail, kind="stable")
        self.place = np.empty(2 * m + n, np.int64)
        self.place[order] = np.arange(2 * m + n)
        self.n, self.m, self.tail, self.head = n, m, tail[order], head[order]
        self.forth, self.back, self.out = self.place[:m], self.place[m : 2 * m], self.place[2 * m :]
        self.rev = np.full(2 * m + n, 2 * m + n)  # what reaches the target doesn't come back
        self.rev[self.forth], self.rev[self.back] = self.back, self.forth
        self.start = np.searchsorted(self.tail, np.arange(n + 1))

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arcs that begin in ``nodes``, one node after the other, and where in them each node's begin."""
        first, size = self.start[nodes], self.start[nodes + 1] - self.start[nodes]
        at = np.cumsum(size) - size
        return np.repeat(first - at, size) + np.arange(size.sum()), at

    def into(self, nodes: np.ndarray) -> np.ndarray:
        """The arcs that end in ``nodes``, but for the target."""
        into = self.rev[self.of(nodes)[0]]
        return into[into < len(self.rev)]


def _spread(arcs: Arcs, cap: np.ndarray, seeds: np.ndarray, known: np.ndarray, value: np.ndarray, step: int) -> None:
    """Give ``value`` of the seeds to all nodes not ``known`` that reach them, plus ``step`` for each arc on the way."""
    while len(seeds):
        known[seeds] = True
        into = arcs.into(seeds)
        into = into[(cap[into] > 0) & ~known[arcs.tail[into]]]
        tails = arcs.tail[into]
        value[tails] = value[arcs.head[into]] + step
        seeds = np.unique(tails)


def push(arcs: Arcs, cap: np.ndarray, excess: np.ndarray) -> None:
    """Send as much excess to the target as can go there: rounds in which each node with excess serves all arcs that lead one step down."""
    n, tail, head = arcs.n, arcs.tail, arcs.head
    for k in itertools.count():
        if k % REFRESH == 0:
            d, known = np.full(n + 1, FAR), np.zeros(n + 1, bool)
            d[n] = 0
            near = np.flatnonzero(cap[arcs.out] > 0)
            d[near] = 1
            _spread(arcs, cap, near, known, d, 1)
        live = np.flatnonzero((excess > 0) & (d[:n] < FAR))
        if not len(live):
            return
        may, _ = arcs.of(live)
        may = may[(cap[may] > 0) & (d[tail[may]] == d[head[may]] + 1)]
        if len(may):
            t, c = tail[may], cap[may]
            before = np.cumsum(c) - c
            before -= np.maximum.accumulate(np.where(np.r_[True, t[1:] != t[:-1]], before, 0))
            sent = np.clip(excess[t] - before, 0, c)
            cap[may] -= sent
            np.add.at(cap, arcs.rev[may], sent)
            np.subtract.at(excess, t, sent)
            inner = head[may] < n
            np.add.at(excess, head[may][inner], sent[inner])
            cap[-1] = 0
        up = live[excess[live] > 0]
        if len(up):
            own, at = arcs.of(up)
            lowest = np.minimum.reduceat(np.where(cap[own] > 0, d[head[own]] + 1, FAR), at)
            d[up] = np.maximum(d[up], np.minimum(lowest, FAR))


def solve(a: np.ndarray, b: np.ndarray, ab: np.ndarray, ba: np.ndarray, excess: np.ndarray, sink: np.ndarray, arcs: Arcs | None = None) -> np.ndarray:
    """Which nodes are on the sink's side of the smallest such minimum cut of one graph in memory."""
    n = len(excess)
    arcs = arcs or Arcs(n, a, b)
    cap = np.zeros(2 * arcs.m + n + 1, np.int64)
    cap[arcs.forth], cap[arcs.back], cap[arcs.out] = ab, ba, sink
    push(arcs, cap, excess.copy())
    known = np.zeros(n + 1, bool)
    _spread(arcs, cap, np.flatnonzero(cap[arcs.out] > 0), known, np.zeros(n + 1, np.int64), 0)
    return known[:n]


def move(cost: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, pair: np.ndarray, labels: np.ndarray, to: int) -> tuple[np.ndarray, ...]:
    """The cut that decides which nodes take label ``to``: (capacity of a -> b, excess, sink). What is on the sink's side takes it."""
    la, lb = labels[a], labels[b]
    stay, one, other = w * pair[la, lb], w * pair[la, to], w * pair[to, lb]
    gain = cost[:, to] - cost[np.arange(len(labels)), labels]
    np.add.at(gain, a, other - stay)
    np.subtract.at(gain, b, other)
    return one + other - stay, np.maximum(gain, 0), np.maximum(-gain, 0)


def expand(cost: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, pair: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Alpha expansion of one graph in memory: cycles over the labels until none lowers the energy."""
    arcs, still, to = Arcs(len(labels), a, b), 0, 0
    zero = np.zeros(len(a), np.int64)
    while still < len(pair):
        ab, excess, sink = move(cost, a, b, w, pair, labels, to)
        takes = solve(a, b, ab, zero, excess, sink, arcs) if sink.any() else np.zeros(len(labels), bool)
        takes &= labels != to
        still = 0 if takes.any() else still + 1
        labels = np.where(takes, to, labels)
        to = (to + 1) % len(pair)
    return labels


def whole_costs(pair: list[list[float]]) -> np.ndarray:
    """Pairwise costs as whole numbers; they have to be a metric, or a move were no cut."""
    m = np.array(pair, float)
    if (m < 0).any() or np.diag(m).any() or (m != m.T).any() or (m[:, None, :] > m[:, :, None] + m[None, :, :] + 1e-9).any():
        raise ValueError("costs of unlike neighbours have to be symmetric, 0 for equal labels, and to keep the triangle inequality")
    return m


def graph_cut(unary: DataFrame, edges: DataFrame, matrix: list[list[float]], segment: str = "lb", start: DataFrame | None = None, block: str | None = None, most: int = BLOCK_NODES) -> DataFrame:
    """Labels (img, segment, label) of low energy by alpha expansion over maximum flows.

    ``unary(img, segment, cls, cost)`` has a row for each class; one that lacks costs ``DEAREST``, the most that any does. ``edges(img, src, dst, w)`` with weights above 0; those of unknown
    nodes count for nothing. ``matrix`` is a metric over labels; with two labels the result has the least energy there is. ``start(img, segment, label)``:
    labels to begin with, where given; else a node's cheapest. ``block``: a column of ``unary`` that deals a large image's nodes out; images of up to ``most``
    nodes are one block. Results don't depend on blocks. Empty tables give empty results, a null segment is none.
    """
    checkpoint_folder(unary.sparkSession)
    pair = whole_costs(matrix)
    kind = dict(unary.dtypes)[segment]
    cost = F.round(F.least(F.col("cost"), F.lit(DEAREST)) * UNIT).cast("long")
    at = F.col(block).cast("long") if block else F.lit(0).cast("long")
    rows = unary.where(F.col(segment).isNotNull()).select(*KEY, F.col(segment).cast("long").alias("node"), at.alias("block"), F.struct(F.col("cls").cast("int").alias("c"), cost.alias("v")).alias("cost"))
    nodes = rows.groupBy(*KEY, "node").agg(F.min("block").alias("block"), F.collect_list("cost").alias("cost"))
    if start is not None:
        given = start.select(*KEY, F.col(segment).cast("long").alias("node"), F.col("label").cast("int").alias("label"))
        nodes = nodes.join(given, [*KEY, "node"], "left")
    else:
        nodes = nodes.withColumn("label", F.lit(None).cast("int"))
    whole = F.round(F.col("w") * UNIT).cast("long")
    links = edges.where("src <> dst").groupBy(*KEY, F.least("src", "dst").cast("long").alias("a"), F.greatest("src", "dst").cast("long").alias("b")).agg(F.sum(whole).alias("w"))
    if block is None:
        return _whole(nodes, links, pair).select(*KEY, F.col("node").cast(kind).alias(segment), "label")
    sizes = nodes.groupBy(*KEY).agg(F.count("*").alias("_n"))
    nodes = nodes.join(sizes, KEY).checkpoint()
    small = nodes.where(F.col("_n") <= most).drop("_n")
    large = nodes.where(F.col("_n") > most).drop("_n")
    out = _whole(small, links, pair)
    if not large.isEmpty():
        out = out.union(_in_blocks(large, links.join(large.select(*KEY).distinct(), KEY, "left_semi"), pair))
    return out.select(*KEY, F.col("node").cast(kind).alias(segment), "label")


def _costs(column: pa.Array, classes: int) -> np.ndarray:
    """Costs by node and class from lists of (class, cost)."""
    size = np.diff(column.offsets.to_numpy())
    values = column.flatten()
    cost = np.full((len(size), classes), int(DEAREST * UNIT), np.int64)
    cost[np.repeat(np.arange(len(size)), size), values.field("c").to_numpy()] = values.field("v").to_numpy()
    return cost


def _whole(nodes: DataFrame, links: DataFrame, pair: np.ndarray) -> DataFrame:
    """Labels of images that are one block: a group an image."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        if not len(left):
            return pa.table({"img": pa.array([], left.schema.field("img").type), "node": pa.array([], pa.int64()), "label": pa.array([], pa.int32())})
        ids = left.column("node").to_numpy()
        order = np.argsort(ids)
        cost = _costs(left.column("cost").chunk(0), len(pair))[order]
        given = left.column("label").fill_null(-1).to_numpy()[order]
        a, b, w = (right.column(c).to_numpy() for c in ("_a", "_b", "_w"))
        known = np.isin(a, ids) & np.isin(b, ids) & (w > 0)
        a, b, w = np.searchsorted(ids[order], a[known]), np.searchsorted(ids[order], b[known]), w[known]
        by_weight, scale = _scaled(pair)
        labels = expand(cost * scale, a, b, w, by_weight, np.where(given >= 0, given, cost.argmin(axis=1)))
        img = left.column("img")[0].as_py()
        return pa.table({"img": pa.array([img] * len(ids), left.schema.field("img").type), "node": pa.array(ids[order]), "label": pa.array(labels.astype(np.int32))})

    e = links.select(F.col("img").alias("_img"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("w").alias("_w"))
    kind = dict(nodes.dtypes)["img"]
    return nodes.groupBy(*KEY).cogroup(e.groupBy("_img")).applyInArrow(run, f"img {kind}, node long, label int")


def _scaled(pair: np.ndarray) -> tuple[np.ndarray, int]:
    """Pairwise costs in whole steps, and how many of them are one: the least power of two that makes them whole, up to 1024."""
    for k in range(11):
        if (pair * 2**k == np.rint(pair * 2**k)).all():
            break
    return np.rint(pair * 2**k).astype(np.int64), 2**k


def _in_blocks(nodes: DataFrame, links: DataFrame, pair: np.ndarray) -> DataFrame:
    """Alpha expansion of images in blocks: each move builds a network from the labels, which rounds over blocks cut."""
    by_weight, scale = _scaled(pair)
    table = F.array(*[F.array(*[F.lit(int(v)) for v in r]) for r in by_weight])
    costs = F.map_from_entries(F.transform("cost", lambda x: F.struct(x["c"], x["v"])))
    dearest = F.lit(int(DEAREST * UNIT))
    cheapest = F.array_min(F.transform("cost", lambda x: F.struct(x["v"].alias("v"), x["c"].alias("c"))))["c"]
    state = nodes.select(*KEY, "node", "block", costs.alias("cost"), F.coalesce("label", cheapest).alias("label")).checkpoint()
    ends = state.select(*KEY, "node", "block")
    links = links.where("w > 0").join(ends.select(*KEY, F.col("node").alias("a"), F.col("block").alias("block_a")), [*KEY, "a"]).join(
        ends.select(*KEY, F.col("node").alias("b"), F.col("block").alias("block_b")), [*KEY, "b"]).checkpoint()
    still, to = 0, 0
    while still < len(pair):
        label = state.select(*KEY, "node", "label")
        e = links.join(label.select(*KEY, F.col("node").alias("a"), F.col("label").alias("la")), [*KEY, "a"]).join(label.select(*KEY, F.col("node").alias("b"), F.col("label").alias("lb")), [*KEY, "b"])
        stay, one, other = F.col("w") * table[F.col("la")][F.col("lb")], F.col("w") * table[F.col("la")][to], F.col("w") * table[F.lit(to)][F.col("lb")]
        e = e.select(*KEY, "a", "b", "block_a", "block_b", (one + other - stay).alias("ab"), (other - stay).alias("at_a"), (-other).alias("at_b"))
        sums = e.select(*KEY, F.col("a").alias("node"), F.col("at_a").alias("more")).union(e.select(*KEY, "b", "at_b")).groupBy(*KEY, "node").agg(F.sum("more").alias("more"))
        own = (F.coalesce(F.col("cost")[to], dearest) - F.coalesce(F.col("cost")[F.col("label")], dearest)) * scale
        gain = state.join(sums, [*KEY, "node"], "left").select(*KEY, "node", "block", (own + F.coalesce("more", F.lit(0))).alias("g"))
        takes = min_cut(gain.select(*KEY, "block", "node", F.greatest("g", F.lit(0)).alias("excess"), F.greatest(-F.col("g"), F.lit(0)).alias("sink")), e.where("ab > 0").withColumn("ba", F.lit(0).cast("long")))
        after = state.join(takes.select(*KEY, "node", F.lit(True).alias("_t")), [*KEY, "node"], "left")
        changed = F.col("_t").isNotNull() & (F.col("label") != to)
        after = after.withColumn("_c", changed).withColumn("label", F.when(changed, to).otherwise(F.col("label"))).drop("_t").checkpoint()
        still = 0 if not after.where("_c").isEmpty() else still + 1
        state, to = after.drop("_c"), (to + 1) % len(pair)
    return state.select(*KEY, "node", "label")


def min_cut(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes (img, node) on the sink's side of the smallest such minimum cut.

    ``nodes(img, block, node, excess, sink)``: capacities from the source and to the sink; ``links(img, a, b, block_a, block_b, ab, ba)``: capacities either
    way. All whole numbers.
    """
    checkpoint_folder(nodes.sparkSession)
    kind = dict(nodes.dtypes)["img"]
    ends = F.struct("a", "b", "ab", "ba")
    inner = links.where("block_a = block_b").groupBy(*KEY, F.col("block_a").alias("block")).agg(F.collect_list(ends).alias("inner"))
    cross = links.where("block_a <> block_b")
    sides = cross.select(*KEY, F.col("block_a").alias("block"), F.struct(F.col("a").alias("own"), F.col("b").alias("peer"), F.col("block_b").alias("far"), F.col("ab").alias("away"), F.col("ba").alias("back")).alias("x")).union(
        cross.select(*KEY, "block_b", F.struct(F.col("b").alias("own"), F.col("a").alias("peer"), F.col("block_a").alias("far"), F.col("ba").alias("away"), F.col("ab").alias("back"))))
    outer = sides.groupBy(*KEY, "block").agg(F.collect_list("x").alias("outer"))
    grouped = nodes.groupBy(*KEY, "block").agg(F.collect_list(F.struct("node", "excess", "sink")).alias("own"))
    blocks = grouped.join(inner, [*KEY, "block"], "left").join(outer, [*KEY, "block"], "left")
    blocks = blocks.mapInArrow(_build, f"img {kind}, block long, {STATE}")
    letter = "array<struct<to:long,own:long,peer:long,label:long,pushed:long>>"
    none = F.lit(None).cast("array<struct<own:long,peer:long,label:long,pushed:long>>")
    state = blocks.withColumns({"inbox": none, "gap": F.lit(None).cast("long")}).mapInArrow(_round, f"img {kind}, block long, {STATE}, letters {letter}, moved boolean").checkpoint()
    while not state.where("moved").isEmpty():
        mail = state.select(*KEY, F.explode("letters").alias("m")).select(*KEY, F.col("m.to").alias("block"), F.struct(F.col("m.peer").alias("own"), F.col("m.own").alias("peer"), F.col("m.label").alias("label"), F.col("m.pushed").alias("pushed")).alias("x"))
        # where no end of an arc has label k, nothing above k can come down to the sink
        seen = mail.groupBy(*KEY).agg(F.array_distinct(F.collect_set("x.label")).alias("seen"))
        gap = seen.select(*KEY, F.array_min(F.array_except(F.sequence(F.lit(0).cast("long"), F.size("seen").cast("long")), "seen")).alias("gap"))
        inbox = mail.groupBy(*KEY, "block").agg(F.collect_list("x").alias("inbox"))
        state = state.drop("letters", "moved").join(inbox, [*KEY, "block"], "left").join(gap, KEY, "left").mapInArrow(
            _round, f"img {kind}, block long, {STATE}, letters {letter}, moved boolean").checkpoint()
    return state.select(*KEY, F.explode(F.arrays_zip("nodes", "label")).alias("x")).where(F.col("x.label") < int(FAR)).select(*KEY, F.col("x.nodes").alias("node"))


def _fields(value: pa.Scalar, names: tuple[str, ...]) -> list[np.ndarray]:
    if not value.is_valid:
        return [np.empty(0, np.int64) for _ in names]
    return [value.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


def _row(batch: pa.RecordBatch, i: int, more: dict) -> pa.RecordBatch:
    own = {"img": batch.column("img").slice(i, 1), "block": batch.column("block").slice(i, 1)}
    kinds = {"a": pa.int32(), "b": pa.int32(), "u": pa.int32()}
    lists = {k: v if isinstance(v, pa.Array) else pa.array([v], pa.list_(kinds.get(k, pa.int64()))) for k, v in more.items()}
    return pa.RecordBatch.from_pydict(own | lists)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            node, excess, sink = _fields(batch.column("own")[i], ("node", "excess", "sink"))
            order = np.argsort(node)
            node = node[order]
            a, b, ab, ba = _fields(batch.column("inner")[i], ("a", "b", "ab", "ba"))
            own, peer, far, away, back = _fields(batch.column("outer")[i], ("own", "peer", "far", "away", "back"))
            yield _row(batch, i, {
                "nodes": node, "excess": excess[order], "sink": sink[order], "label": np.zeros(len(node), np.int64), "a": np.searchsorted(node, a).astype(np.int32), "b": np.searchsorted(node, b).astype(np.int32),
                "ab": ab, "ba": ba, "u": np.searchsorted(node, own).astype(np.int32), "peer": peer, "far_block": far, "away": away, "back": back, "pushed": np.zeros(len(own), np.int64)})


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One round of each block: settle last round's pushes, send excess on, set labels, write to the blocks beside."""
    for batch in batches:
        for i in range(batch.num_rows):
            s = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False).copy() for c in ("nodes", "excess", "sink", "label", "a", "b", "ab", "ba", "u", "peer", "far_block", "away", "back", "pushed")}
            theirs, came = np.zeros(len(s["u"]), np.int64), np.zeros(len(s["u"]), np.int64)
            own, peer, label, pushed = _fields(batch.column("inbox")[i], ("own", "peer", "label", "pushed"))
            if len(own):
                mine = np.lexsort((s["peer"], s["nodes"][s["u"]]))
                mail = np.lexsort((peer, own))
                theirs[mine], came[mine] = label[mail], pushed[mail]
                gap = batch.column("gap")[i].as_py()
                if gap is not None:
                    theirs[theirs > gap] = FAR
                    s["label"][s["label"] > gap] = FAR
                _settle(s, theirs, came)
            before = s["label"].copy()
            _discharge(s, theirs)
            moved = bool(s["pushed"].any() or (s["label"][s["u"]] != before[s["u"]]).any())
            letters = pa.StructArray.from_arrays([pa.array(s["far_block"]), pa.array(s["nodes"][s["u"]]), pa.array(s["peer"]), pa.array(s["label"][s["u"]]), pa.array(s["pushed"])], ["to", "own", "peer", "label", "pushed"])
            yield _row(batch, i, s | {"letters": pa.ListArray.from_arrays(pa.array([0, len(letters)], pa.int32()), letters), "moved": pa.array([moved])})


def _settle(s: dict, theirs: np.ndarray, came: np.ndarray) -> None:
    """A push from u to v stands if v's label is at most u's and one; else u has it again. Both sides decide alike."""
    u, mine = s["u"], s["label"][s["u"]]
    stands = theirs <= mine + 1
    sent = np.where(stands, s["pushed"], 0)
    np.add.at(s["excess"], u, s["pushed"] - sent)
    got = np.where(mine <= theirs + 1, came, 0)
    np.add.at(s["excess"], u, got)
    s["away"] += got - sent
    s["back"] += sent - got


def _discharge(s: dict, theirs: np.ndarray) -> None:
    n, u = len(s["nodes"]), s["u"]
    # arcs to other blocks become arcs to the target of a node of their own, one after the other by the far end's label
    arcs = Arcs(n + len(u), np.r_[s["a"], u], np.r_[s["b"], n + np.arange(len(u))])
    cap = np.zeros(2 * arcs.m + arcs.n + 1, np.int64)
    m = len(s["a"])
    cap[arcs.forth[:m]], cap[arcs.back[:m]], cap[arcs.forth[m:]] = s["ab"], s["ba"], s["away"]
    cap[arcs.out[:n]] = s["sink"]
    excess = np.r_[s["excess"], np.zeros(len(u), np.int64)]
    push(arcs, cap, excess)
    steps = np.unique(theirs[(s["away"] > 0) & (theirs < FAR)])
    for k in steps:
        if not (excess[:n] > 0).any():
            break
        cap[arcs.out[n:][theirs == k]] = np.iinfo(np.int64).max >> 1
        push(arcs, cap, excess)
    left = cap[arcs.forth[m:]]
    s["pushed"] = s["away"] - left
    s["ab"], s["ba"], s["sink"], s["excess"] = cap[arcs.forth[:m]], cap[arcs.back[:m]], cap[arcs.out[:n]], excess[:n]
    # labels: 0 with a way to the sink within the block, else one more than the least far end in reach
    value, known = np.full(arcs.n + 1, FAR), np.zeros(arcs.n + 1, bool)
    known[n:] = True
    seeds = np.flatnonzero(s["sink"] > 0)
    value[seeds] = 0
    _spread(arcs, cap, seeds, known, value, 0)
    for k in steps:
        seeds = np.unique(u[(left > 0) & (theirs == k)])
        seeds = seeds[~known[seeds]]
        value[seeds] = k + 1
        _spread(arcs, cap, seeds, known, value, 0)
    s["label"] = np.maximum(s["label"], value[:n])
