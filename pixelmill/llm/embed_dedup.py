"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits at the median of a random direction, again and again; a vector within ``margin`` of the split goes both
ways (spill). Only vectors that share a leaf are compared, by exact cosine in double precision, and the links of all trees
are united. A pair that links differs by at most sqrt(2 - 2 * threshold) in length, so by that over sqrt(dim) in a random
direction: the margin is half of this, and a pair is lost by a tree only where its difference is larger and
straddles the spill; it is lost altogether only where this happens in every tree.

All splits of a tree at one depth share a direction, so a tree is its cuts. They are fitted on a bounded sample (``SAMPLE`` vectors,
``SAMPLE_VALUES`` components); every vector is routed. Trees grow until a leaf is expected to hold ``LEAF`` vectors of the whole table; where
a node has few vectors of the sample left, its cuts are those of the last node above that had ``LEAST``. A leaf that holds over ``BLOCK`` rows all the
same is dealt by label and compared in pairs of blocks, each a task of its own. Equal vectors are one class from the start. A pair that shares
several leaves is counted in the first of them, so leaves give counts and a spanning forest, never their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import connected_components, lean, materialize

TREES, LEAF, BLOCK, CHUNK = 5, 1500, 4096, 1024
SAMPLE, SAMPLE_VALUES, LEAST, DEPTH = 100_000, 8_000_000, 64, 60


class Tree:
    """Nodes as lists; node k splits at ``cuts[k]`` along the direction of depth ``depths[k]``; children below 0 are leaves."""

    def __init__(self, sample: np.ndarray, size: int, leaf: int, margin: float, rng: np.random.Generator, first_leaf: int):
        self.margin, self.cuts, self.depths, self.children = margin, [], [], []
        self.next_leaf = first_leaf
        d = rng.standard_normal((DEPTH, sample.shape[1]))
        self.directions = d / np.linalg.norm(d, axis=1, keepdims=True)
        self.root = self._grow(sample, sample, float(size), leaf, 0)

    def _grow(self, x: np.ndarray, wide: np.ndarray, size: float, leaf: int, depth: int) -> int:
        """The node for about ``size`` vectors; ``x`` are those of the sample, ``wide`` those that cuts are taken from."""
        wide = x if len(x) >= LEAST else wide
        if size > leaf:
            for at in range(depth, min(depth + 3, DEPTH)):  # a direction that doesn't part them is passed over
                p = wide @ self.directions[at]
                cut = float(np.median(p))
                left, right = float((p <= cut + self.margin).mean()), float((p > cut - self.margin).mean())
                if max(left, right) < 0.8:
                    k = len(self.cuts)
                    self.cuts.append(cut)
                    self.depths.append(at)
                    self.children.append(None)
                    q = x @ self.directions[at]
                    self.children[k] = (self._grow(x[q <= cut + self.margin], wide, size * left, leaf, at + 1), self._grow(x[q > cut - self.margin], wide, size * right, leaf, at + 1))
                    return k
        self.next_leaf += 1
        return -self.next_leaf  # leaf number next_leaf - 1

    def route(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaf numbers and the rows that reach them."""
        along = x @ self.directions[: max(self.depths, default=-1) + 1].T
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield -node - 1, at
                continue
            p = along[at, self.depths[node]]
            a, b = self.children[node]
            todo += [(a, at[p <= self.cuts[node] + self.margin]), (b, at[p > self.cuts[node] - self.margin])]


def _unit(vectors: pa.Array) -> np.ndarray:
    """Vectors of length 1 in double precision; they are scaled by their largest component first, so that no square over- or underflows."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _route(share):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests: dict[int, list[Tree]] = share.value
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _unit(part.column("embedding"))
                found = [(leaf, at) for tree in forests[int(dim)] for leaf, at in tree.route(x)]
                leaf = np.concatenate([np.full(len(at), k, np.int64) for k, at in found])
                row = np.concatenate([at for _, at in found])
                order = np.lexsort((leaf, row))
                leaf, row = leaf[order], row[order]
                cut = np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)
                leaves = pa.ListArray.from_arrays(pa.array(cut), pa.array(leaf))
                for k in range(0, len(x), 2000):
                    s = slice(k, min(k + 2000, len(x)))
                    out = part.slice(s.start, s.stop - s.start)
                    yield pa.record_batch([out.column("vec_id"), out.column("label"), out.column("dim"), out.column("n"), out.column("embedding"), leaves.slice(s.start, s.stop - s.start)], names=["vec_id", "label", "dim", "n", "embedding", "leaves"])

    return run


def _compare(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        leaf, bi, bj = (k.as_py() for k in (key[0], key[-2], key[-1]))
        table = table.combine_chunks()
        vec, weight, block = (table.column(c).to_numpy() for c in ("vec_id", "n", "block"))
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        x = _unit(table.column("embedding").combine_chunks())
        lists = table.column("leaves").combine_chunks()
        # leaves before this one, padded so that paddings never agree
        flat, cut = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        before = [flat[a:b][flat[a:b] < leaf] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        wide = max([1, *map(len, before)])
        early = np.full((len(vec), wide), -1, np.int64)
        for k, b in enumerate(before):
            early[k, : len(b)] = b
        links, root = np.zeros(len(vec), np.int64), np.arange(len(vec))
        for lab in np.unique(label):
            rows = np.flatnonzero(label == lab)
            ours, theirs = rows[block[rows] == bi], rows[block[rows] == bj]
            for a in range(0, len(ours), CHUNK):
                p = ours[a : a + CHUNK]
                i, j = np.nonzero(x[p] @ x[theirs].T >= threshold)
                i, j = p[i], theirs[j]
                keep = i < j if bi == bj else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                while len(i) and (root[i] != root[j]).any():  # smallest row number spreads along links
                    ri, rj = root[i], root[j]
                    low = np.minimum(ri, rj)
                    np.minimum.at(root, ri, low)  # roots, so that all rows that earlier chunks joined to them follow
                    np.minimum.at(root, rj, low)
                    while (root[root] != root).any():
                        root = root[root]
                for s in range(0, len(i), 100_000):
                    u, v = i[s : s + 100_000], j[s : s + 100_000]
                    known = np.zeros(len(u), bool)
                    for c in range(wide):
                        e = early[u, c][:, None]
                        known |= ((e >= 0) & (early[v] == e)).any(1)
                    u, v = u[~known], v[~known]
                    np.add.at(links, u, weight[v])
                    np.add.at(links, v, weight[u])
        some = (links > 0) | (root != np.arange(len(vec)))
        return pa.table({"vec_id": pa.array(vec[some]), "links": pa.array(links[some]), "peer": pa.array(vec[root[some]])})

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, trees: int = TREES, seed: int = 7) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) for ``vectors(vec_id, embedding, label)``; other columns are not read.

    Only vectors with equal labels (of any type that can be written as a string) and lengths are compared. A vector links with nothing if it,
    its label or one of its components is null, or it is all zeros or not finite: n_links is 0 and it is its own component. A row
    without vec_id links with nothing, its component_id and kept are null. A repeated row counts as another vector. An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    kinds = dict(vectors.dtypes)
    label = F.col("label") + F.lit(0.0).cast(kinds["label"]) if kinds["label"] in ("float", "double") else F.col("label")  # -0.0 is 0.0
    # the table's own type if it is float, which holds the values and is half as long
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kinds["embedding"] == "array<float>" else "array<double>").alias("embedding"), label.cast("string").alias("label"))
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd & F.exists("embedding", lambda c: c != 0)
    good = F.coalesce(good, F.lit(False))
    classes = materialize(v.where(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = classes.select(F.col("rep").alias("vec_id"), "label", F.size("embedding").cast("long").alias("dim"), "n", "embedding")
    rng, forests, first_leaf = np.random.default_rng(seed), {}, 0
    for row in reps.groupBy("dim").count().orderBy("dim").collect():
        dim, count = row["dim"], row["count"]
        share = min(1.0, min(SAMPLE, max(1000, SAMPLE_VALUES // dim)) / count)
        sample = reps.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id", "label"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)).select("vec_id", "embedding").toArrow().sort_by("vec_id")
        x = _unit(sample.column("embedding").combine_chunks()) if len(sample) else np.eye(1, dim)
        margin = 0.5 * (2 - 2 * threshold) ** 0.5 / dim**0.5
        forests[dim] = []
        for _ in range(trees):
            tree = Tree(x, count, LEAF, margin, rng, first_leaf)
            first_leaf = tree.next_leaf
            forests[dim].append(tree)
    if not forests:
        linked = spark.createDataFrame([], "rep long, links long, root long")
    else:
        linked = _linked(reps, spark.sparkContext.broadcast(forests), threshold)
    of_class = classes.join(linked, "rep", "left").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    a = v.withColumn("good", good).select("vec_id", F.when(F.col("good"), F.col("label")).alias("label"), F.when(F.col("good"), F.col("embedding")).alias("embedding"))
    out = a.join(of_class, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _linked(reps: DataFrame, share, threshold: float) -> DataFrame:
    """For class representatives with links: (rep, links, root)."""
    vector = dict(reps.dtypes)["embedding"]
    routed = materialize(reps.mapInArrow(lean(_route(share)), f"vec_id long, label string, dim long, n long, embedding {vector}, leaves array<long>"), "routed")
    # a representative occurs under several labels if a vec_id is repeated; leaves are of one length, so lengths don't mix
    sizes = routed.select("label", F.explode("leaves").alias("leaf")).groupBy("leaf", "label").count()
    large = sizes.groupBy("leaf").agg(F.sum("count").alias("all")).where(F.col("all") > BLOCK).select("leaf")
    sizes = sizes.join(large, "leaf", "left_semi").select("leaf", F.col("label").alias("part"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    rows = routed.withColumn("leaf", F.explode("leaves")).join(sizes.withColumnRenamed("leaf", "_leaf"), (F.col("leaf") == F.col("_leaf")) & (F.col("label") == F.col("part")), "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("leaf", "part", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "vec_id", "label", "n", "block", "embedding", "leaves")
    found = materialize(rows.groupBy("leaf", "part", "bi", "bj").applyInArrow(_compare(threshold), "vec_id long, links long, peer long"), "found")
    links = found.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("links").alias("links"))
    roots = connected_components(found, "vec_id", "peer")
    return links.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "links", F.coalesce("root", "rep").alias("root"))
