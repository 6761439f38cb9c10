"""Merkle manifests of tables: a tree a source, a tree over their roots, and a proof for each row.

Leaves are numbered within their source by their order. A bucket holds fanout ** levels of them; a grouped function collapses that
many levels of a bucket at once and hands out its root and the lower part of each proof. The roots of buckets are the next
round's leaves, so rounds grow with the logarithm of the table, and no group exceeds a bucket. Proofs are put together
downwards: what leads from a bucket's root to the top is appended to what leads from a row to its bucket's root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelmill.llm.common import lean, materialize

FANOUT, LEVELS = 3, 5
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SIZE = 32


def row_digest(columns: list[Column]) -> Column:
    """SHA-256 (hex) of the columns one after the other: "-" for null, else length in UTF-8 bytes, ":" and the value as text."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves_of(docs: DataFrame, claimed: dict[str, Column] | None = None) -> DataFrame:
    """Rows (source, doc_id, leaf, claimed) of binary digests; ``claimed`` names columns to be put in another column's place for the last."""
    other = {c: F.col(c) for c in COLUMNS} | (claimed or {})
    return docs.select("source", "doc_id", F.unhex(row_digest([F.col(c) for c in COLUMNS])).alias("leaf"), F.unhex(row_digest([other[c] for c in COLUMNS])).alias("claimed"))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes(tree, ...)`` with idx from 0 within each tree by ``order``, and n, the number of its nodes.

    Rows are dealt by ranges of (tree, order) and sorted there; the counts of a tree in each range, of which there are no more than ranges and
    trees together, are summed up by a window. So a tree of any size is never in one task.
    """
    ranged = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = materialize(ranged.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "ranged")
    counts = ranged.groupBy("tree", "range").agg(F.count("*").alias("k"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("k").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("tree").alias("s_tree"), F.col("range").alias("s_range"), "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("k").over(tree).alias("n"))
    joined = ranged.join(starts, (F.col("tree") == F.col("s_tree")) & (F.col("range") == F.col("s_range")))
    return joined.select(*nodes.columns, (F.col("at") - F.col("first") + F.col("before")).alias("idx"), "n")


def _collapse(fanout: int, levels: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Paths and root of one bucket: a path has for each level its place in the run, the number of others in it, and their digests."""
        rows = rows.sort_values("idx")
        nodes = [bytes(x) for x in rows["digest"]]
        paths = [bytearray() for _ in nodes]
        under = [[k] for k in range(len(nodes))]
        for _ in range(min(levels, int(rows["left"].iloc[0]))):
            up, over = [], []
            for k in range(0, len(nodes), fanout):
                run_ = nodes[k : k + fanout]
                for place in range(len(run_)):
                    step = bytes([place, len(run_) - 1]) + b"".join(run_[:place] + run_[place + 1 :])
                    for leaf in under[k + place]:
                        paths[leaf] += step
                up.append(_parent(run_))
                over.append([leaf for below in under[k : k + fanout] for leaf in below])
            nodes, under = up, over
        return pd.DataFrame({"tree": rows["tree"], "bucket": rows["bucket"], "idx": rows["idx"], "left": rows["left"], "id": rows["id"], "digest": rows["digest"], "claimed": rows["claimed"], "path": [bytes(p) for p in paths], "top": nodes[0]})

    return run


def _parent(run_: list[bytes]) -> bytes:
    return hashlib.sha256("".join(x.hex() for x in run_).encode()).digest()


def _reduced(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Rounds of ``nodes(tree, idx, n, id, digest, claimed)``: each a table (tree, bucket, idx, left, id, digest, claimed, path, top); left: levels to the tree's root."""
    left = sum(((F.col("n") > F.lit(fanout**j).cast("long")).cast("int") for j in range(64) if fanout**j < 2**62), F.lit(0))
    nodes, rounds = nodes.withColumn("left", left).drop("n"), []
    schema = "tree string, bucket long, idx long, left int, id string, digest binary, claimed binary, path binary, top binary"
    while True:
        dealt = nodes.select("tree", F.expr(f"idx div {fanout**levels}").alias("bucket"), "idx", "left", "id", "digest", "claimed")
        rounds.append(materialize(dealt.groupBy("tree", "bucket").applyInPandas(_collapse(fanout, levels), schema), "collapsed"))
        above = rounds[-1].where(F.col("left") > levels)
        if above.isEmpty():
            return rounds
        none = F.lit(None)
        nodes = above.groupBy("tree", "bucket").agg(F.first("top").alias("digest"), F.first("left").alias("left")).select(
            "tree", F.col("bucket").alias("idx"), none.cast("string").alias("id"), "digest", none.cast("binary").alias("claimed"), (F.col("left") - levels).alias("left"))


def _roots(rounds: list[DataFrame], levels: int) -> DataFrame:
    """Rows (tree, top): the root of each tree, from the round that reaches it."""
    ends = [r.where(F.col("left") <= levels).groupBy("tree").agg(F.first("top").alias("top")) for r in rounds]
    out = ends[0]
    for e in ends[1:]:
        out = out.union(e)
    return out


def _with_paths(rounds: list[DataFrame], levels: int, top: DataFrame) -> DataFrame:
    """The first round's rows (tree, idx, id, digest, claimed) with the whole path and the other columns of ``top(tree, path, ...)``.

    Each join is by tree and bucket, of which no key has more rows than a bucket.
    """
    kept = [c for c in top.columns if c not in ("tree", "path")]
    above = None
    for r in reversed(rounds):
        ends = r.where((F.col("left") <= levels)).select("tree").distinct().join(top, "tree").select("tree", F.lit(0).cast("long").alias("bucket"), F.col("path").alias("rest"), *kept)
        above = ends if above is None else ends.unionByName(above.select("tree", F.col("idx").alias("bucket"), F.col("path").alias("rest"), *kept))
        above = r.drop("top", "left").join(above, ["tree", "bucket"]).withColumn("path", F.concat("path", "rest")).drop("rest", "bucket")
    return above


def manifest(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Rows (source, doc_id, leaf, claimed, subroot, root, path) for ``leaves(source, doc_id, leaf, claimed)``, digests as binary.

    A path has for each level up to the root: a byte for the place in the run, a byte for the number of others, and their digests. A null source is
    a source, before all others; null ids come first in theirs; rows with one id are ordered by leaf, and repeated rows have a leaf each. An empty table
    gives an empty result.
    """
    if not 2 <= fanout <= 255 or levels < 1:
        raise ValueError("a run has 2 to 255 nodes, and a bucket at least one level")
    # "=" before a source's name stands above "-" for none, and leaves the order of names as it is
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    number = F.col("doc_id").cast("long")
    nodes = leaves.select(tree.alias("tree"), number.alias("number"), number.cast("string").alias("id"), F.col("leaf").alias("digest"), "claimed", F.monotonically_increasing_id().alias("tie"))
    # the last parts equal rows, so that many of them don't fall into one range
    rounds = _reduced(numbered(nodes, ["number", "digest", "claimed", "tie"]).drop("number", "tie"), fanout, levels)
    subroots = _roots(rounds, levels).select(F.lit("all").alias("tree"), F.col("tree").alias("id"), F.col("top").alias("digest"), F.lit(None).cast("binary").alias("claimed"))
    upper = _reduced(numbered(subroots, ["id"]), fanout, levels)
    root = _roots(upper, levels).select("tree", F.lit(b"").alias("path"), F.col("top").alias("root"))
    sources = _with_paths(upper, levels, root).select(F.col("id").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    found = _with_paths(rounds, levels, materialize(sources, "subroots"))
    source = F.when(F.col("tree") != "-", F.substring("tree", 2, 2**31 - 1))
    return found.select(source.alias("source"), F.col("id").cast("long").alias("doc_id"), F.col("digest").alias("leaf"), "claimed", "subroot", "root", "path")


def siblings(path: bytes) -> list[tuple[int, list[bytes]]]:
    """Of each level the place in the run and the digests of the others."""
    out, at = [], 0
    while at < len(path):
        place, others = path[at], path[at + 1]
        out.append((place, [path[at + 2 + SIZE * k : at + 2 + SIZE * (k + 1)] for k in range(others)]))
        at += 2 + SIZE * others
    return out


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path give."""
    for place, others in siblings(path):
        leaf = _parent(others[:place] + [leaf] + others[place:])
    return leaf


def verified(found: DataFrame) -> DataFrame:
    """A manifest's rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) in hex: the claimed leaves folded with the kept siblings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, claims = batch.column("path").to_pylist(), batch.column("claimed").to_pylist()
            proofs = [hashlib.sha256("".join(x.hex() for _, others in siblings(p) for x in others).encode()).hexdigest() for p in paths]
            folded = [fold(c, p).hex() for c, p in zip(claims, paths)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "leaf", "subroot", "root")), pa.array(proofs, pa.string()), pa.array(folded, pa.string())], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    hexed = found.select("doc_id", *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")], "claimed", "path")
    out = hexed.mapInArrow(lean(run), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
