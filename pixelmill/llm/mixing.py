"""Mix sources to target weights: fixed-length blocks, drawn counts a shard, and index permutations.

The words of each source are laid end to end (in an order given by a hash of doc_id) and cut into blocks of ``block`` words.
The mix has a slot for each block that it takes. Output shards draw how many slots each source gets: multinomial counts,
given the sources' totals (so the totals are met), by halving the range of shards again and again with a generator seeded by the range;
every shard finds its counts, and where it begins in each source, by itself. Slot j of a source
with B blocks takes block ``perm(j mod B)`` of pass ``j div B``, where perm is a keyed Feistel permutation of that source and pass.
Slots and blocks are joined by index; a source of any size is spread over its blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.llm.common import lean, materialize, text_batches
from pixelmill.llm.words import mix

BLOCK, SHARD_SLOTS, REPEATS, WEIGHTS = 64, 4096, 3, (5, 2, 1)
#: Rows of a source that are added up together, and such buckets whose sums are.
BUCKET_ROWS, BUCKETS = 1000, 4096
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> list[float]:
    """Words that each source gives: all words shared by weight, none above ``repeats`` times its own."""
    left, active, out = float(sum(sizes)), list(range(len(sizes))), [0.0] * len(sizes)
    share = [weights[k % len(weights)] for k in active]
    while active:
        total = sum(share[k] for k in active)
        over = [k for k in active if left * share[k] / total > repeats * sizes[k]]
        for k in over or active:
            out[k] = float(repeats * sizes[k]) if over else left * share[k] / total
        if not over:
            break
        left -= sum(out[k] for k in over)
        active = [k for k in active if k not in set(over)]
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of ``index`` under a pseudorandom permutation of 0 .. n - 1: a Feistel network, walked until it lands inside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, key64 = np.uint64((1 << half) - 1), np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            left, right = right, left ^ (mix(right + key64 + np.uint64(r << 56)) & mask)
        out[todo] = x = (left << np.uint64(half)) | right
        todo = todo[x >= n]
    return out.astype(np.int64)


def _subset(counts: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``k`` different items, drawn evenly from kinds with ``counts`` items, are of each kind."""
    ends, drawn = np.cumsum(counts), np.empty(0, np.int64)
    while len(drawn) < k:  # an item that is drawn again is drawn anew
        drawn = np.unique(np.r_[drawn, rng.integers(0, int(ends[-1]), k - len(drawn))])
    return np.bincount(np.searchsorted(ends, drawn, side="right"), minlength=len(counts)).astype(np.int64)


def halve(quota: np.ndarray, part: int, rng: np.random.Generator, most: int = 900_000_000) -> np.ndarray:
    """How many of ``part`` slots, drawn evenly from all slots of the sources, are of each source.

    Above ``most`` slots, the range of numpy's generator, each slot is drawn with the same chance by itself, which leaves some too many or too few;
    as many are then taken away, or added, evenly. Any draw of ``part`` slots is as likely as any other in both ways.
    """
    total = int(quota.sum())
    if total < most:
        return rng.multivariate_hypergeometric(quota, part, method="marginals")
    left = rng.binomial(quota, part / total).astype(np.int64)
    extra = int(left.sum()) - part
    return left - _subset(left, extra, rng) if extra > 0 else left + _subset(quota - left, -extra, rng) if extra else left


def shard_counts(quota: np.ndarray, shard: int, shards: int, slots: int, seed: int, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in a shard, and in all shards before it; ``known`` keeps halves that later shards ask for again."""
    lo, hi, before = 0, shards, np.zeros_like(quota)
    total, known = int(quota.sum()), {} if known is None else known
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = known.get((lo, hi))
        if left is None:
            if len(known) > 1000:
                known.clear()
            part = min(total, mid * slots) - lo * slots
            known[lo, hi] = left = halve(quota, part, np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            quota, hi = left, mid
        else:
            before, quota, lo = before + left, quota - left, mid
    return quota, before


def _slots(quota: np.ndarray, blocks: np.ndarray, shards: int, slots: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                counts, before = shard_counts(quota, shard, shards, slots, seed, known)
                sid = np.repeat(np.arange(len(counts)), counts)
                j = np.concatenate([np.arange(b, b + c) for b, c in zip(before, counts, strict=True)] or [np.empty(0, np.int64)])
                turn, block = np.empty_like(j), np.empty_like(j)
                for s in np.unique(sid):
                    at = np.flatnonzero(sid == s)
                    turn[at] = j[at] // blocks[s]
                    for t in np.unique(turn[at]):
                        k = at[turn[at] == t]
                        block[k] = permuted(j[k] % blocks[s], int(blocks[s]), int(np.random.SeedSequence([seed, int(s), int(t)]).generate_state(1, np.uint64)[0]))
                place = np.random.default_rng([seed, shards, shard]).permutation(len(j))
                cols = (np.full(len(j), shard), place, sid, turn, block)
                yield pa.record_batch([pa.array(c.astype(np.int64)) for c in cols], names=["shard", "slot", "sid", "turn", "block"])

    return run


class Mix:
    """The plan of a mix: ``rows`` (doc_id, h, sid, size, start), ``sources``, ``slots`` and ``pieces`` (a row's part of a block)."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 11):
        spark = docs.sparkSession
        text = F.col("text").cast("string")
        sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("h"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
        sized = materialize(sized, "sized")
        found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["size"] for r in found]
        goal = targets(sizes)
        blocks = np.array([max(1, -(-s // block)) for s in sizes], np.int64)
        quota = np.array([round(t * b / s) if s else 0 for t, b, s in zip(goal, blocks, sizes, strict=True)], np.int64)
        many = [-(-r["n"] // BUCKET_ROWS) for r in found]
        self.sources = spark.createDataFrame([(k, r["source"], s, t, m) for k, (r, s, t, m) in enumerate(zip(found, sizes, goal, many, strict=True))], "sid long, source string, source_size long, target double, many long")
        rows = sized.join(F.broadcast(self.sources) if len(found) <= 100_000 else self.sources, sized["source"].eqNullSafe(self.sources["source"])).select("doc_id", "h", "size", "sid", "source_size", "target", "many")
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.col("many")))
        # sums of a source's rows: within buckets, of buckets within groups, and of groups, so no window holds a whole source
        sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("total")).withColumn("group", F.floor(F.col("bucket") / BUCKETS))
        groups = sums.groupBy("sid", "group").agg(F.sum("total").alias("total"))
        groups = groups.select("sid", "group", (F.sum("total").over(Window.partitionBy("sid").orderBy("group")) - F.col("total")).alias("first"))
        base = sums.withColumn("base", F.sum("total").over(Window.partitionBy("sid", "group").orderBy("bucket")) - F.col("total")).join(groups, ["sid", "group"])
        base = base.select("sid", "bucket", (F.col("base") + F.col("first")).alias("base"))
        inside = Window.partitionBy("sid", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("end", F.sum("size").over(inside)).join(base, ["sid", "bucket"])
        self.rows = materialize(rows.select("doc_id", "h", "size", "sid", "source_size", "target", (F.col("base") + F.col("end") - F.col("size")).alias("start")), "placed")
        total = int(quota.sum())
        shards = max(1, -(-total // shard_slots))
        plan = _slots(quota, blocks, shards, shard_slots, seed)
        self.slots = spark.range(0, shards if total else 0, 1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(lean(plan), "shard long, slot long, sid long, turn long, block long")
        first, end = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
        pieces = self.rows.where("size > 0").select("doc_id", "h", "sid", "start", "size", F.explode(F.sequence(first, end)).alias("block"))
        self.pieces = pieces.select(
            "doc_id", "h", "sid", "start", "block", (F.greatest(F.col("block") * block, "start") - F.col("start")).alias("skip"),
            (F.least((F.col("block") + 1) * block, F.col("start") + F.col("size")) - F.greatest(F.col("block") * block, "start")).alias("words"))
        # Spark guesses the slots' size from the few shards they are made from; the hint keeps it from broadcasting them
        self.uses = self.slots.groupBy("sid", "block").agg(F.count("*").alias("uses")).hint("merge")

    def taken(self) -> DataFrame:
        """Rows (doc_id, size, source_size, target, taken)."""
        used = self.pieces.join(self.uses, ["sid", "block"]).groupBy("sid", F.col("start").alias("start")).agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
        joined = self.rows.join(used, ["sid", "start"], "left")
        return joined.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"))


def mix_counts(docs: DataFrame, **plan) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken) for ``docs(doc_id, text, source)``; other columns are not read.

    Sources in code point order, null last, weigh 5, 2, 1, repeating; the empty name is a source too. A null or empty text has size 0 and
    nothing is taken. Repeated rows are placed one by one, rows without doc_id like any. An empty table gives an empty result.
    Of the sources, the driver holds a row each.
    """
    return Mix(docs, **plan).taken()


def _cut(block_of: str):
    word = re.compile(rb"[^\x20\x09-\x0D]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, parts in zip(batch.column("text").to_pylist(), batch.column(block_of).to_pylist(), strict=True):
                spans = [m.span() for m in word.finditer(text)]
                pieces = []
                for turn in range(max(p["uses"] for p in parts)):
                    open_at = last = -1
                    for p in sorted(parts, key=lambda p: (p["start"], p["skip"])):
                        if p["uses"] <= turn:
                            continue
                        if p["skip"] == 0 or p["skip"] != last:
                            if open_at >= 0:
                                pieces.append(text[spans[open_at][0] : spans[last - 1][1]])
                            open_at = p["skip"]
                        last = p["skip"] + p["words"]
                    if open_at >= 0:
                        pieces.append(text[spans[open_at][0] : spans[last - 1][1]])
                out.append(b"\n".join(pieces))
            keep = [c for c in batch.schema.names if c not in ("text", block_of)]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "mixed"])

    return run


def mix_documents(docs: DataFrame, **plan) -> DataFrame:
    """``docs(doc_id, text, source, ...)``, with all its columns, and as text what the mix takes of each: neighbouring blocks in one
    piece, pieces and repeats on lines of their own. Documents of which nothing is taken go; n_chars, if there, is counted anew.

    Repeated rows (equal doc_id and text) become one row with the pieces of all, in the other columns the one with the least hash.
    """
    m = Mix(docs, **plan)
    used = m.pieces.join(m.uses, ["sid", "block"]).groupBy(F.col("doc_id").alias("i"), F.col("h").alias("k")).agg(F.collect_list(F.struct("start", "skip", "words", "uses")).alias("parts"))
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(c) for c in others]).alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("i"))
    rows = rows.withColumn("k", F.xxhash64("text")).groupBy("i", "k").agg(F.first("text").alias("text"), F.min_by("row", F.xxhash64("row")).alias("row"))
    joined = rows.join(used.withColumnsRenamed({"i": "_i", "k": "_k"}), F.col("i").eqNullSafe(F.col("_i")) & (F.col("k") == F.col("_k"))).select("row", F.col("text").cast("binary").alias("text"), "parts")
    schema = T.StructType([rows.schema["row"], T.StructField("mixed", T.BinaryType())])
    with text_batches(docs.sparkSession):
        cut = materialize(joined.mapInArrow(lean(_cut("parts")), schema), "mixed")
    text = F.col("mixed").cast("string")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def packed_blocks(docs: DataFrame, **plan) -> DataFrame:
    """The mix itself: rows (shard, slot, source, turn, block, doc_ids, text), one a slot, in the order (shard, slot)."""
    m = Mix(docs, **plan)
    one = m.pieces.select("doc_id", "h", "sid", "block", F.array(F.struct("start", "skip", "words", F.lit(1).cast("long").alias("uses"))).alias("_parts"), "start")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).withColumn("_h", F.xxhash64("text")).dropDuplicates(["_id", "_h"])
    joined = one.join(rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    with text_batches(docs.sparkSession):
        cut = joined.select("sid", "block", "start", "doc_id", F.col("text").cast("binary").alias("text"), "_parts").mapInArrow(lean(_cut("_parts")), "sid long, block long, start long, doc_id long, mixed binary")
        cut = materialize(cut, "cut")
    filled = cut.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("start", "doc_id", F.col("mixed").cast("string").alias("t")))).alias("p"))
    out = m.slots.hint("merge").join(filled, ["sid", "block"]).join(F.broadcast(m.sources.select("sid", "source")), "sid")
    return out.select("shard", "slot", "source", "turn", "block", F.col("p.doc_id").alias("doc_ids"), F.array_join("p.t", " ").alias("text"))
