"""N-gram Jaccard self-join by a size-aware heavy-light split.

A document is the set of its distinct word shingles. Two sets link when ``100 * |A & B| >= threshold * |A | B|``. All links
between different sets are found, for all sizes; equal sets are one class from the start.

Method. Shingles have one global order: those known to be frequent last (rarest first), else by hash. If two sets
link, their overlap is at least ``t = ceil(threshold * n / 100)`` for either size n, so that any k common shingles that come
first in that order lie among the first ``n - t + k`` of both.

* light sets (n <= boundary) enumerate all 2-subsets of their first ``n - t + 2`` shingles: linked light sets share a subset;
* heavy sets post their first ``n - t + 1`` shingles to inverted lists, which are scanned; light sets large enough
  to link with a heavy one post there too;
* the boundary is the size at which enumerating costs as much as posting and scanning, from the histogram
  of all sizes and the mean list length.

Lists never turn into all their pairs. First the sets of a list are compared with one of them; the verified links give
components; then only pairs of a list in different components, with sizes and places that allow a link, are verified. A list of over ``LIST`` sets
is cut into blocks, and its pairs of blocks are groups of their own; sets of its largest component meet only those of others there.
Before sets are fetched, bitmaps of 2 to 4 bits an element bound the intersection from above: a bit that only one set
has stands for an element that only this set has. What passes is verified by the exact sets.
The frequent shingles only choose the order, so the result doesn't depend on how well they were found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import connected_components, lean, materialize, text_batches
from pixelmill.llm.words import WordHashes, mix, shingle_set

#: Shingles gathered in a task before those seen again in it are reported.
CHUNK = 500_000
#: Sets of a list that are compared in one go; longer lists are cut. Salt of joins by list.
LIST, SALT = 4096, 8
#: Frequent shingles and chosen documents are broadcast up to so many (8 bytes each), else joined by shuffle.
MAX_BROADCAST = 2_000_000


def _set_id(s: np.ndarray) -> int:
    """64-bit id of a set: a sum and a size, mixed, so that equal sets get equal ids."""
    with np.errstate(over="ignore"):
        x = mix(s).sum() + mix(np.asarray([len(s)], np.uint64))[0]
    return int(np.asarray([x], np.uint64).view(np.int64)[0])


def _bitmap(s: np.ndarray) -> bytes:
    """Bits of the elements' hashes, as many as the power of two from twice to four times their number, 64 at least."""
    m = max(64, 1 << (2 * len(s) - 1).bit_length())
    bits = np.zeros(m, np.uint8)
    bits[(s & np.uint64(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _may_link(percent: int):
    """The pairs (p, q) whose bitmaps allow a link."""

    def most(a: bytes, b: bytes, n: int, m: int) -> int:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        while len(x) > len(y):
            x = x[: len(x) // 2] | x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] | y[len(y) // 2 :]
        return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(c).to_pylist() for c in ("x", "y", "n", "m"))
            keep = [(100 + percent) * most(*x) >= percent * (x[2] + x[3]) for x in zip(a, b, n, m, strict=True)]
            yield batch.select(["p", "q", "cp", "cq"]).filter(pa.array(keep, pa.bool_()))

    return run


PROFILE = "kind int, a long, b long, c long, bits binary"


def _profile(width: int):
    """Rows of kind 0: (doc_id, size, id, bitmap) of each set; of kind 1: shingles seen again and how often."""
    names = ["kind", "a", "b", "c", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held, n_held = WordHashes(), [], 0

        def frequent():
            v, c = np.unique(np.concatenate(held), return_counts=True)
            v, c = v[c > 1].view(np.int64), c[c > 1]
            return pa.record_batch([pa.array(np.ones(len(v), np.int32)), pa.array(v), pa.array(c.astype(np.int64)), pa.array(np.zeros(len(v), np.int64)), pa.nulls(len(v), pa.binary())], names=names)

        seen: set[int] = set()
        for batch in batches:
            n, ids, bits = [], [], []
            for text in batch.column("text"):
                s = shingle_set(cache, text.as_py(), width)
                n.append(len(s))
                bits.append(_bitmap(s) if len(s) else None)
                ids.append(_set_id(s) if len(s) else 0)
                if len(s) and ids[-1] not in seen:
                    seen.add(ids[-1])
                    held.append(s)
                    n_held += len(s)
                if n_held >= CHUNK:
                    yield frequent()
                    held, n_held = [], 0
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.record_batch([pa.array(np.zeros(len(n), np.int32)), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(bits, pa.binary())], names=names)
        if held:
            yield frequent()

    return run


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _signatures(width: int, percent: int, boundary: int, hot: np.ndarray, hot_n: np.ndarray):
    """Rows (sig, fp, n, pos): lists to which a set belongs; pos is such that at most 1 + (n - pos - 1) can be common."""
    pairs: dict[int, tuple] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = WordHashes(), set()
        for batch in batches:
            sig, fp, size, pos = [], [], [], []
            rows = 0
            for text in batch.column("text"):
                s = shingle_set(cache, text.as_py(), width)
                n = len(s)
                if n < 2:  # one shingle links with an equal set only
                    continue
                i = _set_id(s)
                if i in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(i)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    c = np.where(hot[at] == s, hot_n[at], 0)
                    if c.any():
                        s = s[np.argsort(c, kind="stable")]
                t = _needed(n, percent)
                if n <= boundary:
                    p = min(n, n - t + 2)
                    if p not in pairs:
                        pairs[p] = np.triu_indices(p, 1)
                    a, b = pairs[p]
                    lo, hi = np.minimum(s[a], s[b]), np.maximum(s[a], s[b])
                    sig.append(mix(lo * np.uint64(0x9E3779B97F4A7C15) + mix(hi)))
                    pos.append((b - 1).astype(np.int32))
                if n > boundary or 100 * n >= percent * (boundary + 1):
                    p = n - t + 1
                    sig.append(s[:p])
                    pos.append(np.arange(p, dtype=np.int32))
                k = sum(map(len, sig)) - rows
                rows += k
                fp.append(np.full(k, i, np.int64))
                size.append(np.full(k, n, np.int32))
                if rows > 100_000:
                    yield _posting(sig, fp, size, pos)
                    sig, fp, size, pos, rows = [], [], [], [], 0
            if rows:
                yield _posting(sig, fp, size, pos)

    return run


def _posting(sig, fp, size, pos) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(fp)), pa.array(np.concatenate(size)), pa.array(np.concatenate(pos))], names=["sig", "fp", "n", "pos"])


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _shared():
    """From postings sorted by (sig, n, fp): those in lists of two sets at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last posting, which waits for its successor
        goes_on = False  # whether its list began before it
        for batch in batches:
            cols = _columns(batch)
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            sig = cols[0]
            if not len(sig):
                continue
            m = len(sig) - 1
            inside = np.r_[goes_on, sig[1:] == sig[:-1]]
            at = np.flatnonzero(inside[:m] | inside[1:])
            held, goes_on = [c[m:] for c in cols], bool(inside[m])
            if len(at):
                yield pa.record_batch([pa.array(c[at]) for c in cols], names=["sig", "fp", "n", "pos"])
        if goes_on:
            yield pa.record_batch([pa.array(c) for c in held], names=["sig", "fp", "n", "pos"])

    return run


def _pairs(a: tuple, b: tuple, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a set of ``a`` and one of ``b`` (fp, n, pos, comp; ``b`` by size) in different components, with sizes and places that allow a link."""
    block = 2048
    (fp, n, pos, comp), (fq, m, qos, comq) = a, b
    n, m = n.astype(np.int64), m.astype(np.int64)
    rest, rest_q = n - pos - 1, m - qos - 1
    for a0 in range(0, len(fp), block):
        x = slice(a0, a0 + block)
        first = int(np.searchsorted(m, -(-percent * int(n[x].min()) // 100)))
        last = int(np.searchsorted(m, 100 * int(n[x].max()) // percent, side="right"))
        for b0 in range(first, last, block):
            y = slice(b0, min(b0 + block, last))
            ok = (comp[x, None] != comq[None, y]) & ((100 + percent) * (1 + np.minimum(rest[x, None], rest_q[None, y])) >= percent * (n[x, None] + m[None, y]))
            i, j = np.nonzero(ok)
            i, j = a0 + i, b0 + j
            if a is b:
                i, j = i[i < j], j[i < j]
            if len(i):
                low = fp[i] < fq[j]
                yield pa.record_batch([pa.array(np.where(low, u, v)) for u, v in ((fp[i], fq[j]), (fq[j], fp[i]), (comp[i], comq[j]), (comq[j], comp[i]))], names=["p", "q", "cp", "cq"])


def _across(percent: int):
    """From lists sorted by (sig, n, fp), none of more than ``LIST`` sets: their ``_pairs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            cols = _columns(batch)
            if held:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            cut = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b - a > 1:
                    one = tuple(c[a:b] for c in cols[1:])
                    yield from _pairs(one, one, percent)
            held = [c[cut[-1] :] for c in cols]
        if held and len(held[0]) > 1:
            yield from _pairs(tuple(held[1:]), tuple(held[1:]), percent)

    return run


def _between(percent: int):
    """``_pairs`` of the two sides of a group."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cols = [table.column(c).to_numpy() for c in ("fp", "n", "pos", "comp")]
        side, order = table.column("side").to_numpy(), np.argsort(cols[1], kind="stable")
        a, b = (tuple(c[order[side[order] == k]] for c in cols) for k in (0, 1))
        found = list(_pairs(a, b, percent))
        return pa.Table.from_batches(found) if found else pa.table({c: pa.array([], pa.int64()) for c in ("p", "q", "cp", "cq")})

    return run


def _cut_lists(named: DataFrame, long: DataFrame, percent: int) -> DataFrame:
    """``_pairs`` of the ``long`` lists, by groups of two blocks: sets of a list's largest component with others, and others with each other."""
    parts = named.join(F.broadcast(long) if long.count() <= MAX_BROADCAST else long, "sig", "left_semi")
    of_comp = parts.groupBy("sig", "comp").agg(F.count("*").alias("k"))
    top = of_comp.groupBy("sig").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("all"))
    blocks = lambda c: F.ceil(c / LIST)
    top = top.select("sig", F.col("top.comp").alias("major"), blocks(F.col("top.k")).alias("majors"), blocks(F.col("all") - F.col("top.k")).alias("others"))
    rows = parts.join(top, "sig").withColumn("is_major", F.col("comp") == F.col("major"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("others"))))
    to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    group = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    own = F.col("block")
    with_others = F.transform(to("others"), lambda j: group("major", own, j, 0))
    with_major = F.transform(to("majors"), lambda i: group("major", i, own, 1))
    # a block meets itself with both sides full, another one once
    among = F.transform(to("others"), lambda j: F.struct(F.lit("other").alias("kind"), F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(own <= j, 0).otherwise(1).alias("side")))
    both = F.concat(with_major, among, F.array(group("other", own, own, 1)))
    rows = rows.withColumn("g", F.explode(F.when(F.col("is_major"), with_others).otherwise(both))).select("sig", "g.kind", "g.i", "g.j", "g.side", "fp", "n", "pos", "comp")
    return rows.groupBy("sig", "kind", "i", "j").applyInArrow(_between(percent), "p long, q long, cp long, cq long")


def _sets(width: int):
    """Rows (fp, items) of the sets of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            fps, sets, size = [], [], 0
            for text in batch.column("text"):
                s = shingle_set(cache, text.as_py(), width)
                fps.append(_set_id(s) if len(s) else 0)
                sets.append(s.view(np.int64))
                size += len(s)
                if size > 100_000:
                    yield pa.record_batch([pa.array(fps, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "items"])
                    fps, sets, size = [], [], 0
            if fps:
                yield pa.record_batch([pa.array(fps, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "items"])

    return run


def _boundary(sizes: list[tuple[int, int]], percent: int, list_length: float, top: int = 48) -> int:
    """The size up to which enumerating 2-subsets costs less than posting to lists and scanning them.

    A posting or a subset costs 1 to ship; a posting costs its list's mean length more to scan. Sets just below the boundary pay for both.
    """
    def cost(x: int) -> float:
        total = 0.0
        for n, k in sizes:
            t = _needed(n, percent)
            if n <= x:
                p = min(n, n - t + 2)
                total += k * p * (p - 1) / 2
            if n > x or 100 * n >= percent * (x + 1):
                total += k * (n - t + 1) * (1 + list_length)
        return total

    return min(range(top + 1), key=cost)


def similar_documents(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for the documents ``docs(doc_id, text)``; other columns are not read.

    component_id is the smallest doc_id reachable by links. A null or empty text, or one without words, is an empty set: it
    has its own doc_id as component. A row without doc_id links with nothing and has no component_id. Repeated rows come
    back repeated. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    with text_batches(spark):
        found = materialize(docs.mapInArrow(lean(_profile(width)), PROFILE), "profile")
        return _components(docs, found, width, percent)


def _components(docs: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows of ``similar_documents`` from the documents and the rows of ``_profile``.

    Sets are made from the texts again where they are needed: they are larger than the texts, and columns of them take much memory in the executors.
    """
    spark = found.sparkSession
    sets = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("fp"))
    frequent = found.where("kind = 1").groupBy("a").agg(F.sum("b").alias("b")).where("b >= 4")
    # which shingles count as frequent only decides an order, so the bound costs no result
    top = frequent.groupBy(F.floor(F.log2("b")).alias("e")).count().orderBy(F.desc("e")).collect()
    least, total = 4, 0
    for row in top:
        if total + row["count"] > MAX_BROADCAST:
            least = 2 ** (row["e"] + 1)
            break
        total += row["count"]
    rows = frequent.where(F.col("b") >= least).toArrow() if total else None
    hot = rows.column("a").to_numpy().view(np.uint64) if rows else np.empty(0, np.uint64)
    hot_n = rows.column("b").to_numpy() if rows else np.empty(0, np.int64)
    order = np.argsort(hot)
    hot, hot_n = hot[order], hot_n[order]
    sizes = sets.where("n > 0").groupBy(F.when(F.col("n") <= 64, F.col("n")).otherwise(F.floor(F.pow(F.lit(2.0), F.floor(F.log2("n")))).cast("long")).alias("s")).count().collect()
    cold = float(np.mean(hot_n)) if len(hot_n) else 1.0
    share = min(1.0, len(hot_n) * cold / max(1, sum(r["s"] * r["count"] for r in sizes)))
    boundary = _boundary([(r["s"], r["count"]) for r in sizes], percent, 1 + share * cold)

    share_hot = spark.sparkContext.broadcast((hot, hot_n))

    def sign(batches):
        return _signatures(width, percent, boundary, *share_hot.value)(batches)

    postings = docs.where("doc_id is not null").mapInArrow(lean(sign), "sig long, fp long, n int, pos int")
    lists = materialize(
        postings.repartition("sig").sortWithinPartitions("sig", "n", "fp")
        .mapInArrow(lean(_shared()), "sig long, fp long, n int, pos int"), "lists")

    representative = sets.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    maps = found.where("kind = 0 and b > 1").select(F.col("c").alias("fp"), F.col("b").alias("n"), "bits").dropDuplicates(["fp"])

    def joined(pairs: DataFrame) -> DataFrame:
        """Components (node, root) of the components cp and cq by the links among the pairs (p, q, cp, cq)."""
        x = maps.select(F.col("fp").alias("p"), F.col("n"), F.col("bits").alias("x"))
        y = maps.select(F.col("fp").alias("q"), F.col("n").alias("m"), F.col("bits").alias("y"))
        likely = materialize(pairs.join(x, "p").join(y, "q").mapInArrow(lean(_may_link(percent)), "p long, q long, cp long, cq long"), "likely")
        ids = likely.select(F.col("p").alias("fp")).union(likely.select("q")).distinct()
        chosen = materialize(representative.join(ids, "fp", "left_semi").select("doc_id"), "chosen")
        if chosen.count() <= MAX_BROADCAST:
            chosen = F.broadcast(chosen)
        items = docs.join(chosen, "doc_id", "left_semi").select("text").mapInArrow(lean(_sets(width)), "fp long, items array<long>")
        links = _verified(likely, items.dropDuplicates(["fp"]), percent)
        return materialize(connected_components(links.select("cp", "cq").distinct(), "cp", "cq"), "joined")

    # Sets that link share many lists, so a sixteenth of the lists joins nearly all, and all of them the rest. In the first look a list's
    # sets are compared with one of them only: the one that shares lists with most others, as the original of edited copies does.
    every = None
    for share in (16, 16, 1):
        part = lists.where(F.pmod("sig", F.lit(share)) == 0)
        if every is None:
            degree = part.groupBy("fp").agg(F.count("*").alias("k"))
            hub = part.join(degree, "fp").groupBy("sig").agg(F.max_by(F.struct("fp", "n"), F.struct("k", "fp")).alias("hub"))
            hub = hub.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
            pairs = part.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALT)).cast("int")).join(hub, ["sig", "salt"]).where(f"fp <> hub.fp and 100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)")
            pairs = pairs.select(F.col("fp").alias("p"), F.col("hub.fp").alias("q"), F.col("fp").alias("cp"), F.col("hub.fp").alias("cq")).distinct()
            every = joined(pairs)
            continue
        named = part.join(every.withColumnRenamed("node", "fp"), "fp", "left").select("sig", "fp", "n", "pos", F.coalesce("root", "fp").alias("comp"))
        named = materialize(named, "named")
        mixed = materialize(named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k")).where("lo <> hi").select("sig", "k"), "mixed")
        pairs = (
            named.join(mixed.where(F.col("k") <= LIST).select("sig"), "sig", "left_semi").repartition("sig").sortWithinPartitions("sig", "n", "fp")
            .mapInArrow(lean(_across(percent)), "p long, q long, cp long, cq long"))
        long = mixed.where(F.col("k") > LIST).select("sig")
        if not long.isEmpty():
            pairs = pairs.union(_cut_lists(named, long, percent))
        pairs = pairs.where("p <> q").distinct()
        new = joined(pairs)
        moved = every.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        every = materialize(moved.union(new.join(every.select("node"), "node", "left_anti")), "every")

    classes = representative.join(every.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    least_id = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_set = classes.join(least_id, "root").select("fp", "component_id")
    return sets.join(of_set, "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).cast("long").alias("component_id"))


def _verified(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The components (cp, cq) of the pairs (p, q) of sets that link, by the exact size of their intersection."""
    a = items.select(F.col("fp").alias("p"), F.col("items").alias("a"))
    b = items.select(F.col("fp").alias("q"), F.col("items").alias("b"))
    both = pairs.join(a, "p").join(b, "q").select("cp", "cq", (F.size("a") + F.size("b")).alias("n"), F.size(F.array_intersect("a", "b")).alias("common"))
    return materialize(both.where(F.col("common") * 100 >= percent * (F.col("n") - F.col("common"))).select("cp", "cq"), "links")
