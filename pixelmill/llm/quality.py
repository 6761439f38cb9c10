"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Target text is what a bounded, documented sample labels as good (``LABELS`` rows); raw text is every document. Both give counts of
hashed single tokens and pairs, and of triples of token shapes (case, digits, marks, repetition). A document's ratio is the mean over its
n-grams of log p_target - log p_raw, so that length doesn't decide.

Importance weights are chances of target over raw. The mean ratio takes n-grams for independent, so its scale is off; a logistic curve,
fitted to labelled rows that were kept out of the target model, turns it into the chance p that the document is of the target. As raw text
holds the target, p is p_target over p_raw but for a constant. The log weight is ``SHARPNESS`` * log p, which is near 0 for
all target-like documents, however alike the models find them, and falls steeply beyond: among the former noise decides, between them and others the weight.
The sample has as many documents as the corpus rather has of the target than not: ``kept`` marks those with the largest keys, a key
being the log weight plus standard Gumbel noise. This is a sample without replacement, in which each next document is drawn with a chance in proportion
to its weight.

Toxic documents are no candidates. From three quarters of the sample come the phrases (tokens, their first letters, and pairs, in any case) that are in more
toxic texts than chance explains, with log ratios of toxic to other texts. A document's toxicity is the sum of its ``TOP`` largest
ratios of different phrases, so that a long text doesn't dilute a few words; the other quarter sets its bound.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import lean, materialize, text_batches
from pixelmill.llm.words import mix

BUCKETS, SHAPES, LABELS, PRIOR = 1 << 14, 16**3, 40_000, 5.0
#: Power of the chance that weighs, and the pull of the logistic curve's coefficients to 0.
SHARPNESS, RIDGE = 4.0, 0.01
TOP, MIN_TOXIC, STEM = 3, 3, 5
#: To lose a share of the other documents counts so many times as much as to let the same share of toxic ones pass.
CAUTION = 4.0
_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Tokens(dict):
    """Token to its place in arrays: a hash whose low three bits are its shape (lower, title, upper, digits, mark), a hash that doesn't depend on case, and
    one of its first ``STEM`` letters, 0 for tokens that aren't longer by two."""

    LIMIT = 100_000

    def __init__(self) -> None:
        super().__init__()
        self.plain, self.folded, self.stem = (np.zeros(1024, np.uint64) for _ in range(3))

    def places(self, tokens: list[bytes]) -> np.ndarray:
        if len(self) >= self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))

    def __missing__(self, token: bytes) -> int:
        self[token] = k = len(self)
        if k == len(self.plain):
            self.plain, self.folded, self.stem = (np.concatenate([x, np.zeros(k, np.uint64)]) for x in (self.plain, self.folded, self.stem))
        t = token.decode("utf-8", "replace")
        low = t.lower()
        shape = 3 if t.isdigit() else 4 if not t[0].isalnum() else 2 if len(t) > 1 and t.isupper() else 1 if t[0].isupper() else 0
        self.plain[k] = (xxhash.xxh3_64_intdigest(token) & ~7) | shape
        self.folded[k] = xxhash.xxh3_64_intdigest(low)
        self.stem[k] = xxhash.xxh3_64_intdigest(low[:STEM] + "*") if len(low) >= STEM + 2 else 0
        return k


def phrases(cache: Tokens, places: np.ndarray) -> np.ndarray:
    """Hashes of tokens, pairs of them and their stems, whatever their case."""
    h, begin = cache.folded[places], cache.stem[places]
    return np.concatenate([mix(h), mix(h[1:] * _A + h[:-1] * _B), begin[begin != 0]])


def _among(known: np.ndarray, low: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in ``known`` (sorted) of the different values of ``h`` that are there; ``low`` marks the low 16 bits of known ones."""
    h = h[low[(h & np.uint64(0xFFFF)).astype(np.int64)]]
    if not len(known) or not len(h):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.unique(at[known[at] == h])


def _low(known: np.ndarray) -> np.ndarray:
    low = np.zeros(1 << 16, bool)
    low[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
    return low


def features(cache: Tokens, places: np.ndarray) -> np.ndarray:
    """Bucket numbers of a text's n-grams: hashed ones below ``BUCKETS``, shapes from there on."""
    if not len(places):
        return np.empty(0, np.int64)
    h = cache.plain[places]
    again = np.r_[False, h[1:] == h[:-1]]
    shape = (h & np.uint64(7)).astype(np.int64) + 8 * again
    three = shape[2:] + 16 * shape[1:-1] + 256 * shape[:-2]
    return np.concatenate([(np.concatenate([mix(h), mix(h[1:] * _A + h[:-1] * _B)]) & np.uint64(BUCKETS - 1)).astype(np.int64), BUCKETS + three])


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = Tokens()
    for batch in batches:
        for text in batch.column("text"):
            yield pa.record_batch([pa.array(np.unique(phrases(cache, cache.places(_TOKEN.findall(text.as_py() or b"")))).view(np.int64))], names=["phrase"])


def _count(share):
    """Counts by bucket in all and in target texts; from ``BUCKETS + SHAPES`` on, of other and of toxic texts by suspected phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, toxic, suspects = share.value
        cache, low = Tokens(), _low(suspects)
        raw, target = np.zeros(BUCKETS + SHAPES + len(suspects), np.int64), np.zeros(BUCKETS + SHAPES + len(suspects), np.int64)
        size = BUCKETS + SHAPES
        for batch in batches:
            rows, fit = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                places = cache.places(_TOKEN.findall(text.as_py() or b""))
                rows.append(features(cache, places))
                if i in good:
                    fit.append(rows[-1])
                if i in toxic:
                    at = size + _among(suspects, low, phrases(cache, places))
                    (target if toxic[i] else raw)[at] += 1
            raw[:size] += np.bincount(np.concatenate(rows), minlength=size)
            target[:size] += np.bincount(np.concatenate(fit), minlength=size)
        at = np.flatnonzero(raw | target)
        yield pa.record_batch([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    return run


def _score(share):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, known, weight = share.value
        cache, low = Tokens(), _low(known)
        for batch in batches:
            n, w, t = [], [], []
            for text in batch.column("text"):
                places = cache.places(_TOKEN.findall(text.as_py() or b""))
                f = features(cache, places)
                n.append(len(f))
                w.append(float(ratio[f].sum()) / (len(f) + PRIOR))
                t.append(float(np.sort(weight[_among(known, low, phrases(cache, places))])[-TOP:].sum()) if len(known) else 0.0)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(w, pa.float64()), pa.array(t, pa.float64())], names=["doc_id", "n_grams", "ratio", "toxicity"])

    return run


def _toxic_phrases(suspects: np.ndarray, others: np.ndarray, toxics: np.ndarray, n_others: int, n_toxics: int) -> tuple[np.ndarray, np.ndarray]:
    """The suspects (sorted) in more toxic texts than chance explains, given their number, and their log ratios."""
    if not len(suspects) or not n_others or not n_toxics:
        return np.empty(0, np.uint64), np.empty(0)
    ratio = np.log((toxics + 0.5) / (n_toxics + 1)) - np.log((others + 0.5) / (n_others + 1))
    # likelihood ratio of a share of its own against the share of toxic texts
    both, p = toxics + others, n_toxics / (n_toxics + n_others)
    part = lambda k, q: k * np.log(np.maximum(k, 1) / np.maximum(both * q, 1e-300))
    gain = 2 * (part(toxics, p) + part(others, 1 - p))
    keep = (ratio > 0) & (gain > 2 * math.log(len(suspects)) + 9)
    return suspects[keep], ratio[keep]


def _bound(weights: list[float], good: list[bool]) -> float:
    """The weight that best parts good from bad rows, by the sum of ``CAUTION`` times the first rate and the second; half-way to the next bad one below."""
    rows = sorted(zip(weights, good, strict=True))
    goods, bads = sum(good), len(good) - sum(good)
    if not goods or not bads:
        return -math.inf
    best, bound, low, k = -1.0, -math.inf, 0, 0
    for j, (w, g) in enumerate(rows):  # rows before j go
        rate = CAUTION * (goods - k) / goods + low / bads
        if rate > best and (not j or w > rows[j - 1][0]):
            best, bound = rate, (w + rows[j - 1][0]) / 2 if j else -math.inf
        k, low = k + g, low + (not g)
    return bound


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest double of a column, by counting it in cells, then the cell that holds it in cells, and so on."""
    left = k
    bounds = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if not bounds[2] or k <= 0:
        return None
    if k >= bounds[2]:
        return float(bounds[0])
    lo, hi = float(bounds[0]), float(bounds[1])
    for _ in range(12):
        width = (hi - lo) / 4096
        if width <= 0 or lo + width == lo:
            break
        cell = F.least(F.floor((F.col(column) - lo) / width), F.lit(4095))
        counts = values.where((F.col(column) >= lo) & (F.col(column) <= hi)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("most")).orderBy(F.desc("cell")).collect()
        for r in counts:
            if left <= r["n"]:
                lo, hi = r["least"], r["most"]
                break
            left -= r["n"]
        if lo == hi:
            break
    return lo


def gumbel(key: Column, seed: Column) -> Column:
    """Standard Gumbel noise that follows from a key and a seed."""
    uniform = (F.pmod(F.xxhash64(key, seed), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def logistic(values: list[float], good: list[bool], ridge: float = RIDGE) -> tuple[float, float]:
    """Slope (not below 0) and intercept of the log odds of good by value: the likeliest, less ``ridge`` / 2 times both squared (of scaled values)."""
    goods, bads = sum(good), len(good) - sum(good)
    if not goods or not bads:
        return 0.0, math.inf
    x, y = np.array(values), np.array(good, float)
    mean, std = x.mean(), x.std() or 1.0
    z = np.column_stack([(x - mean) / std, np.ones(len(x))])
    c = np.zeros(2)

    def loss(c: np.ndarray) -> float:
        t = z @ c
        return float((np.logaddexp(0, t) - y * t).sum() + ridge / 2 * c @ c)

    for _ in range(200):  # Newton's steps, shortened until they lower the loss, which is convex
        p = 0.5 * (1 + np.tanh(z @ c / 2))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (p - y) + ridge * c)
        size, now = 1.0, loss(c)
        while size > 1e-9 and loss(c - size * step) > now:
            size /= 2
        c = c - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    if c[0] < 0:  # the ratio tells nothing: the share of good rows
        return 0.0, math.log(goods / bads)
    return c[0] / std, c[1] - c[0] * mean / std


def effective_size(selected: DataFrame) -> float:
    """Kish's effective sample size of the weights: how many equal ones they are worth."""
    w = F.exp("log_weight")
    row = selected.agg(F.sum(w).alias("s"), F.sum(w * w).alias("q")).first()
    return row["s"] ** 2 / row["q"] if row["q"] else 0.0


def select_documents(docs: DataFrame, labels: DataFrame, seed: int = 17, labels_used: int = LABELS, sharpness: float = SHARPNESS, size: int | None = None) -> DataFrame:
    """Rows (doc_id, n_grams, ratio, toxicity, p_target, log_weight, gumbel_key, kept) for ``docs(doc_id, text)`` and ``labels(doc_id, quality, toxic)``.

    ``size``: how many to sample, else the number of documents with p_target of a half or more that aren't toxic. Good rows have quality 1 and
    aren't toxic, bad ones have quality 0; rows with null quality count for toxicity only, those with null doc_id for nothing, and where labels
    disagree, bad and toxic win; quality and toxic are read as whole numbers, other text counts as null. Null or empty texts, and those without
    tokens, have ratio 0; a null doc_id is a value like any. Repeated rows get equal keys and share their fate; of rows with equal keys at the end of the sample all
    are kept. Without labels of both kinds all weights are equal and all are kept, but for toxic ones, which go wherever labels have toxic and other rows. Noise
    comes from the doc_id, so reruns agree. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").try_cast("int").alias("quality"), F.col("toxic").try_cast("int").alias("toxic"))
    lab = lab.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce(F.col("toxic"), F.lit(0))).alias("t"))
    # the bounded sample of labelled rows: those with the smallest hashes
    chosen = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labels_used).collect()
    good = [r["doc_id"] for r in chosen if r["q"] == 1 and r["t"] == 0]
    fit, toxic = frozenset(good[::2]), {}
    for t in (0, 1):  # three quarters of either kind, as marks of the texts to count
        toxic |= {i: t for k, i in enumerate(r["doc_id"] for r in chosen if (r["t"] == 1) == t) if k % 4}
    held = [(r["doc_id"], None if r["doc_id"] in fit or r["q"] is None or (r["q"] == 1 and r["t"]) else r["q"] == 1, None if r["doc_id"] in toxic else r["t"] == 1) for r in chosen]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    with text_batches(spark):
        scored = _scored(rows, fit, toxic)
    marks = spark.createDataFrame(held, "doc_id long, good boolean, toxic boolean")
    # a row each of a bounded sample
    seen = scored.join(F.broadcast(marks), "doc_id").select("doc_id", "ratio", "toxicity", "good", "toxic").dropDuplicates().collect() if held else []
    graded = [(r["ratio"], r["good"]) for r in seen if r["good"] is not None] if fit else []
    slope, shift = logistic([w for w, _ in graded], [g for _, g in graded])
    marked = [(-r["toxicity"], not r["toxic"]) for r in seen if r["toxic"] is not None]
    mild = _bound([w for w, _ in marked], [g for _, g in marked])
    odds = F.lit(slope) * F.col("ratio") + F.lit(shift)
    # log p, without losing digits where p is near 0 or 1
    log_p = F.when(odds > 0, -F.log1p(F.exp(-odds))).otherwise(odds - F.log1p(F.exp(odds)))
    scored = scored.withColumn("log_p", log_p).withColumn("p_target", F.exp("log_p")).withColumn("log_weight", F.lit(sharpness) * F.col("log_p"))
    scored = scored.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), F.lit(seed)))
    candidate = -F.col("toxicity") >= F.lit(mild)
    candidates = scored.where(candidate)
    if size is None:
        size = candidates.where(F.col("p_target") >= 0.5).count()
    least = kth_largest(candidates, "gumbel_key", size)
    kept = candidate & (F.col("gumbel_key") >= F.lit(math.inf if least is None else least))
    return scored.select("doc_id", "n_grams", "ratio", "toxicity", "p_target", "log_weight", "gumbel_key", kept.alias("kept"))


def _scored(rows: DataFrame, fit: frozenset, toxic: dict[int, int]) -> DataFrame:
    """Rows (doc_id, n_grams, ratio, toxicity) by models of the texts in ``fit`` and of those that ``toxic`` marks by 0 or 1."""
    spark = rows.sparkSession
    ids = [(i,) for i, t in toxic.items() if t]
    suspects = np.empty(0, np.uint64)
    if ids:
        texts = rows.join(F.broadcast(spark.createDataFrame(ids, "doc_id long")), "doc_id", "left_semi")
        suspects = np.sort(texts.mapInArrow(lean(_phrases), "phrase long").groupBy("phrase").count().where(F.col("count") >= MIN_TOXIC).select("phrase").toArrow().column("phrase").to_numpy().view(np.uint64))
    size = BUCKETS + SHAPES + len(suspects)
    share = spark.sparkContext.broadcast((fit, toxic, suspects))
    counts = rows.mapInArrow(lean(_count(share)), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(size), np.zeros(size)
    for r in counts:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    ratio = np.zeros(BUCKETS + SHAPES)
    for part in (slice(0, BUCKETS), slice(BUCKETS, BUCKETS + SHAPES)):
        p = [(c[part] + 0.5) / (c[part] + 0.5).sum() for c in (target, raw)]
        ratio[part] = np.log(p[0] / p[1])
    known, weight = _toxic_phrases(suspects, raw[BUCKETS + SHAPES :], target[BUCKETS + SHAPES :], len(toxic) - len(ids), len(ids))
    model = spark.sparkContext.broadcast((ratio, known, weight))
    scored = rows.mapInArrow(lean(_score(model)), "doc_id long, n_grams long, ratio double, toxicity double")
    return materialize(scored, "scored")
