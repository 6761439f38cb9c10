"""Evaluation: confusion tables and what follows from them, a row an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.operators.ranks import running

KEY = ["img"]


def confusion(seg: DataFrame, truth: str, pred: str) -> DataFrame:
    """Counts (img, truth, pred, n)."""
    return seg.groupBy(*KEY, truth, pred).agg(F.count("*").alias("n"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(seg: DataFrame, truth: str, pred: str) -> DataFrame:
    """Rows (img, ars): the adjusted Rand score; 1 where both segmentations have one label, or each pixel its own."""
    c = confusion(seg, truth, pred)
    total = c.groupBy(*KEY).agg(F.sum(_pairs(F.col("n"))).alias("s"), F.sum("n").alias("t"))
    sides = [c.groupBy(*KEY, side).agg(F.sum("n").alias("m")).groupBy(*KEY).agg(F.sum(_pairs(F.col("m"))).alias(name)) for side, name in ((truth, "a"), (pred, "b"))]
    j = total.join(sides[0], KEY).join(sides[1], KEY)
    expected = F.col("a") * F.col("b") / _pairs(F.col("t"))
    most = (F.col("a") + F.col("b")) / 2
    return j.select(*KEY, F.when(most == expected, 1.0).otherwise((F.col("s") - expected) / (most - expected)).alias("ars"))


def tp_tn_fp_fn(seg: DataFrame, truth: str, pred: str, positive: int | None = None) -> DataFrame:
    """Rows (img, tp, tn, fp, fn, fpfn_tpfn, tpfp_tpfn).

    fp counts positives predicted negative and fn the reverse, as users of these names expect here. Null where an image has more than two labels; one label
    counts all pixels as tp. The positive label is the largest unless given and present.
    """
    both = seg.select(*KEY, F.explode(F.array_distinct(F.array(truth, pred))).alias("_l")).groupBy(*KEY).agg(F.sort_array(F.collect_set("_l")).alias("_u"))
    c = confusion(seg, truth, pred).join(both, KEY)
    last = F.element_at("_u", -1)
    pos = last if positive is None else F.when(F.array_contains("_u", positive), F.lit(positive)).otherwise(last)
    t, p, n = F.col(truth) == pos, F.col(pred) == pos, F.col("n")
    s = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    out = c.groupBy(*KEY, "_u").agg(s(t & p).alias("tp"), s(~t & ~p).alias("tn"), s(t & ~p).alias("fp"), s(~t & p).alias("fn"))
    out = out.select(*KEY, *[F.when(F.size("_u") <= 2, F.col(k)).alias(k) for k in ("tp", "tn", "fp", "fn")])
    tpfn = F.col("tp") + F.col("fn")
    a = F.when(F.col("fp") + F.col("fn") == 0, 0.0).otherwise((F.col("fp") + F.col("fn")) / tpfn)
    b = F.when(tpfn == 0, 0.0).otherwise((F.col("tp") + F.col("fp")) / tpfn)
    return out.withColumns({"fpfn_tpfn": a, "tpfp_tpfn": b})


def per_class(seg: DataFrame, truth: str, pred: str) -> DataFrame:
    """Rows (img, label, support, precision, recall, f1); a rate without cases is 0."""
    c = confusion(seg, truth, pred)
    rows = c.groupBy(*KEY, F.col(truth).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"))
    cols = c.groupBy(*KEY, F.col(pred).alias("label")).agg(F.sum("n").alias("found"))
    j = rows.join(cols, [*KEY, "label"], "full").fillna(0)
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    j = j.withColumns({"precision": rate("tp", "found"), "recall": rate("tp", "support")})
    f1 = F.when(F.col("support") + F.col("found") > 0, 2 * F.col("tp") / (F.col("support") + F.col("found"))).otherwise(0.0)
    return j.select(*KEY, "label", "support", "precision", "recall", f1.alias("f1"))


def averages(seg: DataFrame, truth: str, pred: str) -> DataFrame:
    """Rows (img, accuracy, and macro and weighted precision, recall and f1)."""
    p = per_class(seg, truth, pred)
    names = ("precision", "recall", "f1")
    weight = lambda k: F.sum(F.col(k) * F.col("support")) / F.sum("support")
    return p.groupBy(*KEY).agg(weight("recall").alias("accuracy"), *[F.avg(k).alias(f"{k}_macro") for k in names], *[weight(k).alias(f"{k}_weighted") for k in names])


def jaccard(seg: DataFrame, truth: str, pred: str) -> DataFrame:
    """Rows (img, label, jaccard) of equal labels of two segmentations."""
    c = confusion(seg, truth, pred)
    a = c.groupBy(*KEY, F.col(truth).alias("label")).agg(F.sum("n").alias("a"), F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)).alias("i"))
    b = c.groupBy(*KEY, F.col(pred).alias("label")).agg(F.sum("n").alias("b"))
    return a.join(b, [*KEY, "label"], "full").fillna(0).select(*KEY, "label", (F.col("i") / (F.col("a") + F.col("b") - F.col("i"))).alias("jaccard"))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (name, count, mean, std, min, q25, median, q75, max): std is that of a sample, quartiles interpolate."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*")
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = long.groupBy("name").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), q.alias("q"), F.max("v").alias("max"))
    return out.select("name", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "max")


def roc(scores: DataFrame, truth: str, score: str) -> DataFrame:
    """Rows (score, tpr, fpr) of the ROC curve of a binary truth, one a distinct score, best first.

    Scores are counted first; the running sums then go over ranges of the distinct scores.
    """
    n = scores.groupBy(score).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.count("*").alias("t"))
    every = n.agg(F.sum("p").alias("_all_p"), F.sum("t").alias("_all"))
    run = running(n, [F.desc(score)], {"tp": F.col("p"), "fp": F.col("t") - F.col("p")})
    return run.join(F.broadcast(every), F.lit(True)).select(F.col(score).alias("score"), (F.col("tp") / F.col("_all_p")).alias("tpr"), (F.col("fp") / (F.col("_all") - F.col("_all_p"))).alias("fpr"))


def label_shares(px: DataFrame, label: str) -> DataFrame:
    """Rows (img, label, share): the share of an image's pixels that each label has."""
    n = px.groupBy(*KEY, label).agg(F.count("*").alias("_n"))
    return n.select(*KEY, label, (F.col("_n") / F.sum("_n").over(Window.partitionBy(*KEY))).alias("share"))


def segment_probability(px: DataFrame, segment: str, label: str, chances: list[float]) -> DataFrame:
    """Rows (img, segment, p): the mean, over a segment's pixels, of the chance that its label is foreground."""
    table = F.array(*map(F.lit, chances))
    return px.groupBy(*KEY, segment).agg(F.avg(table[F.col(label)]).alias("p"))
