import math
import random

import pytest

from pixelmill.llm.quality import gumbel, kth_largest, select_documents

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def clean(rng):
    return " ".join(rng.choice(["the", "of", "and", "word", "other", "thing", "place", "time"]) + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(20, 200)))


def junk(rng):
    w = clean(rng)
    return rng.choice([lambda: w.upper().replace(" ", "!! "), lambda: w.replace(" ", " | "), lambda: w.replace(" ", "%%% "), lambda: " ".join(x for x in w.split() for _ in range(8))])()


def test_held_out_accuracy(spark):
    rng = random.Random(8)
    truth = {k: rng.random() < 0.8 for k in range(900)}
    docs = [(k, clean(rng) if good else junk(rng)) for k, good in truth.items()]
    labels = [(k, int(good), 0) for k, good in truth.items() if k % 3 == 0]
    d = spark.createDataFrame(docs, DOCS).repartition(3).selectExpr("*", "text AS log_weight", "doc_id AS good")
    lab = spark.createDataFrame(labels, LABELS).selectExpr("*", "quality AS n_grams")
    got = {r["doc_id"]: r["kept"] for r in select_documents(d, lab).collect()}
    out = [k for k in truth if k % 3]
    assert sum(got[k] == truth[k] for k in out) >= 0.98 * len(out)
    assert all(got[k] for k in out if truth[k])
    assert got == {r["doc_id"]: r["kept"] for r in select_documents(d.orderBy("text"), lab).collect()}


@pytest.mark.parametrize("k", [0, 1, 3, 7, 50, 51, 99])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    v = [rng.choice([rng.gauss(0, 1), 1.5, 1e300, -1e-300]) for _ in range(51)]
    got = kth_largest(spark.createDataFrame([(x,) for x in v], "x double"), "x", k)
    assert got == (None if k == 0 else sorted(v)[::-1][min(k, 51) - 1])


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (None, "the word"), (4, "the word"), (4, "the word"), (5, "word " * 60_000), (6, "!!! ||| %%%" * 30)]
    d = spark.createDataFrame(docs, DOCS)
    labels = [(4, 1, 0), (4, 1, 0), (5, 1, None), (6, 0, 0), (None, 1, 0), (7, None, None), (8, 1, 1)]
    got = select_documents(d, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs) and all(math.isfinite(r["gumbel_key"]) for r in got) and len({r["gumbel_key"] for r in got if r["doc_id"] == 4}) == 1
    assert all(r["kept"] for r in select_documents(d, spark.createDataFrame([], LABELS)).collect())
    assert select_documents(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).collect() == []


def test_toxic_ones_go_and_clean_ones_stay(spark):
    rng = random.Random(3)
    kind = {k: rng.choices(["clean", "toxic", "junk"], [7, 2, 1])[0] for k in range(900)}

    def text(what):
        words = (junk(rng) if what == "junk" else " ".join(clean(rng) for _ in range(rng.choice([1, 1, 20])))).split()
        for _ in range(rng.randrange(1, 4) if what == "toxic" else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["badword", "Slur", "insult."]))
        return " ".join(words)

    docs = [(k, text(what)) for k, what in kind.items()]
    # a toxic row without quality counts, too
    labels = [(k, None if k % 9 == 0 and what == "toxic" else int(what != "junk"), int(what == "toxic")) for k, what in kind.items() if k % 3 == 0]
    got = {r["doc_id"]: r["kept"] for r in select_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    out = {what: [k for k in kind if k % 3 and kind[k] == what] for what in ("clean", "toxic", "junk")}
    assert sum(got[k] for k in out["toxic"]) <= 0.02 * len(out["toxic"])
    assert sum(got[k] for k in out["clean"]) >= 0.98 * len(out["clean"])
    assert sum(got[k] for k in out["junk"]) <= 0.05 * len(out["junk"])


def test_weights_and_samples_like_brute_force(spark):
    """Ratios by counts in dictionaries; the sample by sorting keys."""
    import re
    from collections import Counter

    from pixelmill.llm import quality as q

    rng = random.Random(21)
    docs = [(k, clean(rng) if rng.random() < 0.7 else junk(rng)) for k in range(120)]
    labels = [(k, int(t == t.lower()), 0) for k, t in docs[:40]]
    out = select_documents(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    order = [r[0] for r in spark.sql("SELECT id FROM range(40) ORDER BY xxhash64(id), id").collect() if labels[r[0]][1]]
    fit, cache = set(order[::2]), q.Tokens()
    grams = {k: q.features(cache, cache.places(re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]+", t.encode()))).tolist() for k, t in docs}
    raw, target = Counter(g for v in grams.values() for g in v), Counter(g for k in fit for g in grams[k])
    part = {False: range(q.BUCKETS), True: range(q.BUCKETS, q.BUCKETS + q.SHAPES)}
    total = {(s, n): sum(c[b] + 0.5 for b in part[s]) for s in part for n, c in (("raw", raw), ("target", target))}

    def ratio(g):
        s = g >= q.BUCKETS
        return math.log((target[g] + 0.5) / total[s, "target"] / ((raw[g] + 0.5) / total[s, "raw"]))

    def slow_fit(x, good):
        """Slope and intercept by ever smaller steps that lower the loss."""
        mean = sum(x) / len(x)
        std = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))

        def loss(a, b):
            t = [a * (v - mean) / std + b for v in x]
            return sum(max(u, 0) + math.log1p(math.exp(-abs(u))) - (u if g else 0) for u, g in zip(t, good)) + q.RIDGE / 2 * (a * a + b * b)

        a = b = 0.0
        step = 4.0
        while step > 1e-7:
            best = min(((loss(a + i * step, b + j * step), a + i * step, b + j * step) for i in (-1, 0, 1) for j in (-1, 0, 1)))
            if best[0] < loss(a, b) - 1e-15:
                a, b = best[1:]
            else:
                step /= 2
        return a / std, b - a * mean / std

    marks = {k: q_ for k, q_, _ in labels if k not in fit}
    graded = [(r["ratio"], marks[r["doc_id"]] == 1) for r in out if r["doc_id"] in marks]
    slope, shift = slow_fit([x for x, _ in graded], [g for _, g in graded])
    for r in out:
        want = sum(map(ratio, grams[r["doc_id"]])) / (len(grams[r["doc_id"]]) + q.PRIOR)
        p = 1 / (1 + math.exp(-(slope * want + shift)))
        assert r["ratio"] == pytest.approx(want, abs=1e-9) and r["p_target"] == pytest.approx(p, rel=1e-2, abs=1e-9) and r["log_weight"] == pytest.approx(q.SHARPNESS * math.log(max(r["p_target"], 1e-300)), rel=1e-6, abs=1e-6)
    size = sum(r["p_target"] >= 0.5 for r in out)
    best = sorted(out, key=lambda r: -r["gumbel_key"])[:size]
    assert 0 < size < len(out) and {r["doc_id"] for r in out if r["kept"]} == {r["doc_id"] for r in best}
    w = [math.exp(r["log_weight"]) for r in out]
    assert q.effective_size(spark.createDataFrame(out)) == pytest.approx(sum(w) ** 2 / sum(x * x for x in w))


def test_the_weights_decide_on_given_documents(spark):
    """On the test tables: bad and toxic documents are far rarer in the sample than before, clean ones stay, and where few are wanted, noise decides among equals."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in select_documents(docs, labels).collect()}
    marks = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    share = {m: [rows[k]["kept"] for k, v in marks.items() if v == m] for m in set(marks.values())}
    mean = {m: sum(v) / len(v) for m, v in share.items()}
    assert mean[1, 0] > 0.98 and mean[0, 0] < 0.03 and mean[0, 1] < 0.03 and mean[1, 1] < 0.1
    # a sample of half as many: inclusion as the weights predict, for bins of weight, and neither the top by weight nor uniform
    size = len(rows) // 2
    few = {r["doc_id"]: r for r in select_documents(docs, labels, size=size, sharpness=0.25).collect()}
    candidates = [r for r in few.values() if r["toxicity"] <= max(x["toxicity"] for x in few.values() if x["kept"])]
    w = [math.exp(r["log_weight"]) for r in candidates]
    low, high = 0.0, 1e6
    for _ in range(200):  # sum of 1 - exp(-w t) = size
        t = (low + high) / 2
        low, high = (t, high) if sum(1 - math.exp(-x * t) for x in w) < size else (low, t)
    order = sorted(zip(w, (r["kept"] for r in candidates)))
    for k in range(5):
        part = order[k * len(order) // 5 : (k + 1) * len(order) // 5]
        assert abs(sum(x for _, x in part) - sum(1 - math.exp(-x * t) for x, _ in part)) < 4 * math.sqrt(len(part)) / 2
    top = set(sorted((r["doc_id"] for r in candidates), key=lambda k: -few[k]["log_weight"])[:size])
    assert 0.4 * size < len(top & {k for k, r in few.items() if r["kept"]}) < 0.9 * size


def test_logistic():
    from pixelmill.llm.quality import logistic

    a, b = logistic([0.0, 1.0, 2.0, 3.0], [False, False, True, True])
    assert a > 0 and abs(a * 1.5 + b) < 1e-6
    assert logistic([1.0, 2.0], [True, True]) == (0.0, math.inf)
    assert logistic([2.0, 1.0, 3.0], [True, False, False]) [0] >= 0 and logistic([1.0, 2.0], [True, False])[0] == 0
    far = logistic([0.0, 1e-9, 5.0, 1e6], [False, False, True, True])
    assert all(map(math.isfinite, far))


def test_labels_as_text(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, clean(rng) if k % 4 else junk(rng)) for k in range(200)], DOCS)
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(100)], LABELS)
    text = labels.selectExpr("doc_id", "cast(quality AS string) AS quality", "'none' AS toxic")
    key = lambda rows: sorted((r["doc_id"], r["kept"]) for r in rows.collect())
    assert key(select_documents(docs, text)) == key(select_documents(docs, labels))


def test_inclusion_follows_the_weights(spark):
    """Over many seeds, samples of two of five documents are as frequent as drawing one after the other, in proportion to weights, makes them."""
    from pyspark.sql import functions as F

    weight = [5.0, 3.0, 1.0, 0.5, 0.5]
    rows = spark.createDataFrame([(k, math.log(w)) for k, w in enumerate(weight)], "doc_id long, lw double").crossJoin(spark.range(6000).withColumnRenamed("id", "seed"))
    keyed = rows.select("seed", F.struct((F.col("lw") + gumbel(F.col("doc_id"), F.col("seed"))).alias("key"), "doc_id").alias("k")).groupBy("seed").agg(F.slice(F.sort_array(F.collect_list("k"), asc=False), 1, 2).alias("top"))
    got = {r["d"]: r["count"] / 6000 for r in keyed.select(F.explode("top.doc_id").alias("d")).groupBy("d").count().collect()}
    total = sum(weight)
    want = [w / total + sum(v / total * w / (total - v) for j, v in enumerate(weight) if j != k) for k, w in enumerate(weight)]
    assert all(abs(got[k] - w) < 0.03 for k, w in enumerate(want))
