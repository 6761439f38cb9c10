import itertools
import random

import pytest

from pixelmill.llm.ngram_join import similar_documents


def brute(rows, width=5, percent=75):
    sets = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((doc_id, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, (a, s)), (j, (b, t)) in itertools.combinations(enumerate(sets), 2):
        if s and t and a is not None and b is not None and 100 * len(s & t) >= percent * len(s | t):
            parent[find(i)] = find(j)
    best = {}
    for i, (d, s) in enumerate(sets):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted(((d, len(s), (best[find(i)] if d is not None else None)) for i, (d, s) in enumerate(sets)), key=str)


def run(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:
        df = df.selectExpr("*", extra)
    return sorted(map(tuple, similar_documents(df).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, line = [], "shared line of words that many documents have at the start"
    for k in range(120):
        n = rng.choice([1, 3, 4, 5, 6, 8, 9, 12, 20, 40, 90, 200])
        w = [f"w{rng.randrange(60 if n < 10 else 5000)}" for _ in range(n)]
        rows.append((len(rows), " ".join(w)))
        for _ in range(rng.choice([0, 0, 1, 3])):
            c = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                c[rng.randrange(len(c))] = f"x{rng.randrange(9)}"
            if rng.random() < 0.3:
                c = c + [f"y{rng.randrange(9)}"] * rng.randrange(3)
            rows.append((len(rows), (line + "\n" if rng.random() < 0.4 else "") + " ".join(c).upper()))
    w = [f"v{k}" for k in range(60)]
    for k in range(150):  # one large group of near copies, each off by a word
        c = list(w)
        c[k % 60] = f"z{k}"
        rows.append((len(rows), " ".join(c)))
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (None, "a b"), (6, "a b c"), (7, "x " * 30000), (8, "x " * 31000), (9, "a b"), (9, "a b"), (10, "a b c d e f g"), (11, "a b c d e f g")]
    assert run(spark, rows, "doc_id AS fp") == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
