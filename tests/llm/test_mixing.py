import re

import numpy as np
import pytest

from pixelmill.llm import mixing
from pixelmill.llm.mixing import mix_counts, mix_documents, packed_blocks, permuted, shard_counts, targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(3)


def sample(n=120):
    rng = np.random.default_rng(3)
    return [(k, " ".join(f"w{k}_{j}" for j in range(int(rng.integers(1, 200)))), ["hot", "hot", "b", "c", None, ""][int(rng.integers(6))]) for k in range(n)]


def test_targets():
    assert targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    assert targets([10, 1000, 90])[0] == 30 and sum(targets([10, 1000, 90])) == pytest.approx(1100)
    assert targets([0, 5]) == [0.0, 5.0] and targets([]) == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutation(n):
    got = permuted(np.arange(n), n, 99)
    assert sorted(got.tolist()) == list(range(n))
    assert n < 64 or got.tolist() != permuted(np.arange(n), n, 98).tolist()


def test_shards_cover_the_quota():
    quota = np.array([500, 20, 0, 333])
    shards = -(-int(quota.sum()) // 64)
    seen = np.zeros_like(quota)
    for s in range(shards):
        counts, before = shard_counts(quota, s, shards, 64, 5)
        assert (before == seen).all() and (counts.sum() == 64 or s == shards - 1)
        seen = seen + counts
    assert (seen == quota).all()


def test_counts(spark):
    rows = sample()
    got = mix_counts(docs(spark, rows).selectExpr("*", "doc_id AS size", "source AS h"), block=4).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    per = [sum(size[i] for i, _, s in rows if s == n) for n in names]
    goal = dict(zip(names, targets(per)))
    source = {i: s for i, _, s in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(goal[source[r["doc_id"]]])
        assert r["source_size"] == per[names.index(source[r["doc_id"]])]
    for n in names:
        assert sum(r["taken"] for r in got if source[r["doc_id"]] == n) == pytest.approx(goal[n], abs=8)
    again = mix_counts(docs(spark, rows[::-1]), block=4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_texts_hold_what_is_taken(spark):
    rows = sample(60)
    taken = {r["doc_id"]: r["taken"] for r in mix_counts(docs(spark, rows), block=8).collect()}
    mixed = {r["doc_id"]: r for r in mix_documents(docs(spark, rows), block=8).collect()}
    assert set(mixed) == {k for k, n in taken.items() if n}
    for k, r in mixed.items():
        assert len(r["text"].split()) == taken[k] and r["n_chars"] == len(r["text"]) and set(r["text"].split()) <= set(rows[k][1].split())
    blocks = packed_blocks(docs(spark, rows), block=8).collect()
    assert sum(len(b["text"].split()) for b in blocks) == sum(taken.values())
    assert max(len(b["text"].split()) for b in blocks) == 8 and len({(b["shard"], b["slot"]) for b in blocks}) == len(blocks)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (None, "x y", "a"), (None, "x y", "a"), (4, "one two three", "b"), (4, "one two three", "b"), (5, "w " * 20_000, "c")]
    got = mix_counts(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert mix_documents(docs(spark, rows)).count() <= 3


def test_empty(spark):
    assert mix_counts(docs(spark, [])).collect() == [] and mix_documents(docs(spark, [])).collect() == []


def test_draws_beyond_the_generators_range():
    """The way for very many slots is as exact as the other: totals are met, and means and deviations are those of the hypergeometric distribution."""
    quota = np.array([700, 250, 50])
    got = np.array([mixing.halve(quota, 400, np.random.default_rng([1, k]), most=0) for k in range(4000)])
    assert (got.sum(1) == 400).all() and (got >= 0).all() and (got <= quota).all()
    p = quota / 1000
    assert np.allclose(got.mean(0), 400 * p, atol=0.5)
    assert np.allclose(got.var(0), 400 * p * (1 - p) * 600 / 999, rtol=0.1)
    large = np.array([3_000_000_000_000, 5_000_000_000, 7, 0])
    left = mixing.halve(large, int(large.sum()) // 2, np.random.default_rng(5))
    assert left.sum() == large.sum() // 2 and (left <= large).all() and abs(left[1] - 2_500_000_000) < 500_000
