import random

import pytest

from pixelmill.llm.token_counts import EVENTS, Rollup, count_events


def brute(batches):
    state = {}
    for events in batches:
        last = {}
        for e in events:
            if e[0] is not None and e[1] is not None:
                k = (e[0], e[1])
                if k not in last or (e[6], e[5], e[4] or 0) > (last[k][6], last[k][5], last[k][4] or 0):
                    last[k] = e
        for k, e in last.items():
            state.pop(k, None)
            if e[5] != "delete":
                state[k] = e
    out = {}
    for (_, v), e in state.items():
        d = out.setdefault((e[2], e[3], v), [0, 0])
        d[0] += 1
        d[1] += e[4] or 0
    return sorted(((*k, *v) for k, v in out.items()), key=str)


def test_batches(spark, tmp_path):
    rng = random.Random(5)
    batches = [[(rng.randrange(40) if rng.random() > 0.05 else None, rng.choice(["a", "b"]), rng.choice(["s", "t", None]), rng.choice(["en", None]), rng.randrange(100), rng.choice(["insert", "delete", "revise"]), k) for k in range(60)] for _ in range(3)]
    r = Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().collect() == []
    for b, events in enumerate(batches):
        df = spark.createDataFrame(events, EVENTS).selectExpr("*", "seq AS batch")
        assert r.commit(b, df) and not r.commit(b, df)
        assert sorted(map(tuple, r.totals().collect()), key=str) == brute(batches[: b + 1])
    assert r.committed() == [0, 1, 2]
    assert r.commit(3, spark.createDataFrame([], EVENTS))
    assert sorted(map(tuple, r.totals().collect()), key=str) == brute(batches)


def test_broken_commit_counts_once(spark, tmp_path):
    import shutil

    r = Rollup(spark, f"file://{tmp_path}/r")
    df = spark.createDataFrame([(1, "a", "s", "en", 5, "insert", 0)], EVENTS)
    r.commit(0, df)
    r.commit(1, spark.createDataFrame([(1, "a", "s", "en", 7, "revise", 0)], EVENTS))
    shutil.rmtree(tmp_path / "r/batch=1/deltas")  # the ledger was written, the mark wasn't
    assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "a", 1, 5)]
    r.commit(1, spark.createDataFrame([(1, "a", "s", "en", 7, "revise", 0)], EVENTS))
    assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "a", 1, 7)]


def test_counts_of_documents(spark):
    df = spark.createDataFrame([(1, "One, two  three.\n", "s", "en"), (2, None, None, None), (2, None, None, None), (3, "", "s", "en"), (4, "é 👍 ok", "s", "en")], "doc_id long, text string, source string, lang string")
    got = sorted((r["doc_id"], r["version"], r["n_tokens"]) for r in count_events(df, "insert").collect())
    assert got == [(1, "marks-2", 5), (1, "words-1", 3), (2, "marks-2", 0), (2, "marks-2", 0), (2, "words-1", 0), (2, "words-1", 0), (3, "marks-2", 0), (3, "words-1", 0), (4, "marks-2", 3), (4, "words-1", 3)]


def test_tokenizer_files_and_odd_rows(spark):
    pt = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    files = {"bpe-49k": pt.path("word_bpe_49k.json"), "bpe-50k": pt.path("byte_bpe_50k.json")}
    rows = [(1, "One, two  three.\n", "s", "en"), (2, None, None, None), (None, "é 👍 ok", "s", "en"), (3, "word " * 30_000, "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS version", "text AS by_pattern", "2 AS n_tokens")
    got = {(r["doc_id"], r["version"]): r["n_tokens"] for r in count_events(df, "insert", tokenizers=files).collect()}
    for v, p in files.items():
        t = Tokenizer.from_file(p)
        assert all(got[i, v] == len(t.encode(x or "", add_special_tokens=False).ids) for i, x, *_ in rows)
    assert got[3, "words-1"] == 30_000 and len(got) == 16
    assert count_events(df.limit(0), "insert", tokenizers=files).collect() == []


def test_compaction(spark, tmp_path):
    r = Rollup(spark, f"file://{tmp_path}/r")
    batches = [[(k, "a", "s", "en", k, "insert", 0) for k in range(5)], [(1, "a", "t", "en", 7, "revise", 0), (2, "a", "s", "en", 0, "delete", 0)], [(1, "a", "t", "en", 0, "delete", 0), (9, "a", "s", "en", 4, "insert", 0)]]
    for b, events in enumerate(batches):
        assert r.commit(b, spark.createDataFrame(events, EVENTS))
        r.compact()
        assert not r.commit(b, spark.createDataFrame(events, EVENTS))
        assert sorted(map(tuple, r.totals().collect()), key=str) == brute(batches[: b + 1])
    assert r.committed() == [2]
