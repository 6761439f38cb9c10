from collections import defaultdict

from pixelmill.llm import line_dedup
from pixelmill.llm.line_dedup import boilerplate, remove_boilerplate

SCHEMA = "doc_id long, text string, source string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "doc_id AS h", "source AS site")


def brute(rows, k):
    sites = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            sites[x.strip(" \t\r")].add(s or "")
    out = []
    for i, t, _ in rows:
        parts = t.split("\n") if t is not None else []
        kept = [x for x in parts if not x.strip(" \t\r") or len(sites[x.strip(" \t\r")]) < k]
        out.append((i, len(parts), len(parts) - len(kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def sample():
    rows = [(k, f"own {k}\n all \r\nsite {k % 7}\nuse {k % 12}\n\nlast {k % 3}", f"s{k % 12}" if k % 5 else None) for k in range(90)]
    return rows + [(200, None, "s1"), (201, "", "s2"), (202, "all", None), (None, "all\nmine", "s3"), (202, "all", None), (203, "all\n" * 30_000, "s1"), (204, "\n\n", "")]


def test_like_brute_force(spark, monkeypatch):
    rows = sample()
    for k in (3, 5, 11):
        assert sorted(map(tuple, remove_boilerplate(frame(spark, rows), k).collect()), key=str) == brute(rows, k)
    monkeypatch.setattr(line_dedup, "MAX_BROADCAST", 0)
    assert sorted(map(tuple, remove_boilerplate(frame(spark, rows), 5).collect()), key=str) == brute(rows, 5)


def test_sketch_and_exact_parts(spark):
    rows = [(k, f"wide\nnear {k % 2}" if k < 22 else "wide", f"s{k}") for k in range(200)]
    found = {r["sites"]: r["exact"] for r in boilerplate(frame(spark, rows), 10).collect()}
    assert found.pop(11) is True and len(found) == 1 and not any(found.values())


def test_empty(spark):
    assert remove_boilerplate(frame(spark, [])).collect() == []
