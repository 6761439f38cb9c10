import hashlib
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import same

from pixelmill.llm.merkle import leaves_of, manifest, verified
from pixelmill.llm.queries import ORACLE, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, n, "clash", "clash") for k, t, s, n in rows], SCHEMA)


def leaf(k, t, s, n):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (k, s, "en", n, t)))


def brute(rows, fanout=3):
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) from whole lists."""
    def climb(nodes):
        paths = [[] for _ in nodes]
        where = list(range(len(nodes)))
        while len(nodes) > 1:
            for k, at in enumerate(where):
                run = nodes[at // fanout * fanout : at // fanout * fanout + fanout]
                paths[k].append((at % fanout, run[: at % fanout] + run[at % fanout + 1 :]))
                where[k] = at // fanout
            nodes = [sha("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
        return paths, nodes[0]

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = (own, *climb([leaf(*r) for r in own]))
    upper, root = climb([trees[s][2] for s in names])
    out = []
    for s, up in zip(names, upper):
        own, paths, sub = trees[s]
        for r, path in zip(own, paths):
            k, t, _, n = r
            bad = t is not None and k is not None and zlib.crc32(str(k).encode()) % 2 == 0
            h = leaf(k, t.replace("\n", "") if bad else t, s, n)
            for place, others in path + up:
                h = sha("".join(others[:place] + [h] + others[place:]))
            out.append((k, leaf(*r), sub, root, sha("".join(x for _, others in path + up for x in others)), h, h == root))
    return sorted(out, key=str)


def found(spark, rows, **more):
    docs = docs_of(spark, rows)
    lost = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return sorted((tuple(r) for r in verified(manifest(leaves_of(docs, {"text": lost}), **more)).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_like_brute_force(spark, levels):
    """Trees of 1, 3, 4, 9, 10 and 100 leaves, 40 sources of one, in buckets of several heights."""
    rows = [(k, f"a\nb{k}", s, k) for s, n in (("x", 100), ("é", 10), ("Z", 9), (None, 4), ("", 3), ("one", 1)) for k in range(n)]
    rows += [(1000 + k, "a\nb", f"s{k}", k) for k in range(40)]
    assert found(spark, rows, levels=levels) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, "", "a", 0), (7, "x\ny", "a", 3), (7, "x\ny", "a", 3), (7, "other", "a", 3), (-5, "é\n" * 200_000, "a", 1), (8, "none", "b", None)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    one = found(spark, [(3, "t", "s", 1)])
    assert one[0][1] == one[0][2] == one[0][3] and one[0][4] == sha("")


def test_other_fanouts(spark):
    rows = [(k, f"t{k}", "s" if k % 3 else "r", k) for k in range(50)]
    for fanout in (2, 7):
        assert found(spark, rows, fanout=fanout, levels=2) == brute(rows, fanout)
    with pytest.raises(ValueError):
        manifest(leaves_of(docs_of(spark, rows)), fanout=1)


def test_one_changed_row_is_found(spark):
    rows = [(k, f"line\n{k}", "s", k) for k in range(30)]
    docs = docs_of(spark, rows)
    out = verified(manifest(leaves_of(docs, {"text": F.when(F.col("doc_id") == 17, "forged").otherwise(F.col("text"))}))).where("not verified").collect()
    assert [r["doc_id"] for r in out] == [17]


def test_query_at_larger_scale(spark):
    sf = "/root/testdata/sf0.01"
    assert same(QUERIES["op13_merkle_manifest"](spark, sf), ORACLE["op13_merkle_manifest"], sf) == 1000
