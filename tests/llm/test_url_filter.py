import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import same

from pixelmill.llm import url_filter
from pixelmill.llm.queries import ORACLE, QUERIES, URL_RULES
from pixelmill.llm.url_filter import filter_pages, links_of

SCHEMA = "page_id long, url string, html string, host string, rule string"
CANON = '<html><head><link rel="canonical" href="{}"></head></html>'


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, "clash", "clash") for k, u, h in rows], SCHEMA)


def rules(spark, rows=URL_RULES):
    return spark.createDataFrame(rows, "verdict string, host string, path string")


def verdicts(spark, rows, by=URL_RULES):
    return {r["page_id"]: (r["rule"], r["verdict"]) for r in filter_pages(pages(spark, rows), rules(spark, by)).collect()}


PLANTED = [
    (1, "https://bad.net/x", None),  # blocked by its rule
    (2, "https://a.org/y", CANON.format("http://BAD.net:80/x?utm_source=q#top")),  # alias of 1 by another spelling
    (3, "https://b.org/z", '<meta http-equiv="Refresh" content="0; URL=https://a.org/y">'),  # leads to 2
    (4, "https://c.org/fr/1", CANON.format("https://b.org/z")),  # an alias, but allowed
    (5, "https://d.com/q", CANON.format("https://c.org/fr/1")),  # what leads through an allowed alias is an alias
    (6, "https://e.com/q", CANON.format("https://f.com/")),  # no blocked alias
    (7, "https://g.com/q", CANON.format("https://never-read.net/p")),  # the blocked alias is no page
    (8, "https://www.example.com/de/1", ""),
    (9, "https://example.com.org/de/1", ""),
    (10, "https://sub.example.net/en/1", ""),
    (11, "https://example.net/en", ""),
    (12, "https://myexample.com/de/1", ""),
    (13, "https://bad.net", ""),  # no path: net/ doesn't fit
    (13, "https://bad.net", ""),
]


def test_planted_links(spark):
    found = verdicts(spark, PLANTED)
    blocked = {k for k, (_, v) in found.items() if v == "block"}
    assert blocked == {1, 2, 3, 5, 7, 8, 11}
    assert found[4] == ("org/fr/", "allow") and found[10] == ("example.net/en/", "allow") and found[8][0] == "example.com/de/"
    assert found[11][0] == "net/" and found[13] == (None, "allow") and found[2][0] is None


def test_like_duckdb_with_links(spark, tmp_path):
    hub = [(100 + k, f"http://h{k % 7}.com/p/{k}#f", CANON.format(f"https://h{(k + 1) % 7}.com/p/{k + 1}" if k % 9 else "https://spam.net/hub")) for k in range(60)]
    pages(spark, PLANTED + hub + [(200, None, CANON.format("https://spam.net/hub")), (201, "no-host/x", None)]).write.parquet(str(tmp_path / "pages.parquet"))
    con_dir = tmp_path
    for t in "region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations".split():
        (con_dir / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    assert same(QUERIES["op12_url_aliases"](spark, str(tmp_path)), ORACLE["op12_url_aliases"], str(tmp_path)) == len(PLANTED) + 62


def test_links_of():
    base = "https://a.org/dir/page?x=1"
    assert links_of(base, '<LINK REL="nofollow Canonical" HREF="../b&amp;c">') == ["https://a.org/b&c"]
    assert links_of(base, '<base href="https://b.org/k/"><link rel=canonical href=z>') == ["https://b.org/k/z"]
    assert links_of(base, "<meta http-equiv=refresh content=\"5;url='//c.org/'\">") == ["https://c.org/"]
    assert links_of(base, '<!-- <link rel="canonical" href="/no"> --><script>"<link rel=canonical href=/no>"</script>') == []
    assert links_of(base, '<link rel="canonical"><link rel="canonical" href="mailto:x@y.z"><meta http-equiv="refresh" content="5">') == []
    assert links_of(base, '<link rel="canonical" href="http://[bad"><p>') == []


def test_given_redirects_and_odd_rows(spark):
    rows = [(1, None, CANON.format("https://x.net/")), (2, "", ""), (None, "https://a.com/", None), (4, "https://a.com/" + "y" * 300_000, "z" * 300_000), (4, "https://./", ""), (5, "https://" + "a." * 50_000 + "net/", "")]
    r = spark.createDataFrame([("https://a.com/", "https://x.net/1"), (None, "https://x.net/1"), ("https://q.com", None), ("https://a.com/", "https://a.com/")], "src string, dst string")
    found = filter_pages(pages(spark, rows), rules(spark), r).collect()
    assert len(found) == 6
    got = {(x["page_id"], len(x["host"])): (x["verdict"], x["alias_of_blocked"]) for x in found}
    assert got[(None, 5)] == ("block", True) and got[(1, 0)] == ("allow", False) and got[(2, 0)] == ("allow", False) and got[(4, 5)] == ("allow", False) and got[(5, 100_003)] == ("block", True)
    assert filter_pages(pages(spark, []), rules(spark)).count() == 0
    assert {x["verdict"] for x in filter_pages(pages(spark, rows), rules(spark, [])).collect()} == {"allow"}


def test_rules_by_shuffle_and_ties(spark, monkeypatch):
    want = verdicts(spark, PLANTED)
    monkeypatch.setattr(url_filter, "MAX_BROADCAST", 0)
    assert verdicts(spark, PLANTED) == want
    tie = [("block", "a.b.net", "/"), ("allow", "b.net", "/x/"), ("allow", "c.net", "/"), ("block", "c.net", "/"), ("block", "", "/")]
    found = verdicts(spark, [(1, "http://a.b.net/x/1", ""), (2, "http://c.net/", ""), (3, "http://d.net/", "")], tie)
    assert found == {1: ("b.net/x/", "allow"), 2: ("c.net/", "allow"), 3: (None, "allow")}


@pytest.mark.parametrize("n", [3000])
def test_long_chain(spark, n):
    """A chain of redirects of any length carries the decision from one end to the other."""
    rows = [(k, f"https://s.com/{k}", CANON.format(f"https://s.com/{k + 1}" if k < n else "https://end.net/x")) for k in range(n + 1)]
    found = filter_pages(pages(spark, rows), rules(spark))
    assert found.where("verdict = 'block'").count() == n + 1
