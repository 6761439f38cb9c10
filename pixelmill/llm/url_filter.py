"""Block and allow rules over URLs, with decisions that follow redirects.

A rule names a host and a path; it fits the host with all its subdomains and every path that begins with its own. URLs that one
page leads to another by (canonical link, refresh, or a given table of redirects), and spellings of one URL, are aliases: connected components over these
edges. A block decision of one alias holds for all that no rule fits; a rule that allows a URL stands above the decision for its aliases.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import connected_components, lean, materialize, text_batches

#: Rules are broadcast up to so many.
MAX_BROADCAST = 200_000
#: Parameters that say where a visitor came from, and don't change what is shown.
TRACKING = r"(^|&)(utm_[a-z]+|gclid|fbclid|msclkid)=[^&]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first "://" up to "/", "?", "#" or the end, A-Z in lower case; "" without it."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """A key of the URL without scheme, default port, fragment, tracking parameters: 128 bits as hex digits. Null where there is no host."""
    host = F.regexp_replace(host_of(url), r"\.?(:80|:443)?$", "")
    query = F.regexp_replace(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), TRACKING, "")
    path = path_of(url)
    whole = F.concat(host, F.when(path == "", "/").otherwise(path), F.lit("?"), F.ltrim(query, F.lit("&")))
    return F.when(host != "", F.md5(whole))


class _Links(HTMLParser):
    """Where a page says it has moved to, or is a copy of."""

    def __init__(self, url: str):
        super().__init__()
        self.base, self.found = url, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "base" and a.get("href"):
            self.base = urljoin(self.base, a["href"])
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self._add(a.get("href", ""))
        elif tag == "meta" and a.get("http-equiv", "").strip().lower() == "refresh":
            _, _, rest = a.get("content", "").replace(",", ";").partition(";")
            name, _, target = rest.partition("=")
            if name.strip().lower() == "url":
                self._add(target.strip().strip("'\""))

    def _add(self, target: str) -> None:
        if target.strip():
            self.found.append(urljoin(self.base, target.strip()))


def links_of(url: str, html: str) -> list[str]:
    """The absolute URLs that the page's canonical links and refreshes name."""
    page = _Links(url)
    try:
        page.feed(html)
        page.close()
    except (ValueError, AssertionError):  # an address or a declaration that can't be read: what was found before it counts
        pass
    return [x for x in page.found if x.lower().startswith(("http://", "https://"))]


def page_links(pages: DataFrame) -> DataFrame:
    """Rows (src, dst) of URLs, from ``pages(url, html)``. Pages without URL or html have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(u, v) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for v in links_of(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["src", "dst"])

    hinted = pages.select("url", "html").where("url is not null").where(F.col("html").rlike("(?i)canonical|refresh"))
    with text_batches(pages.sparkSession):
        return materialize(hinted.mapInArrow(lean(run), "src string, dst string").distinct(), "links")


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(url, ...)``, one row a URL, with host, path, rule and verdict; the last two null where no rule fits.

    ``rules(verdict, host, path)``: of rules that fit the one with most characters wins, then one that allows, then the longer host. The
    hosts above a URL's meet the rules' hosts, then beginnings of its path, of those lengths that the host has rules of, meet rules; both joins are by equality.
    """
    rules = rules.groupBy(F.lower("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.min("verdict").alias("r_verdict")).where("r_host <> ''")
    rules = materialize(rules, "rules")
    shape = rules.agg(F.count("*").alias("n"), F.max(F.size(F.split("r_host", r"\."))).alias("labels")).first()
    lengths = rules.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths"))
    if shape["n"] <= MAX_BROADCAST:
        rules, lengths = F.broadcast(rules), F.broadcast(lengths)
    judged = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    parts, labels = F.split("host", r"\."), shape["labels"] or 1
    above = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - (labels - 1)), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "."))
    near = judged.select("url", "path", F.explode(above).alias("a_host")).join(lengths, F.col("a_host") == F.col("r_host"))
    near = near.select("url", "a_host", "path", F.explode("lengths").alias("k")).where(F.col("k") <= F.length("path")).select("url", "a_host", F.substring("path", F.lit(1), F.col("k")).alias("a_path"))
    met = near.join(rules, (F.col("a_host") == F.col("r_host")) & (F.col("a_path") == F.col("r_path")))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("size"), (F.col("r_verdict") == "allow").alias("allows"), F.length("r_host").alias("host"))
    won = met.groupBy(F.col("url").alias("m_url")).agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank).alias("won"))
    joined = judged.join(won, F.col("url") == F.col("m_url"), "left")
    return joined.select(*urls.columns, "host", "path", F.col("won.rule").alias("rule"), F.col("won.verdict").alias("verdict"))


def filter_pages(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, alias_of_blocked), one for each row of ``pages(page_id, url, html)``; other columns are not read.

    ``redirects(src, dst)`` adds edges known from elsewhere. The verdict is the fitting rule's; without one it is block where an alias
    is blocked by a rule, page or not, else allow. Null URLs and those without "://" have empty host and path, and no aliases: allow. Repeated rows come
    back repeated; a null html has no links; empty tables give empty ones.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    links = page_links(pages)
    if redirects is not None:
        links = links.union(redirects.select(F.col("src").cast("string"), F.col("dst").cast("string")))
    urls = pages.select("url").union(links.select("src")).union(links.select("dst")).where(host_of(F.col("url")) != "").distinct()
    judged = materialize(judge(urls.withColumn("key", canonical(F.col("url"))), rules), "judged")
    edges = links.select(canonical(F.col("src")).alias("src"), canonical(F.col("dst")).alias("dst"))
    roots = connected_components(edges)
    grouped = judged.join(roots, F.col("key") == F.col("node"), "left").withColumn("alias", F.coalesce("root", "key")).drop("node", "root")
    blocked = materialize(grouped.where("verdict = 'block'").select(F.col("alias").alias("b_alias")).distinct(), "blocked")
    known = grouped.join(blocked, F.col("alias") == F.col("b_alias"), "left").select(F.col("url").alias("k_url"), "rule", "verdict", F.col("b_alias").isNotNull().alias("hit"))
    hit = F.coalesce("hit", F.lit(False))
    verdict = F.coalesce("verdict", F.when(hit, "block").otherwise("allow"))
    out = pages.select("page_id", "url").join(known, F.col("url") == F.col("k_url"), "left")
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", verdict.alias("verdict"), hit.alias("alias_of_blocked"))
