"""Boilerplate lines by their spread over sites.

A line's spread is the number of distinct sites (sources) whose documents hold it. HyperLogLog sketches of the sites are kept a line
hash and merged by aggregation; a line whose estimate lies within the sketch's error of the threshold gets an exact
distinct count. Lines that reach the threshold are cut from every document. DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import materialize

MIN_SITES, LG_K = 10, 10
#: Lines to cut are broadcast up to so many hashes, else joined by shuffle with salt.
MAX_BROADCAST, SALT = 500_000, 16


def _lines(docs: DataFrame) -> DataFrame:
    """Rows (h, site, ...) with one row for each distinct line of a document; blank lines are left out."""
    hashes = F.array_distinct(F.transform(F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != ""), lambda x: F.xxhash64(x)))
    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.explode(hashes).alias("h"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Rows (h, sites, exact) of line hashes spread over ``min_sites`` sites or more; a null source is a site of its own, named ""."""
    lines = _lines(docs)
    sketched = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    sketched = sketched.select("h", F.hll_sketch_estimate("sketch").alias("sites"))
    # three standard errors of a sketch of 2 ** lg_k cells, and one more for rounding
    slack = 1 + 3 * 1.04 / 2 ** (lg_k / 2) * min_sites
    found = materialize(sketched.where(F.col("sites") >= min_sites - slack), "spread")
    near = found.where(F.col("sites") <= min_sites + slack).select("h")
    if near.count() <= MAX_BROADCAST:
        near = F.broadcast(near)
    # sites of a line are few; pairs are made distinct before they are counted, so a line that all hold is no single group
    exact = lines.select("h", "site").join(near, "h", "left_semi").distinct().groupBy("h").agg(F.count("*").alias("sites"))
    sure = found.where(F.col("sites") > min_sites + slack).select("h", "sites", F.lit(False).alias("exact"))
    return sure.union(exact.where(F.col("sites") >= min_sites).select("h", "sites", F.lit(True).alias("exact")))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Rows (doc_id, n_lines, n_removed, text) for ``docs(doc_id, text, source)``; other columns are not read.

    Lines end at line feeds and are compared without outer spaces, tabs and carriage returns; a blank line is never cut. A null
    text has 0 lines and stays null; an empty one has one (blank) line. Repeated rows come back repeated, a null doc_id is an id like any. An empty
    table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    cut = materialize(boilerplate(docs, min_sites).select("h"), "boilerplate")
    lines = _lines(docs).select("doc_id", "h")
    if cut.count() <= MAX_BROADCAST:
        hit = lines.join(F.broadcast(cut), "h")
    else:
        salted = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        hit = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(salted, ["h", "salt"])
    hit = hit.groupBy("doc_id").agg(F.collect_set("h").alias("hs")).withColumnRenamed("doc_id", "id")
    joined = docs.join(hit, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    parts = F.split("text", "\n", -1)
    kept = F.filter(parts, lambda x: ~F.array_contains("hs", F.xxhash64(F.btrim(x, F.lit(" \t\r")))) | (F.btrim(x, F.lit(" \t\r")) == ""))
    clean = F.when(F.col("hs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    gone = F.when(F.col("hs").isNull() | F.col("text").isNull(), 0).otherwise(F.size(parts) - F.size(kept)).cast("long")
    return joined.select("doc_id", n.alias("n_lines"), gone.alias("n_removed"), clean.alias("text"))
