"""Raster-shaped views over the driver tables, and the same views as SQL text for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 100
#: Rows of a table in a partition that groups them to a raster.
ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _floor(c) -> F.Column:
    return F.floor(c).cast("int")


def _dealt(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows by keys, in as many partitions as their number asks for: those that Spark puts together by their compressed size grow with the input, and so does a task's memory.

    With them their images, dealt alike, which need no rows by key."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    return rows.repartition(n, *keys), rows.select("img").distinct().repartition(n, "img")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense images of 100 x 100 pixels: (img, y, x, c1, c2, c3, lb, annot).

    Channels are sums over lineitem cells, lb cuts an image into 100 square segments, annot has three classes in
    regions that cross segments, with noise.
    """
    lines = table(spark, sf_dir, "lineitem").withColumns({"img": _floor(F.col("l_orderkey") / 15000), "y": (F.col("l_orderkey") % SIDE).cast("int"), "x": (F.col("l_partkey") % SIDE).cast("int")})
    dealt, images = _dealt(lines, ["img", "y", "x"])
    raw = dealt.groupBy("img", "y", "x").agg(
        F.sum("l_quantity").cast("long").alias("c1"), F.sum(F.round(F.col("l_discount") * 100).cast("int")).alias("c2"),
        F.sum(F.round(F.col("l_tax") * 100).cast("int")).alias("c3"), (F.sum("l_linenumber") % 4).cast("int").alias("noise"))
    side = F.sequence(F.lit(0), F.lit(SIDE - 1))
    grid = images.withColumn("y", F.explode(side)).withColumn("x", F.explode(side))
    px = grid.join(raw, ["img", "y", "x"], "left").fillna(0)
    annot = (_floor(F.col("y") / 25) + _floor(F.col("x") / 35) + (F.col("noise") == 0).cast("int")) % 3
    return px.select("img", "y", "x", "c1", "c2", "c3", (_floor(F.col("y") / 10) * 10 + _floor(F.col("x") / 10)).alias("lb"), annot.cast("int").alias("annot"))


R = """raw AS (
  SELECT CAST(floor(l_orderkey / 15000.0) AS INT) AS img, CAST(l_orderkey % 100 AS INT) AS y, CAST(l_partkey % 100 AS INT) AS x,
    CAST(sum(l_quantity) AS BIGINT) AS c1, CAST(sum(CAST(round(l_discount * 100) AS INT)) AS BIGINT) AS c2,
    CAST(sum(CAST(round(l_tax * 100) AS INT)) AS BIGINT) AS c3, CAST(sum(l_linenumber) % 4 AS INT) AS noise
  FROM lineitem GROUP BY 1, 2, 3),
grid AS (SELECT img, CAST(a.range AS INT) AS y, CAST(b.range AS INT) AS x FROM (SELECT DISTINCT img FROM raw), range(100) a, range(100) b),
r AS (
  SELECT img, y, x, coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2, coalesce(c3, 0) AS c3, (y // 10) * 10 + x // 10 AS lb,
    CAST((y // 25 + x // 35 + CASE WHEN coalesce(noise, 0) = 0 THEN 1 ELSE 0 END) % 3 AS INT) AS annot
  FROM grid LEFT JOIN raw USING (img, y, x))"""


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense volumes of 4 x 100 x 100 voxels: (img, z, y, x, c1, lb), with 100 segments a slice pair."""
    lines = table(spark, sf_dir, "lineitem").withColumns(
        {"img": _floor(F.col("l_orderkey") / 15000), "z": (F.col("l_suppkey") % 4).cast("int"), "y": (F.col("l_orderkey") % SIDE).cast("int"), "x": (F.col("l_partkey") % SIDE).cast("int")})
    dealt, images = _dealt(lines, ["img", "z", "y", "x"])
    raw = dealt.groupBy("img", "z", "y", "x").agg(F.sum("l_quantity").cast("long").alias("c1"))
    side = F.sequence(F.lit(0), F.lit(SIDE - 1))
    grid = images.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("y", F.explode(side)).withColumn("x", F.explode(side))
    vol = grid.join(raw, ["img", "z", "y", "x"], "left").fillna(0)
    return vol.withColumn("lb", _floor(F.col("z") / 2) * 100 + _floor(F.col("y") / 10) * 10 + _floor(F.col("x") / 10))


V = """rawv AS (
  SELECT CAST(floor(l_orderkey / 15000.0) AS INT) AS img, CAST(l_suppkey % 4 AS INT) AS z, CAST(l_orderkey % 100 AS INT) AS y,
    CAST(l_partkey % 100 AS INT) AS x, CAST(sum(l_quantity) AS BIGINT) AS c1 FROM lineitem GROUP BY 1, 2, 3, 4),
vol AS (
  SELECT g.img, g.z, g.y, g.x, coalesce(c1, 0) AS c1, (g.z // 2) * 100 + (g.y // 10) * 10 + g.x // 10 AS lb
  FROM (SELECT img, CAST(c.range AS INT) AS z, CAST(a.range AS INT) AS y, CAST(b.range AS INT) AS x
    FROM (SELECT DISTINCT img FROM rawv), range(4) c, range(100) a, range(100) b) g LEFT JOIN rawv USING (img, z, y, x))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on images: (img, idx, y, x), one an event, 10,000 of them folded onto each raster."""
    e = table(spark, sf_dir, "events")
    return e.select(F.floor(F.col("event_id") / 10000).cast("int").alias("img"), F.col("event_id").cast("long").alias("idx"), (F.col("event_id") * 37 % SIDE).cast("int").alias("y"), (F.col("user_id") * 61 % SIDE).cast("int").alias("x"))


P = """pts AS (
  SELECT CAST(event_id // 10000 AS INT) AS img, CAST(event_id AS BIGINT) AS idx, CAST(event_id * 37 % 100 AS INT) AS y, CAST(user_id * 61 % 100 AS INT) AS x
  FROM events)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows (vec_id, label, features array<double>)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice annotations (id, stack, slice_index, stage)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("stack"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long").alias("slice_index"), F.substring("o_orderpriority", 1, 1).cast("int").alias("stage"))


S = """info AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS stack,
    CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS slice_index, CAST(substr(o_orderpriority, 1, 1) AS INT) AS stage
  FROM orders)"""
