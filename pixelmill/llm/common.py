"""Shared folders, materialised tables and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where a session with a local master has none (tests), a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="pixelmill-"))
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/pixelmill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again.

    Cuts the lineage so that a lost executor costs no recomputation, and keeps large intermediates compressed.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def text_batches(spark: SparkSession, rows: int = 1000, size: int = 2 << 20) -> Iterator[None]:
    """While it is open, whole texts go to Python in small Arrow batches, which JVM and worker each hold.

    A batch ends at ``rows`` rows or ``size`` bytes, or at the session's own bounds where they are less. What is planned within has to run within
    (``materialize``): the session's settings come back at the end.
    """
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in keys}
    for k, most in keys.items():
        if not 0 < int(before[k].rstrip("bB") if before[k].rstrip("bB").isdigit() else most + 1) <= most:
            spark.conf.set(k, str(most))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow; when it is done, memory goes back to the system, since Spark keeps workers for other stages."""

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def release() -> None:
    """Give free memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` holds pairs of longs or of strings in any direction; null ends and self loops are ignored. Returns one row
    ``(node, root)`` for each node of an edge that joins two different nodes; root is the smallest node reachable.
    Each round is a grouped minimum (combined before the shuffle) and a join, so a hub of any size is
    never gathered in one place. Rounds grow with the logarithm of the longest path.
    """
    e = materialize(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), (F.col(src) != F.col(dst)).alias("ok"))
        .where("ok and u is not null and v is not null").select("u", "v").distinct(), "cc")
    print_ = _fingerprint(e)
    for _ in range(max_rounds):
        if print_[0] == 0:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "cc")
        now = _fingerprint(e)
        if now == print_:
            break
        print_ = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _fingerprint(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v") % 1000003).alias("s")).first()
    return tuple(row)
