"""Ranks and running sums over a whole table, without a window that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.session import checkpoint_folder


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each of ``sums``, the sum of an expression over all rows up to each row in the given order (which has to tell rows apart).

    Rows are dealt by ranges of the order and kept as they were dealt; windows run within a range, and over one row a range.
    """
    checkpoint_folder(rows.sparkSession)
    dealt = rows.repartitionByRange(*order).withColumns({f"_v_{k}": v for k, v in sums.items()}).withColumn("_p", F.spark_partition_id()).checkpoint()
    total = dealt.groupBy("_p").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    over = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = total.select("_p", *[F.coalesce(F.sum(f"_t_{k}").over(over), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(before, "_p").withColumns({k: F.sum(f"_v_{k}").over(inside) + F.col(f"_b_{k}") for k in sums})
    return out.select(*rows.columns, *sums)


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the place of each row in the order, from 0."""
    return running(rows, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)
