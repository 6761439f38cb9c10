"""An extension: rasters that arrive as files, with running segment statistics and label histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PIXELS = "img int, y int, x int, c1 long, c2 long, c3 long, lb int, annot int"


def read_pixels(spark: SparkSession, path: str, schema: str = PIXELS, files_a_batch: int = 100) -> DataFrame:
    """A stream of pixel rows from Parquet files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def running_statistics(px: DataFrame, segment: str, channels: list[str]) -> DataFrame:
    """Mean, deviation and energy of segments over all pixels so far; the state is three sums a channel."""
    n = F.count("*")
    aggs = [n.alias("n")]
    for c in channels:
        v = F.col(c)
        aggs += [(F.sum(v) / n).alias(f"{c}_mean"), (F.sqrt((n * F.sum(v * v) - F.sum(v) * F.sum(v)).cast("double")) / n).alias(f"{c}_std"), (F.sum(v * v) / n).alias(f"{c}_energy")]
    return px.where(F.col(segment) >= 0).groupBy("img", segment).agg(*aggs)


def running_histogram(px: DataFrame, segment: str, label: str) -> DataFrame:
    """Pixels of each label in each segment so far."""
    return px.where((F.col(label) >= 0) & (F.col(segment) >= 0)).groupBy("img", segment, label).agg(F.count("*").alias("n"))


def write_batches(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write each batch's whole state to a folder of its own, named by the batch, so that a repeated batch is written over."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    w = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (w.trigger(availableNow=True) if once else w).start()
