"""Sources and sinks of files: images, volumes, landmarks, parameters, annotation tables and matched path lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelmill.sources import paged

INFO = "id int, est_id string, gene_id string, fbgn string, cgname string, stage int, image_id int, image_path string, ant_x int, ant_y int, post_x int, post_y int, lat_x int, lat_y int, slice_index int, stack_path string"


def stem(path: Column | str) -> Column:
    """File name without folders and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def image_name(path: Column | str, index: Column | None = None) -> Column:
    """The stem, after a four-digit number if one is given."""
    return stem(path) if index is None else F.format_string("%04d_%s", index, stem(path))


def images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Pixels (img, y, x, c1, c2, c3) of PNG, JPEG, GIF or BMP files: red, green and blue; grey images repeat one channel, alpha is left out.

    Spark's image source decodes on the executors, and keeps rows of bytes, blue first; here every pixel becomes a row.
    """
    raw = spark.read.format("image").load(paths).select("image.*").where("height > 0")
    raw = raw.select(stem(F.col("origin")).alias("img"), "height", "width", "nChannels", "data")
    px = raw.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    row = F.substring("data", (F.col("y") * F.col("width") * F.col("nChannels") + 1), F.col("width") * F.col("nChannels"))
    px = px.select("img", "y", "width", "nChannels", F.hex(row).alias("_row"))
    px = px.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))

    def channel(k: int) -> Column:
        at = F.col("x") * F.col("nChannels") + F.when(F.col("nChannels") == 1, 0).otherwise(2 - k)
        return F.conv(F.substring("_row", 2 * at + 1, F.lit(2)), 16, 10).cast("int").alias(f"c{k + 1}")

    return px.select("img", "y", "x", *[channel(k) for k in range(3)])


def write_pixels(px: DataFrame, path: str) -> None:
    """Pixels as Parquet, a folder an image, each image's rows together."""
    px.repartition("img").sortWithinPartitions("img", "y", "x").write.partitionBy("img").parquet(path)


def split_bands(vol: DataFrame, interleaved: bool = True) -> DataFrame:
    """Adds ``band`` to a volume of two bands: even and odd slices, or the first and second half; z counts within the band."""
    if interleaved:
        return vol.withColumns({"band": (F.col("z") % 2 + 1).cast("int"), "z": F.floor(F.col("z") / 2).cast("int")})
    half = vol.groupBy("img").agg(F.ceil((F.max("z") + 1) / 2).cast("int").alias("_h"))
    first = F.col("z") < F.col("_h")
    return vol.join(half, "img").withColumns({"band": F.when(first, 1).otherwise(2), "z": F.when(first, F.col("z")).otherwise(F.col("z") - F.col("_h"))}).drop("_h")


def landmarks_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Points (img, idx, x, y) of CSV files with an index column and X, Y."""
    raw = spark.read.csv(paths, header=True, schema="idx int, X double, Y double").select("*", "_metadata.file_path")
    return raw.select(stem("file_path").alias("img"), "idx", F.col("X").alias("x"), F.col("Y").alias("y"))


def landmarks_txt(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Points (img, idx, x, y) of text files with two header lines, then "x y" a line; files are read whole."""
    raw = spark.read.text(paths, wholetext=True).select("value", "_metadata.file_path")
    each = raw.select(stem("file_path").alias("img"), F.posexplode(F.slice(F.split("value", "\r?\n"), 3, 1 << 30)).alias("idx", "line")).where(r"line rlike '^\\s*-?\\d+\\s+-?\\d+'")
    return each.select("img", "idx", F.regexp_extract("line", r"^\s*(-?\d+)\s+(-?\d+)", 1).cast("int").alias("x"), F.regexp_extract("line", r"^\s*(-?\d+)\s+(-?\d+)", 2).cast("int").alias("y"))


def write_landmarks_csv(points: DataFrame, path: str) -> None:
    """Points as CSV (idx, X, Y), a folder an image."""
    points.select("img", "idx", F.col("x").alias("X"), F.col("y").alias("Y")).repartition("img").sortWithinPartitions("idx").write.partitionBy("img").csv(path, header=True)


def write_landmarks_txt(points: DataFrame, path: str) -> None:
    """Points as text (the word point, their number, then "x y" a line), a folder an image."""
    line = F.concat_ws(" ", F.col("x").cast("int"), F.col("y").cast("int"))
    rows = points.groupBy("img").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("idx", line.alias("l")))).alias("p"))
    rows.select("img", F.concat_ws("\n", F.lit("point"), F.col("n"), F.array_join("p.l", "\n")).alias("value")).write.partitionBy("img").text(path)


def parameters_txt(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, value) of lines like "name": value."""
    raw = spark.read.text(path).select(F.regexp_extract("value", r'^\s*"([^"]+)"\s*:\s*(.*?),?\s*$', 1).alias("name"), F.regexp_extract("value", r'^\s*"([^"]+)"\s*:\s*(.*?),?\s*$', 2).alias("value"))
    return raw.where("name <> ''")


def slice_info(spark: SparkSession, path: str) -> DataFrame:
    """The tab-separated table of slice annotations."""
    return spark.read.csv(path, sep="\t", header=True, schema=INFO)


def palette_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows (label, red, green, blue) of a JSON file {label: [r, g, b]}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))).alias("m"))
    return raw.select(F.explode("m").alias("label", "c")).select(F.col("label").cast("int").alias("label"), *[F.col("c")[k].alias(n) for k, n in enumerate(("red", "green", "blue"))])


def paths(spark: SparkSession, pattern: str) -> DataFrame:
    """Files (path, stem) that match a pattern; file contents aren't read."""
    return spark.read.format("binaryFile").load(pattern).select("path", stem("path").alias("stem"))


def matched_paths(tables: list[DataFrame], names: list[str], drop_incomplete: bool = True) -> DataFrame:
    """Files of several lists with equal stems: (stem, a column a list), those of the first list, complete ones only if asked for."""
    out = tables[0].select("stem", F.col("path").alias(names[0]))
    for t, n in zip(tables[1:], names[1:], strict=True):
        out = out.join(t.select("stem", F.col("path").alias(n)), "stem", "left")
    return out.dropna() if drop_incomplete else out


def stripes(spark: SparkSession, height: int, width: int, labels: int, levels: int | None = None) -> DataFrame:
    """A label raster of vertical stripes (img, [z,] y, x, label), names going on from level to level."""
    n = height * width * (levels or 1)
    i = F.col("id")
    px = spark.range(n).select(F.lit(0).alias("img"), F.floor(i / (height * width)).cast("int").alias("z"), (F.floor(i / width) % height).cast("int").alias("y"), (i % width).cast("int").alias("x"))
    px = px.withColumn("label", (F.floor(F.col("x") * labels / width) + F.col("z") * labels).cast("int"))
    return px if levels else px.drop("z")


def random_image(spark: SparkSession, height: int, width: int, labels: int, seed: int = 0) -> DataFrame:
    """A colour image with random labels (img, y, x, label, c1, c2, c3), colours rising with the label; equal on each run."""
    i = F.col("id")
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1000)) / 1000.0
    px = spark.range(height * width).withColumn("label", F.floor(u(0) * labels).cast("int"))
    return px.select(F.lit(0).alias("img"), F.floor(i / width).cast("int").alias("y"), (i % width).cast("int").alias("x"), "label", *[((F.col("label") + u(k)) / labels).alias(f"c{k}") for k in (1, 2, 3)])


def tiff(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Pixels (img, z, y, x, c1, c2, c3) of TIFF files, a page a slice z; grey pages repeat one channel, further channels are left out.

    Files may lie in any store that Spark reads; each is decoded whole by one task, strip by strip. ``paged.tiff`` reads large files by range. Pages that it can't read are an error here, too.
    """
    schema = "img string, z int, y int, x int, c1 int, c2 int, c3 int"

    def run(frames):
        import pandas as pd

        for f in frames:
            for name, data in zip(f["stem"], f["content"], strict=True):
                for z, page in enumerate(paged.tiff_pages(lambda at, size: data[at : at + size])):  # noqa: B023
                    for chunk in page["chunks"]:
                        y, x, v = paged.chunk_pixels(page, chunk, data[chunk[0] : chunk[0] + chunk[1]])
                        yield pd.DataFrame({"img": name, "z": z, "y": y, "x": x} | {f"c{k + 1}": c for k, c in enumerate(paged.three_channels(v))})

    found = spark.read.format("binaryFile").load(paths).select(stem(F.col("path")).alias("stem"), "content")
    return found.mapInPandas(run, schema)


def dump(df: DataFrame, path: str) -> None:
    """Keep a table (features, labels, names, ...) as Parquet; an older one there is replaced."""
    df.write.mode("overwrite").parquet(path)


def load_dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def csv_triplets(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path_image, path_segm, path_centers, stem) of a CSV list of files that belong together, with columns of these names or in this order."""
    raw = spark.read.csv(path, header=True)
    names = ["path_image", "path_segm", "path_centers"]
    cols = [c for c in raw.columns if c not in ("", "_c0")]
    by = [n if n in cols else cols[k] for k, n in enumerate(names)]
    return raw.select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], stem(F.col(by[0])).alias("stem"))
