"""Colours of pixels as column expressions, and look-up tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["img"]
# The sRGB to XYZ matrix and the D65 white point.
RGB_TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.95047, 1.0, 1.08883)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> list[Column]:
    """Hue, saturation and value, all from 0 to 1, of channels from 0 to 1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    hue = F.when(d == 0, 0.0).when(top == b, 4 + (r - g) / d).when(top == g, 2 + (b - r) / d).otherwise((g - b) / d) / 6
    return [F.pmod(hue, F.lit(1.0)), F.when(top == 0, 0.0).otherwise(d / top), top]


def rgb_to_xyz(r: Column, g: Column, b: Column) -> list[Column]:
    """CIE XYZ of sRGB channels from 0 to 1."""
    linear = [F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92) for c in (r, g, b)]
    return [sum(F.lit(m) * c for m, c in zip(row, linear, strict=True)) for row in RGB_TO_XYZ]


def rgb_to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    """CIE L*a*b* of sRGB channels from 0 to 1."""
    f = [F.when(c / w > 0.008856, F.cbrt(c / w)).otherwise(7.787 * c / w + 16 / 116) for c, w in zip(rgb_to_xyz(r, g, b), WHITE, strict=True)]
    return [116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])]


def rgb_to_luv(r: Column, g: Column, b: Column) -> list[Column]:
    """CIE L*u*v* of sRGB channels from 0 to 1."""
    x, y, z = rgb_to_xyz(r, g, b)
    light = F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y)
    d = x + 15 * y + 3 * z
    wd = WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2]
    u = F.when(d > 0, 13 * light * (4 * x / d - 4 * WHITE[0] / wd)).otherwise(0.0)
    return [light, u, F.when(d > 0, 13 * light * (9 * y / d - 9 * WHITE[1] / wd)).otherwise(0.0)]


SPACES = {"rgb": lambda *c: list(c), "hsv": rgb_to_hsv, "xyz": rgb_to_xyz, "lab": rgb_to_lab, "luv": rgb_to_luv}


def convert(px: DataFrame, channels: list[str], space: str) -> DataFrame:
    """Channels (from 0 to 1) in another colour space, under the same names."""
    made = SPACES[space](*map(F.col, channels))
    return px.withColumns(dict(zip(channels, made, strict=True)))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    """Red, green and blue, from 0 to 1, of hue, saturation and value."""
    part = lambda n: v - v * s * F.greatest(F.lit(0.0), F.least(F.pmod(n + h * 6, F.lit(6.0)), 4 - F.pmod(n + h * 6, F.lit(6.0)), F.lit(1.0)))
    return [part(F.lit(n)) for n in (5.0, 3.0, 1.0)]


def xyz_to_rgb(x: Column, y: Column, z: Column) -> list[Column]:
    """Red, green and blue of CIE XYZ, held between 0 and 1."""
    back = np.linalg.inv(np.array(RGB_TO_XYZ)).tolist()
    linear = [F.greatest(sum(F.lit(m) * c for m, c in zip(row, (x, y, z), strict=True)), F.lit(0.0)) for row in back]
    return [F.least(F.when(c > 0.0031308, 1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * c), F.lit(1.0)) for c in linear]


def lab_to_rgb(light: Column, a: Column, b: Column) -> list[Column]:
    """Red, green and blue of CIE L*a*b*."""
    fy = (light + 16) / 116
    back = [F.when(f > 0.2068966, F.pow(f, F.lit(3.0))).otherwise((f - 16 / 116) / 7.787) * w for f, w in zip((fy + a / 500, fy, fy - b / 200), WHITE, strict=True)]
    return xyz_to_rgb(*back)


BACK = {"rgb": lambda *c: list(c), "hsv": hsv_to_rgb, "xyz": xyz_to_rgb, "lab": lab_to_rgb}


def convert_back(px: DataFrame, channels: list[str], space: str) -> DataFrame:
    """Channels of a colour space (rgb, hsv, xyz, lab) as red, green and blue, under the same names."""
    return px.withColumns(dict(zip(channels, BACK[space](*map(F.col, channels)), strict=True)))


def scale_range(px: DataFrame, channel: str) -> DataFrame:
    """A channel of each image stretched from 0 to 1; 0 where it is flat."""
    ends = px.groupBy(*KEY).agg(F.min(channel).alias("_lo"), F.max(channel).alias("_hi"))
    value = F.when(F.col("_hi") > F.col("_lo"), (F.col(channel) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return px.join(ends, KEY).withColumn(channel, value).drop("_lo", "_hi")


def scale_quantiles(px: DataFrame, channel: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """As ``scale_range`` between two quantiles of each image, values beyond them cut."""
    q = px.groupBy(*KEY).agg(F.percentile(channel, F.array(F.lit(low), F.lit(high))).alias("_q"))
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    value = F.when(hi > lo, (F.least(F.greatest(F.col(channel).cast("double"), lo), hi) - lo) / (hi - lo)).otherwise(0.0)
    return px.join(q, KEY).withColumn(channel, value).drop("_q")


def distinct_colors(px: DataFrame, channels: list[str]) -> DataFrame:
    """The colours of each image."""
    return px.select(*KEY, *channels).distinct()


def frequent_colors(px: DataFrame, channels: list[str], ratio: float = 0.001) -> DataFrame:
    """Colours of at least a share of an image's pixels, added up over images: (channels, n)."""
    n = px.groupBy(*KEY, *channels).agg(F.count("*").alias("n"))
    n = n.withColumn("_t", F.sum("n").over(Window.partitionBy(*KEY))).where(F.col("n") >= F.col("_t") * ratio)
    return n.groupBy(*channels).agg(F.sum("n").alias("n"))


def colors_to_labels(px: DataFrame, palette: DataFrame, channels: list[str], strict: bool = False) -> DataFrame:
    """Adds ``label`` by a palette (channels, label); -1 for other colours, or an error if ``strict``."""
    out = px.join(palette, channels, "left")
    other = F.raise_error(F.lit("a pixel's colour is not in the palette")).cast("int") if strict else F.lit(-1)
    return out.withColumn("label", F.coalesce("label", other))


def labels_to_colors(seg: DataFrame, label: str, palette: DataFrame, channels: list[str]) -> DataFrame:
    """Adds a label's colour; a label without one is an error."""
    out = seg.join(palette.withColumnRenamed("label", label), label, "left")
    missing = F.raise_error(F.lit("a label has no colour")).cast("int")
    return out.withColumns({c: F.when(F.col(c).isNull(), missing).otherwise(F.col(c)) for c in channels})


def nearest_color(px: DataFrame, palette: list[tuple[int, ...]], channels: list[str]) -> DataFrame:
    """Adds ``label``: the number of the nearest colour (sum of absolute differences), the first of equals."""
    d = [F.struct(sum(F.abs(F.col(c) - v) for c, v in zip(channels, color, strict=True)).alias("d"), F.lit(k).alias("k")) for k, color in enumerate(palette)]
    return px.withColumn("label", (F.array_min(F.array(*d))["k"] if len(d) > 1 else F.lit(0)).cast("int"))


def quantize(px: DataFrame, palette: list[tuple[int, ...]], channels: list[str]) -> DataFrame:
    """Pixels with their nearest palette colour."""
    near = nearest_color(px, palette, channels)
    table = {c: F.array(*[F.lit(color[k]) for color in palette]) for k, c in enumerate(channels)}
    return near.withColumns({c: t[F.col("label")] for c, t in table.items()})
