"""Linear filters over rasters: tiles with a margin meet all kernels at once, as one matrix product a tile."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pixelmill.session import checkpoint_folder

KEY = ["img"]
TILE = 64
#: Tiles of a partition.
TILES = 50
Kernel = list[tuple[int, int, float]]


def _reflected(at: str, size: str, reach: int):
    """The places at which a pixel's value is read: its own, and those beyond the border that mirror it."""
    k, n = F.col(at), F.col(size)
    if not reach:
        return F.array(k)
    period = F.sequence(F.lit(-((reach + 1) // 2)), F.lit((reach + 1) // 2))
    every = F.flatten(F.transform(period, lambda p: F.array(k + p * 2 * n, 2 * n - 1 - k + p * 2 * n)))
    return F.array_distinct(F.filter(every, lambda y: (y >= -reach) & (y < n + reach)))


def convolve(px: DataFrame, channel: str, kernels: dict[str, Kernel], axes: tuple[str, str] = ("y", "x"), depth: tuple[str, ...] = (), mirror: bool = True) -> DataFrame:
    """Adds a column a kernel, given as (dy, dx, weight): the weighted sum of the pixels at these steps from each.

    The image goes on mirrored beyond its border, or as zeros. Rasters are cut into tiles of ``TILE`` x ``TILE`` pixels with a margin of
    the kernels' reach, so an image of any size is many tasks; ``depth`` names axes whose planes are filtered each by itself.
    """
    return convolve_all(px, {channel: {n: n for n in kernels}}, kernels, axes, depth, mirror)


def convolve_all(px: DataFrame, channels: dict[str, dict[str, str]], kernels: dict[str, Kernel], axes: tuple[str, str] = ("y", "x"), depth: tuple[str, ...] = (), mirror: bool = True) -> DataFrame:
    """As ``convolve`` for several channels, whose tiles are cut once; ``channels`` has, of each, the name of its column for every kernel."""
    reach = max(max(abs(dy), abs(dx)) for k in kernels.values() for dy, dx, _ in k)
    side, wide = 2 * reach + 1, TILE + 2 * reach
    weights = np.zeros((side * side, len(kernels)))
    for j, taps in enumerate(kernels.values()):
        for dy, dx, w in taps:
            weights[(dy + reach) * side + dx + reach, j] += w
    plane = [*KEY, *depth]
    ay, ax = axes
    # a pixel's row goes with it to the tile that it belongs to, so filtered values need no join with the raster
    base = px.dropna(subset=plane).select(*plane, F.col(ay).cast("int").alias("_y"), F.col(ax).cast("int").alias("_x"), *[F.col(c).cast("double").alias(f"_v{k}") for k, c in enumerate(channels)], F.struct(*[F.col(f"`{c}`") for c in px.columns]).alias("_row"))
    checkpoint_folder(px.sparkSession)
    ends = px.groupBy(*plane).agg((F.max(F.col(ay).cast("int")) + 1).alias("_h"), (F.max(F.col(ax).cast("int")) + 1).alias("_w")).checkpoint()
    if mirror:
        base = base.join(ends.groupBy(*KEY).agg(F.max("_h").alias("_h"), F.max("_w").alias("_w")), KEY).withColumn("_y", F.explode(_reflected("_y", "_h", reach))).withColumn("_x", F.explode(_reflected("_x", "_w", reach)))
        base = base.withColumn("_in", (F.col("_y") >= 0) & (F.col("_y") < F.col("_h")) & (F.col("_x") >= 0) & (F.col("_x") < F.col("_w")))
    else:
        base = base.withColumn("_in", F.lit(True))
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / TILE).cast("int"), F.floor((F.col(c) + reach) / TILE).cast("int")))
    base = base.withColumn("_ty", tiles("_y")).withColumn("_tx", tiles("_x"))
    own_tile = F.col("_in") & (F.floor(F.col("_y") / TILE) == F.col("_ty")) & (F.floor(F.col("_x") / TILE) == F.col("_tx"))
    values = [f"_v{k}" for k in range(len(channels))]
    base = base.select(*plane, "_ty", "_tx", "_y", "_x", *values, own_tile.alias("_in"), F.when(own_tile, F.col("_row")).alias("_row"))
    # dealt by the number of tiles, as small partitions that Spark puts together grow with the input
    tiled = ends.agg(F.sum(F.ceil(F.col("_h") / TILE) * F.ceil(F.col("_w") / TILE))).first()[0] or 0
    base = base.repartition(max(px.sparkSession.sparkContext.defaultParallelism, -(-int(tiled) // TILES)), *plane, "_ty", "_tx")
    names = [of[n] for of in channels.values() for n in kernels]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        y0, x0 = (k.as_py() * TILE for k in key[-2:])
        y, x, own = (table.column(c).to_numpy() for c in ("_y", "_x", "_in"))
        oy, ox = y[own], x[own]
        out = np.empty((len(oy), len(names)))
        for k, c in enumerate(values):
            grid = np.zeros((wide, wide))
            grid[y - y0 + reach, x - x0 + reach] = np.nan_to_num(table.column(c).to_numpy())
            windows = np.lib.stride_tricks.sliding_window_view(grid, (side, side))
            for a in range(0, len(oy), 4096):
                s = slice(a, a + 4096)
                out[s, k * len(kernels) : (k + 1) * len(kernels)] = windows[oy[s] - y0, ox[s] - x0].reshape(-1, side * side) @ weights
        rows = table.column("_row").filter(pa.array(own)).combine_chunks()
        rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
        made = [*rows.flatten(), *[pa.array(out[:, j]) for j in range(len(names))]]
        return pa.table(made, [*[f.name for f in rows.type], *names])

    schema = StructType([*px.schema.fields, *[StructField(n, DoubleType()) for n in names]])
    return base.groupBy(*plane, "_ty", "_tx").applyInArrow(run, schema)


def gaussian_1d(sigma: float, order: int = 0, mean: float = 0.0, reach: int | None = None) -> list[float]:
    """A Gaussian, or its first or second derivative, at whole numbers, scaled to a sum of absolute values of 1 (and, for derivatives, to zero mean)."""
    r = reach if reach is not None else max(1, math.ceil(3 * sigma))
    var = sigma * sigma
    g = [math.exp(-((k - mean) ** 2) / (2 * var)) for k in range(-r, r + 1)]
    if order == 1:
        g = [-v * (k - mean) / var for k, v in zip(range(-r, r + 1), g, strict=True)]
    elif order == 2:
        g = [v * ((k - mean) ** 2 - var) / var**2 for k, v in zip(range(-r, r + 1), g, strict=True)]
    if order:
        m = sum(g) / len(g)
        g = [v - m for v in g]
    size = sum(map(abs, g))
    return [v / size for v in g]


def gaussian_taps(sigma: float, reach: int | None = None) -> Kernel:
    """A round Gaussian of unit sum."""
    g = gaussian_1d(sigma, 0, 0.0, reach)
    r = len(g) // 2
    return [(dy, dx, g[dy + r] * g[dx + r]) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def laplacian_taps(sigma: float, reach: int | None = None) -> Kernel:
    """The Laplacian of a Gaussian, of zero mean and unit absolute sum."""
    r = reach if reach is not None else max(1, math.ceil(3 * sigma))
    var = sigma * sigma
    taps = [(dy, dx, (dy * dy + dx * dx - 2 * var) / var**2 * math.exp(-(dy * dy + dx * dx) / (2 * var))) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    return _scaled(taps)


def _scaled(taps: Kernel) -> Kernel:
    mean = sum(w for *_, w in taps) / len(taps)
    size = sum(abs(w - mean) for *_, w in taps)
    return [(dy, dx, (w - mean) / size) for dy, dx, w in taps]


def oriented_taps(sigma: float, angle: float, order: int, reach: int) -> Kernel:
    """An oriented Gaussian derivative (order 1: edge, 2: bar), three times as long as wide, of zero mean and unit absolute sum."""
    taps = []
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            u, v = dx * math.cos(angle) + dy * math.sin(angle), dy * math.cos(angle) - dx * math.sin(angle)
            g = math.exp(-v * v / (2 * sigma**2)) * math.exp(-u * u / (2 * (3 * sigma) ** 2))
            taps.append((dy, dx, g * (-v / sigma**2 if order == 1 else (v * v - sigma**2) / sigma**4)))
    return _scaled(taps)


def filter_bank(sigmas: tuple[float, ...] = (math.sqrt(2), 2.0, 2 * math.sqrt(2), 4.0), orientations: int = 8, reach: int | None = None) -> dict[str, dict[str, Kernel]]:
    """Families of kernels, of which the largest response of a family counts: edges and bars in all orientations of each scale, and for each
    scale a Gaussian, a Laplacian and a Laplacian of three times the scale."""
    bank: dict[str, dict[str, Kernel]] = {}
    for k, s in enumerate(sigmas):
        r = reach if reach is not None else math.ceil(3 * s)
        for name, order in (("edge", 1), ("bar", 2)):
            bank[f"s{k}_{name}"] = {f"s{k}_{name}{j}": oriented_taps(s, math.pi * j / orientations, order, r) for j in range(orientations)}
        bank[f"s{k}_gauss"] = {f"s{k}_gauss0": gaussian_taps(s, r)}
        bank[f"s{k}_log"] = {f"s{k}_log0": laplacian_taps(s, r)}
        bank[f"s{k}_log3"] = {f"s{k}_log30": laplacian_taps(3 * s, r)}
    return bank


def bank_response(px: DataFrame, channel: str, bank: dict[str, dict[str, Kernel]], depth: tuple[str, ...] = ()) -> DataFrame:
    """Adds a column a family: the largest response of its kernels. One pass over the tiles serves all kernels; planes of a volume are filtered one by one."""
    return _largest(px, {channel: {f: f for f in bank}}, bank, depth)


def bank_responses(px: DataFrame, channels: list[str], bank: dict[str, dict[str, Kernel]], depth: tuple[str, ...] = ()) -> DataFrame:
    """As ``bank_response`` for several channels in one pass, with a column <channel>_<family> for each."""
    return _largest(px, {c: {f: f"{c}_{f}" for f in bank} for c in channels}, bank, depth)


def _largest(px: DataFrame, channels: dict[str, dict[str, str]], bank: dict[str, dict[str, Kernel]], depth: tuple[str, ...]) -> DataFrame:
    every = reduce(lambda a, b: a | b, bank.values(), {})
    one = len(channels) == 1
    made = {c: {n: n if one else f"_{c}_{n}" for n in every} for c in channels}
    out = convolve_all(px, made, every, depth=depth)
    best = {of[f]: F.greatest(*[F.col(made[c][n]) for n in taps]) if len(taps) > 1 else F.col(made[c][next(iter(taps))]) for c, of in channels.items() for f, taps in bank.items()}
    return out.select(*px.columns, *[c.alias(f) for f, c in best.items()])


def subtract_smooth(px: DataFrame, channel: str, sigma: float, depth: tuple[str, ...] = ()) -> DataFrame:
    """The channel less its Gaussian mean, plane by plane."""
    return convolve(px, channel, {"_smooth": gaussian_taps(sigma)}, depth=depth).withColumn(channel, F.col(channel) - F.col("_smooth")).drop("_smooth")
