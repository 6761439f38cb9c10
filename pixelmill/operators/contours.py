"""Active contours without edges, by morphological steps on label rasters.

A round pulls the pixels at each object's contour to the side whose mean is nearer, then smooths the contour by line segments. Means are taken from whole
numbers (2 ** 16 to one), so they don't depend on the order of sums. An image whose box has at most ``BLOCK`` pixels is evolved in
one group; a larger one is cut in tiles with a margin of a round's reach, and of these only the ones that a contour crosses take part in a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.session import checkpoint_folder, scratch

KEY = ["img"]
BLOCK = 1 << 16
UNIT = 1 << 16
LINES = ((0, 1), (1, 0), (1, 1), (1, -1))


def disk_starts(px: DataFrame, centres: DataFrame, radius: int = 15, name: str = "start") -> DataFrame:
    """Adds ``name``: idx of the nearest of the centres (img, idx, y, x) less than ``radius`` away, of equally near ones the smallest; 0 without one."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    at = centres.select(*KEY, "idx", F.round("y").cast("int").alias("_cy"), F.round("x").cast("int").alias("_cx"))
    at = at.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps)).withColumn("_d", F.col("_dy") * F.col("_dy") + F.col("_dx") * F.col("_dx")).where(F.col("_d") < radius * radius)
    best = at.groupBy(*KEY, (F.col("_cy") + F.col("_dy")).alias("y"), (F.col("_cx") + F.col("_dx")).alias("x")).agg(F.min(F.struct("_d", "idx")).alias("_m"))
    return px.join(best, [*KEY, "y", "x"], "left").withColumn(name, F.coalesce("_m.idx", F.lit(0)).cast("int")).drop("_m")


def _moved(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """Each cell's neighbour (dy, dx) away, nothing beyond the grid."""
    h, w = a.shape
    return np.pad(a, 1)[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]


def _opened(u: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Cells that some line of three through them fills."""
    return there & np.logical_or.reduce([u & _moved(u, dy, dx) & _moved(u, -dy, -dx) for dy, dx in LINES])


def _closed(u: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Cells that every line of three through them touches."""
    return there & np.logical_and.reduce([u | _moved(u, dy, dx) | _moved(u, -dy, -dx) for dy, dx in LINES])


def _after(label: np.ndarray, value: np.ndarray, there: np.ndarray, means: list[tuple[int, float, float]], lambdas: tuple[float, float], smoothing: int, turn: int) -> np.ndarray:
    """Labels after a round; ``means`` has (label, mean inside, mean outside) by label. What several objects claim stays with its own one, or goes to the nearest mean."""
    best = np.full(label.shape, np.inf)
    out = np.zeros_like(label)
    beside = [(d, _moved(there, *d)) for d in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    for name, inside, outside in means:
        u = label == name
        down, up, right, left = (np.where(t, _moved(u, *d), u) for d, t in beside)
        at = there & ((down != up) | (right != left))
        pull = lambdas[0] * (value - inside) ** 2 - lambdas[1] * (value - outside) ** 2
        new = np.where(at & (pull != 0), pull < 0, u)
        for k in range(smoothing):
            first, then = (_closed, _opened) if (turn + k) % 2 == 0 else (_opened, _closed)
            new = then(first(new, there), there)
        claim = np.where(label == name, -1.0, (value - inside) ** 2)
        take = new & (claim < best)
        best[take] = claim[take]
        out[take] = name
    return out


def _mean(total: int, n: int) -> float:
    return float(total) / float(n) if n else 0.0


def _grids(y: np.ndarray, x: np.ndarray, q: np.ndarray, label: np.ndarray, y0: int, x0: int, height: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    there, value, names = np.zeros((height, width), bool), np.zeros((height, width), np.int64), np.zeros((height, width), np.int64)
    there[y - y0, x - x0], value[y - y0, x - x0], names[y - y0, x - x0] = True, q, label
    return there, value, names


def _whole(lambdas: tuple[float, float], smoothing: int):
    """Evolves one image with all its rounds."""

    def run(table: pa.Table) -> pa.Table:
        y, x, q, label = (table.column(c).to_numpy() for c in ("y", "x", "q", "label"))
        rounds, y0, x0 = int(table.column("most")[0].as_py()), int(y.min()), int(x.min())
        there, value, now = _grids(y, x, q, label, y0, x0, int(y.max()) - y0 + 1, int(x.max()) - x0 + 1)
        n, total, real = int(there.sum()), int(value.sum()), value.astype(float)
        before, t, settled = [], 0, False
        while t < rounds and not settled:
            means = []
            for name in np.unique(now[now > 0]).tolist():
                own = now == name
                k, s = int(own.sum()), int(value[own].sum())
                means.append((name, _mean(s, k), _mean(total - s, n - k)))
            before = [*before[-1:], now]
            now = _after(now, real, there, means, lambdas, smoothing, t * smoothing)
            t += 1
            settled = len(before) == 2 and bool((now == before[0]).all())
        last = before[1] if settled and (rounds - t) % 2 else now
        size = len(y)
        return pa.table({
            "img": table.column("img"), "y": table.column("y"), "x": table.column("x"), "contour": pa.array(last[y - y0, x - x0]),
            "rounds": pa.array(np.full(size, t, np.int32)), "settled": pa.array(np.full(size, settled))})

    return run


def _tile(tile: int, reach: int, lambdas: tuple[float, float], smoothing: int, turn: int):
    """One round in one tile: the pixels of it that change their label."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        img = left.column("img") if left.num_rows else right.column("_img")
        y, x, q, label = (left.column(c).to_numpy() for c in ("y", "x", "q", "label"))
        if not left.num_rows:
            return pa.table({"img": img[:0], "y": pa.array([], pa.int64()), "x": pa.array([], pa.int64()), "new": pa.array([], pa.int64())})
        ty, tx = (int(left.column(c)[0].as_py()) * tile for c in ("_ty", "_tx"))
        wide = tile + 2 * reach
        there, value, now = _grids(y, x, q, label, ty - reach, tx - reach, wide, wide)
        means = sorted(zip(*(right.column(c).to_pylist() for c in ("_name", "inside", "outside")), strict=True))
        new = _after(now, value.astype(float), there, means, lambdas, smoothing, turn)
        own = np.zeros_like(there)
        own[reach : reach + tile, reach : reach + tile] = True
        ys, xs = np.nonzero(there & own & (new != now))
        return pa.table({"img": pa.chunked_array([pa.array([img[0].as_py()] * len(ys), img.type)]), "y": pa.array(ys + ty - reach), "x": pa.array(xs + tx - reach), "new": pa.array(new[ys, xs])})

    return run


def _kept(df: DataFrame) -> DataFrame:
    """Written and read again: unlike a checkpoint that drops what the planner knows of columns copied from round to round, which doubles each time."""
    path = scratch(df.sparkSession, "contours")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _by_tiles(state: DataFrame, totals: DataFrame, lambdas: tuple[float, float], smoothing: int, tile: int) -> DataFrame:
    """Evolves large images a round at a time: (img, y, x, contour, rounds, settled)."""
    reach, kind, tiles = 2 * smoothing + 1, dict(state.dtypes)["img"], [*KEY, "_ty", "_tx"]

    def cut(c: str):
        return F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile)))

    none = F.lit(None).cast("long")
    state = _kept(state.select(*KEY, "y", "x", "q", "label", none.alias("prev"), none.alias("prev2")))
    totals = totals.select(*KEY, "most", "n", "total").checkpoint()
    done: list[DataFrame] = []
    t = 0
    while True:
        repeats = state.groupBy(*KEY).agg(F.bool_and(F.coalesce(F.col("label") == F.col("prev2"), F.lit(False))).alias("settled"))
        over = totals.join(repeats, KEY).where((F.col("most") <= t) | F.col("settled")).select(*KEY, "most", "settled").checkpoint()
        if not over.isEmpty():
            last = F.when(F.col("settled") & ((F.col("most") - t) % 2 == 1), F.col("prev")).otherwise(F.col("label"))
            done.append(state.join(over, KEY).select(*KEY, "y", "x", last.alias("contour"), F.lit(t).alias("rounds"), "settled").checkpoint())
            state = _kept(state.join(over, KEY, "left_anti"))
            totals = totals.join(over, KEY, "left_anti").checkpoint()
        if totals.isEmpty():
            break
        own = state.where("label > 0").groupBy(*KEY, "label").agg(F.count("*").alias("k"), F.sum("q").alias("s")).join(totals, KEY)
        rest = F.col("n") - F.col("k")
        means = own.select(*KEY, "label", (F.col("s").cast("double") / F.col("k").cast("double")).alias("inside"), F.when(rest > 0, (F.col("total") - F.col("s")).cast("double") / rest.cast("double")).otherwise(0.0).alias("outside"))
        spread = state.select(*KEY, "y", "x", "q", "label").withColumn("_ty", cut("y")).withColumn("_tx", cut("x"))
        crossed = spread.groupBy(*tiles).agg(F.min("label").alias("_a"), F.max("label").alias("_b"), F.count("*").alias("_n")).where((F.col("_b") > 0) & ((F.col("_a") != F.col("_b")) | (F.col("_n") < (tile + 2 * reach) ** 2)))
        band = spread.join(crossed, tiles, "left_semi")
        present = band.where("label > 0").select(*tiles, "label").distinct().join(means, [*KEY, "label"]).toDF("_img", "_name", "_y0", "_x0", "inside", "outside")
        moved = band.groupBy(*tiles).cogroup(present.groupBy("_img", "_y0", "_x0")).applyInArrow(_tile(tile, reach, lambdas, smoothing, t * smoothing), f"img {kind}, y long, x long, new long")
        state = _kept(state.join(moved, [*KEY, "y", "x"], "left").select(*KEY, "y", "x", "q", F.coalesce("new", "label").alias("label"), F.col("label").alias("prev"), F.col("prev").alias("prev2")))
        t += 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def active_contours(px: DataFrame, value: str, start: str, lambdas: tuple[float, float] = (3, 3), smoothing: int = 5, rounds: int | None = None, tile: int = 128, block: int = BLOCK) -> DataFrame:
    """Adds ``contour`` (long), ``rounds`` and ``settled``: labels that objects of ``start`` (above 0) reach by ``rounds`` rounds, half of the image's diagonal by default.

    Each object is parted from all else in the image by the two means of ``value``; ``lambdas`` weigh the squared distances to the inner and the outer one, and
    ``smoothing`` passes even out the contour after each round. ``settled`` tells whether labels came to repeat themselves (rounds alternate between two ways to smooth, so with a period of up
    to two), ``rounds`` when that was seen, else how many ran; what is returned is always what all rounds would give. Pixels without a value, or with NaN, are as if they
    weren't there and end as 0; beyond the image there is background. Pixels are there once each. Results don't depend on ``tile`` and ``block``.
    """
    checkpoint_folder(px.sparkSession)
    kind = dict(px.dtypes)["img"]
    v = F.col(value).cast("double")
    on = px.where(v.isNotNull() & ~F.isnan(v)).select(*KEY, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round(v * UNIT).cast("long").alias("q"), F.greatest(F.coalesce(F.col(start).cast("long"), F.lit(0)), F.lit(0)).alias("label"))
    high, wide = F.max("y") - F.min("y") + 1, F.max("x") - F.min("x") + 1
    most = F.floor(F.sqrt(high * high + wide * wide) / 2) if rounds is None else F.lit(rounds)
    sizes = on.groupBy(*KEY).agg(most.cast("long").alias("most"), F.count("*").alias("n"), F.sum("q").alias("total"), (high * wide <= block).alias("small")).checkpoint()
    small = on.join(sizes.where("small").select(*KEY, "most"), KEY)
    found = small.groupBy(*KEY).applyInArrow(_whole(lambdas, smoothing), f"img {kind}, y long, x long, contour long, rounds int, settled boolean")
    large = sizes.where("not small")
    if not large.isEmpty():
        found = found.union(_by_tiles(on.join(large.select(*KEY), KEY), large, lambdas, smoothing, tile))
    return px.join(found, [*KEY, "y", "x"], "left").withColumns({"contour": F.coalesce("contour", F.lit(0)), "settled": F.coalesce("settled", F.lit(True)), "rounds": F.coalesce("rounds", F.lit(0))})
