import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.operators import contours


def raster(spark, images, starts):
    rows = [(i, y, x, None if v is None or v != v else float(v), int(s[y, x])) for i, (img, s) in enumerate(zip(images, starts)) for y, r in enumerate(img) for x, v in enumerate(r.tolist())]
    return spark.createDataFrame(rows, "img int, y int, x int, v double, start int")


def disk(h, w, y, x, r):
    yy, xx = np.mgrid[:h, :w]
    return (yy - y) ** 2 + (xx - x) ** 2 < r * r


def one_by_one(img, start, l1, l2, smoothing, rounds):
    """The same evolution of one object, pixel by pixel."""
    h, w = img.shape
    u = start > 0
    turn = 0

    def at(a, y, x):
        return bool(a[y, x]) if 0 <= y < h and 0 <= x < w else False

    def lines(a, y, x):
        return [[at(a, y - dy, x - dx), at(a, y, x), at(a, y + dy, x + dx)] for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1))]

    for _ in range(rounds):
        c1 = img[u].mean() if u.any() else 0.0
        c0 = img[~u].mean() if (~u).any() else 0.0
        slope = sum(np.abs(g) for g in np.gradient(u.astype(float)))
        pull = l1 * (img - c1) ** 2 - l2 * (img - c0) ** 2
        u = np.where((slope > 0) & (pull < 0), True, np.where((slope > 0) & (pull > 0), False, u))
        for _ in range(smoothing):
            ops = [lambda a, y, x: all(any(s) for s in lines(a, y, x)), lambda a, y, x: any(all(s) for s in lines(a, y, x))]
            for f in ops if turn % 2 == 0 else ops[::-1]:
                u = np.array([[f(u, y, x) for x in range(w)] for y in range(h)])
            turn += 1
    return u


def found(df, shape, img=0):
    out = np.zeros(shape, int)
    for r in df.where(F.col("img") == img).collect():
        out[r["y"], r["x"]] = r["contour"]
    return out


@pytest.mark.parametrize("smoothing", [1, 2])
def test_like_pixel_by_pixel(spark, smoothing):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 9, (14, 17)) + 20 * disk(14, 17, 7, 8, 5), rng.integers(0, 30, (12, 9))]
    starts = [disk(14, 17, 6, 6, 3), disk(12, 9, 5, 4, 4)]
    df = contours.active_contours(raster(spark, images, starts), "v", "start", (2, 1), smoothing, 5)
    for k, (i, s) in enumerate(zip(images, starts)):
        assert (found(df, i.shape, k) == one_by_one(i.astype(float), s, 2, 1, smoothing, 5)).all()


def test_disk_from_a_seed_in_tiles_of_any_size(spark):
    """Small seeds find two disks in noise; whole images and tiles give one result, which has come to rest."""
    rng = np.random.default_rng(5)
    img = rng.integers(0, 20, (40, 52)) + 60 * (disk(40, 52, 15, 14, 9) | disk(40, 52, 26, 38, 8))
    start = disk(40, 52, 14, 13, 4) + 2 * disk(40, 52, 26, 37, 4)
    px = raster(spark, [img], [start]).cache()
    whole = contours.active_contours(px, "v", "start", (1, 1), 1, 24).cache()
    got = found(whole, img.shape)
    for k, (y, x, r) in enumerate(((15, 14, 9), (26, 38, 8)), 1):
        true = disk(40, 52, y, x, r)
        assert ((got == k) & true).sum() / ((got == k) | true).sum() > 0.9
    assert {r["settled"] for r in whole.select("settled").distinct().collect()} == {True}
    assert whole.agg(F.max("rounds")).first()[0] < 24
    tiles = contours.active_contours(px, "v", "start", (1, 1), 1, 24, tile=16, block=0)
    assert whole.exceptAll(tiles).isEmpty() and tiles.exceptAll(whole).isEmpty()


def test_tiles_and_blocks_agree_on_odd_rows(spark):
    """Holes without a value, null and NaN, objects that touch, an image without objects and a number of rounds that ends it early."""
    rng = np.random.default_rng(9)
    a = rng.integers(0, 40, (21, 19)).astype(float)
    a[rng.random(a.shape) < 0.1] = np.nan
    start = np.where(np.arange(19)[None, :] < 9, 3, 5) * (rng.random(a.shape) < 0.9)
    px = raster(spark, [a, np.ones((4, 5))], [start, np.zeros((4, 5))])
    px = px.union(spark.createDataFrame([(0, 40, 2, float("nan"), 7), (1, 9, 9, 3.0, None)], px.schema))
    args = ("v", "start", (3, 3), 2, 3)
    one = contours.active_contours(px, *args)
    two = contours.active_contours(px, *args, tile=7, block=0)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    assert one.where("v is null or isnan(v)").agg(F.max("contour")).first()[0] == 0
    assert one.count() == px.count()
    assert contours.active_contours(px.limit(0), *args).count() == 0


def test_disk_starts(spark):
    px = raster(spark, [np.zeros((9, 9))], [np.zeros((9, 9))])
    got = contours.disk_starts(px.drop("start"), spark.createDataFrame([(0, 1, 4.0, 2.0), (0, 2, 4.0, 6.0)], "img int, idx int, y double, x double"), 3)
    out = {(r["y"], r["x"]): r["start"] for r in got.collect()}
    assert out[4, 4] == 1 and out[4, 5] == 2 and out[4, 0] == 1 and out[0, 0] == 0
    assert sum(v == 1 for v in out.values()) == disk(9, 9, 4, 2, 3).sum()
