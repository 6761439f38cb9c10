import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from oracle import same

from pixelmill.operators import maxflow, segmentation, watershed
from pixelmill.plans import partitions  # noqa: F401  adds to the catalog
from pixelmill.plans.catalog import ORACLE, QUERIES


def raster(spark, images, name="h"):
    return spark.createDataFrame([(i, y, x, v) for i, img in enumerate(images) for y, r in enumerate(img) for x, v in enumerate(r.tolist())], f"img int, y int, x int, {name} {'double' if images[0].dtype.kind == 'f' else 'int'}")


def array(df, images, name):
    out = [np.zeros(i.shape, int) for i in images]
    for r in df.collect():
        out[r["img"]][r["y"], r["x"]] = r[name]
    return out


def kruskal(height, seeds, mask):
    """Basins by adding edges one after the other, never between two parts with seeds."""
    h, w = height.shape
    part = {(y, x): (y, x) for y in range(h) for x in range(w) if mask[y, x]}
    label = {p: seeds[p] for p in part if p in seeds}

    def root(p):
        while part[p] != p:
            p = part[p]
        return p

    edges = [(max(height[p], height[q]), p, q) for p in part for q in ((p[0], p[1] + 1), (p[0] + 1, p[1])) if q in part]
    for _, p, q in sorted(edges):
        a, b = root(p), root(q)
        if a != b and not (a in label and b in label):
            if a in label:
                a, b = b, a
            part[a] = b
    out = np.zeros((h, w), int)
    for p in part:
        out[p] = label.get(root(p), 0)
    return out


@pytest.mark.parametrize("tile", [256, 5, 3])
def test_watershed_like_one_edge_after_the_other(spark, tile):
    """Three images with ties of height, a mask that cuts them in parts, seeds on and off it; tiles of any size give one result."""
    rng = np.random.default_rng(4)
    heights = [rng.integers(0, 5, (11, 13)), rng.integers(0, 3, (7, 4)), np.zeros((6, 6), int)]
    masks = [rng.random(h.shape) < 0.8 for h in heights]
    seeds, rows = [], []
    for i, h in enumerate(heights):
        at = {(int(rng.integers(h.shape[0])), int(rng.integers(h.shape[1]))): k + 1 for k in range(6)}
        seeds.append(at)
        rows += [(i, y, x, k) for (y, x), k in at.items()] + [(i, y, x, k + 50) for (y, x), k in at.items()]
    px = raster(spark, heights).join(raster(spark, [m.astype(int) for m in masks], "m"), ["img", "y", "x"])
    found = array(watershed.watershed(px, "h", spark.createDataFrame(rows, "img int, y int, x int, label int"), "m", tile), heights, "basin")
    for h, m, s, f in zip(heights, masks, seeds, found):
        assert (f == kruskal(h, s, m)).all()


def test_watershed_of_nothing(spark):
    px = raster(spark, [np.zeros((3, 3), int)])
    none = spark.createDataFrame([], "img int, y int, x int, label int")
    assert {r["basin"] for r in watershed.watershed(px, "h", none).collect()} == {0}
    assert watershed.watershed(px.limit(0), "h", none).count() == 0


def disks(side, centres, radius):
    y, x = np.mgrid[:side, :side]
    return np.any([(y - a) ** 2 + (x - b) ** 2 <= radius**2 for a, b in centres], axis=0)


def test_touching_disks_are_parted(spark):
    """Two disks that overlap, one with a hole: each centre gets its half, the hole with it."""
    m = disks(40, [(20, 12), (20, 27)], 9)
    m[19:21, 11:13] = False
    centres = spark.createDataFrame([(0, 7, 20.0, 12.0), (0, 3, 20.2, 27.4)], "img int, idx int, y double, x double")
    found = array(watershed.object_watershed(raster(spark, [m.astype(int)], "s"), "s", centres), [m], "object")[0]
    y, x = np.mgrid[:40, :40]
    inside = disks(40, [(20, 12), (20, 27)], 9)
    assert (found[~inside] == 0).all() and (found[inside & (x < 19)] == 2).all() and (found[inside & (x > 20)] == 1).all()


def test_objects_by_pixels(spark):
    segm = np.array([[0] * 10, [1] * 5 + [0] * 5, [1] * 4 + [0] * 6, [0] * 6 + [1] * 4, [0] * 5 + [1] * 5, [0] * 10])
    centres = spark.createDataFrame([(0, 0, 1.0, 2.0), (0, 1, 4.0, 8.0)], "img int, idx int, y double, x double")
    want = segm.copy()
    want[3:][segm[3:] == 1] = 2
    px = raster(spark, [segm], "s")
    assert (array(segmentation.object_pixels(px, "s", centres, regularisation=0.5, seed=1), [segm], "object")[0] == want).all()
    cheapest = array(segmentation.object_pixels(px, "s", centres, regularisation=0.0, shape=0.5, radius=(3.0, 1.0)), [segm], "object")[0]
    assert (cheapest == want).all()  # a prior of size so small decides by distance


def test_pixels_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(9)
    segm = (rng.random((14, 16)) < 0.45).astype(int)
    px = raster(spark, [segm], "s")
    centres = spark.createDataFrame([(0, 0, 4.0, 4.0), (0, 1, 9.0, 12.0)], "img int, idx int, y double, x double")
    whole = array(segmentation.object_pixels(px, "s", centres, (0.3, 0.8), 0.4, 2, 0.3, (6.0, 2.0)), [segm], "object")[0]
    monkeypatch.setattr(maxflow.graph_cut, "__defaults__", (*maxflow.graph_cut.__defaults__[:-1], 50))
    tiled = array(segmentation.object_pixels(px, "s", centres, (0.3, 0.8), 0.4, 2, 0.3, (6.0, 2.0), tile=6), [segm], "object")[0]
    assert (tiled == whole).all() and len(np.unique(whole)) > 1


@pytest.mark.parametrize("name", ["cut_energy", "watershed_basins"])
def test_queries_at_larger_scale(spark, name):
    assert same(QUERIES[name](spark, "/root/testdata/sf0.1"), ORACLE[name], "/root/testdata/sf0.1")


def test_images_in_one_call(spark):
    """A dark and a bright half, in a colour image of each light; each pixel's class follows its half."""
    rng = np.random.default_rng(6)
    images = []
    for light in (1.0, 1.0):
        img = rng.normal(0.3, 0.03, (30, 40)) * light
        img[:, 20:] += 0.4 * light
        images.append(img)
    px = raster(spark, images, "c1").selectExpr("*", "c1 * 0.5 AS c2", "1 - c1 AS c3")
    found = segmentation.segment_images(px, ["c1", "c2", "c3"], 2, 8, 0.5, {"color": ("mean", "std"), "color_hsv": ("mean",)}, 0.5)
    for f in array(found, images, "label"):
        assert (f[:, :18] == f[0, 0]).all() and (f[:, 22:] == f[0, 39]).all() and f[0, 0] != f[0, 39]
    names = segmentation.selected_features(found, "sp", ["c1"], {"color": ("mean",), "tLM_short": ("mean",)}).columns
    assert "color_c1_mean" in names and any(n.startswith("tLM_short_c1_") for n in names)
    with pytest.raises(ValueError):
        segmentation.selected_features(found, "sp", ["c1"], {"sound": ("mean",)})


def test_channels_are_filtered_in_one_pass(spark):
    rng = np.random.default_rng(3)
    px = raster(spark, [rng.random((20, 70))], "c1").selectExpr("*", "c1 * c1 AS c2", "int(x div 10) AS sp")
    both = segmentation.selected_features(px, "sp", ["c1", "c2"], {"tLM_short": ("mean", "energy")})
    assert both._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
    found = {r["sp"]: r for r in both.collect()}
    for c in ("c1", "c2"):
        part = segmentation.texture(px, c, "sp", *segmentation.BANKS["tLM_short"])
        names = [n for n in part.columns if n not in ("img", "sp")]
        assert [n for n in both.columns if n.startswith(f"tLM_short_{c}_")] == [f"tLM_short_{c}_{n}" for n in names]
        for r in part.collect():
            assert np.allclose([found[r["sp"]][f"tLM_short_{c}_{n}"] for n in names], [r[n] for n in names], rtol=1e-12)


def test_bright_regions_are_filtered_once(spark):
    from pixelmill.plans import partitions

    smooth, centres = partitions._bright(spark, "/root/testdata/sf0.001")
    assert all("FlatMapGroupsInArrow" not in d._jdf.queryExecution().optimizedPlan().toString() for d in (smooth, centres))
    assert smooth.where("m = 1").count() > 0 < centres.count()
