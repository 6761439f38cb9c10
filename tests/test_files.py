import struct
import zlib

from pixelmill.sources import files
from pixelmill.streaming import pixels


def png(path, rows):
    """A colour PNG of rows of (r, g, b)."""
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(v for p in r for v in p) for r in rows)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    png(tmp_path / "a_1.png", [[(1, 2, 3), (255, 0, 16)]])
    got = files.images(spark, f"file://{tmp_path}/*.png").orderBy("x").collect()
    assert [tuple(r) for r in got] == [("a_1", 0, 0, 1, 2, 3), ("a_1", 0, 1, 255, 0, 16)]


def test_landmarks(spark, tmp_path):
    pts = spark.createDataFrame([("p", 0, 5.0, 7.0), ("p", 1, -1.0, 2.0), ("q", 0, 3.0, 4.0)], "img string, idx int, x double, y double")
    files.write_landmarks_csv(pts, f"file://{tmp_path}/csv")
    back = files.landmarks_csv(spark, f"file://{tmp_path}/csv/*")
    assert sorted((r["idx"], r["x"], r["y"]) for r in back.collect()) == [(0, 3, 4), (0, 5, 7), (1, -1, 2)]
    files.write_landmarks_txt(pts, f"file://{tmp_path}/txt")
    back = files.landmarks_txt(spark, f"file://{tmp_path}/txt/*/*.txt")
    assert sorted((r["idx"], r["x"], r["y"]) for r in back.collect()) == [(0, 3, 4), (0, 5, 7), (1, -1, 2)]


def test_tables(spark, tmp_path):
    (tmp_path / "p.txt").write_text('"sigma": 3.5,\n"name": abc\nother line\n')
    assert {r["name"]: r["value"] for r in files.parameters_txt(spark, f"file://{tmp_path}/p.txt").collect()} == {"sigma": "3.5", "name": "abc"}
    (tmp_path / "c.json").write_text('{"0": [0, 0, 255], "3": [1, 2, 3]}')
    assert sorted(map(tuple, files.palette_json(spark, f"file://{tmp_path}/c.json").collect())) == [(0, 0, 0, 255), (3, 1, 2, 3)]
    for n in ("x/a.png", "x/b.png", "y/a.csv"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("1")
    tables = [files.paths(spark, f"file://{tmp_path}/{d}") for d in ("x", "y")]
    assert [r["stem"] for r in files.matched_paths(tables, ["i", "c"]).collect()] == ["a"]
    assert files.matched_paths(tables, ["i", "c"], drop_incomplete=False).count() == 2


def test_samples_and_bands(spark):
    s = files.stripes(spark, 10, 20, 3)
    assert s.count() == 200 and s.select("label").distinct().count() == 3 and s.where("x = 19").select("label").distinct().collect()[0][0] == 2
    v = files.stripes(spark, 2, 4, 2, levels=4)
    assert {(r["band"], r["z"]) for r in files.split_bands(v).collect()} == {(1, 0), (1, 1), (2, 0), (2, 1)}
    assert files.split_bands(v, interleaved=False).where("band = 2 and z = 0").select("label").agg({"label": "min"}).first()[0] == 4
    a, b = files.random_image(spark, 5, 6, 3).collect(), files.random_image(spark, 5, 6, 3).collect()
    assert a == b and len(a) == 30


def test_stream(spark, tmp_path):
    rows = [(0, y, x, y * x, 1, 2, y // 2, x % 2) for y in range(4) for x in range(4)]
    spark.createDataFrame(rows, pixels.PIXELS).repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = pixels.read_pixels(spark, f"file://{tmp_path}/in", files_a_batch=1)
    q = pixels.write_batches(pixels.running_statistics(stream, "lb", ["c1"]), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    q.awaitTermination(120)
    last = spark.read.parquet(f"file://{tmp_path}/out").orderBy("batch")
    top = last.agg({"batch": "max"}).first()[0]
    assert {r["lb"]: r["n"] for r in last.where(f"batch = {top}").collect()} == {0: 8, 1: 8}
