import gzip
import struct
import zlib

import numpy as np
import pytest

from pixelmill.sources import files, paged


def lzw_packed(data: bytes) -> bytes:
    """LZW as TIFF has it."""
    bits, width, table = [], 9, {}

    def put(code):
        bits.append(f"{code:0{width}b}")

    def clear():
        nonlocal width, table
        put(256)
        width, table = 9, {bytes([k]): k for k in range(256)} | {("end", k): 256 + k for k in range(2)}

    clear()
    have = b""
    for k in range(len(data)):
        more = have + data[k : k + 1]
        if more in table:
            have = more
            continue
        put(table[have])
        table[more] = len(table)
        have = data[k : k + 1]
        if len(table) >= 4095:
            put(table[have])
            have = b""
            clear()
        elif len(table) >> width:
            width += 1
    if have:
        put(table[have])
        if len(table) + 1 >> width and width < 12:
            width += 1
    put(257)
    all_ = "".join(bits)
    all_ += "0" * (-len(all_) % 8)
    return bytes(int(all_[k : k + 8], 2) for k in range(0, len(all_), 8))


def written(pages, order="<", packing=1, tile=None, rows=5, predictor=1):
    """A TIFF file of arrays (height, width, channels)."""
    pack = {1: bytes, 5: lzw_packed, 8: zlib.compress, 32773: lambda b: b"".join(bytes([0, c]) for c in b)}[packing]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for v in pages:
        h, w, c = v.shape
        if tile:
            th, tw = tile
            full = np.zeros((-(-h // th) * th, -(-w // tw) * tw, c), v.dtype)
            full[:h, :w] = v
            parts = [full[y : y + th, x : x + tw] for y in range(0, h, th) for x in range(0, w, tw)]
        else:
            parts = [v[y : y + rows] for y in range(0, h, rows)]
        at, size = [], []
        for p in parts:
            if predictor == 2:
                p = np.diff(p, axis=1, prepend=np.zeros_like(p[:, :1]))
            raw = pack(p.astype(p.dtype.newbyteorder(order)).tobytes())
            at.append(len(out))
            size.append(len(raw))
            out += raw + b"\0" * (len(raw) % 2)
        tags = {256: [w], 257: [h], 258: [8 * v.dtype.itemsize] * c, 259: [packing], 277: [c], 317: [predictor]}
        tags |= {322: [tile[1]], 323: [tile[0]], 324: at, 325: size} if tile else {273: at, 278: [rows], 279: size}
        places = {}
        for t, vals in tags.items():
            if len(vals) > 1:
                places[t] = len(out)
                out += struct.pack(f"{order}{len(vals)}I", *vals)
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(tags))
        for t in sorted(tags):
            out += struct.pack(order + "HHII", t, 4, len(tags[t]), places.get(t, tags[t][0]))
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def test_lzw_round_trip():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", b"aaaaaaaaaa", bytes(rng.integers(0, 256, 30000, np.uint8)), bytes(rng.integers(0, 3, 50000, np.uint8))):
        assert paged.lzw(lzw_packed(data)) == data
    with pytest.raises(ValueError):
        paged.lzw(b"\x01\x02\x03\x04")


@pytest.mark.parametrize("form", [
    {"packing": 5, "tile": (16, 16)}, {"packing": 5, "predictor": 2, "order": ">"}, {"packing": 1, "tile": (16, 32), "order": ">"}, {"packing": 32773}, {"packing": 8, "tile": (16, 16), "predictor": 2}])
def test_tiff(spark, tmp_path, form):
    """Strips and tiles of all packings, 8 and 16 bits, either order of bytes, two pages of different shapes; by range and as whole files."""
    rng = np.random.default_rng(2)
    pages = [rng.integers(0, 255, (21, 37, 3)).astype(np.uint8), rng.integers(0, 60000, (18, 5, 1)).astype(np.uint16)]
    (tmp_path / "one.tif").write_bytes(written(pages, **form))
    (tmp_path / "two.tif").write_bytes(written(pages[1:], **form))
    df = paged.tiff(spark, str(tmp_path), slab=600)
    rows = df.collect()
    assert len(rows) == 21 * 37 + 2 * 18 * 5
    for r in rows:
        v = pages[r["z"] if r["img"] == "one" else 1][r["y"], r["x"]]
        assert (r["c1"], r["c3"]) == (v[0], v[-1])
    assert df.rdd.getNumPartitions() > 3
    whole = files.tiff(spark, f"{tmp_path}/*.tif")
    assert df.exceptAll(whole).isEmpty() and whole.exceptAll(df).isEmpty()


def volume(v, order="<", code=4, slope=0.0, shift=0.0):
    head = bytearray(352)
    struct.pack_into(order + "i", head, 0, 348)
    struct.pack_into(order + "8h", head, 40, 3, v.shape[2], v.shape[1], v.shape[0], 1, 1, 1, 1)
    struct.pack_into(order + "2h", head, 70, code, 8 * v.dtype.itemsize)
    struct.pack_into(order + "3f", head, 108, 352, slope, shift)
    head[344:348] = b"n+1\0"
    return bytes(head) + v.astype(v.dtype.newbyteorder(order)).tobytes()


def test_nifti(spark, tmp_path):
    rng = np.random.default_rng(3)
    a, b = rng.integers(-999, 999, (5, 4, 6)).astype(np.int16), rng.random((3, 7, 2)).astype(np.float32)
    (tmp_path / "a.nii").write_bytes(volume(a, slope=0.5, shift=3))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(volume(b, ">", 16)))
    df = paged.nifti(spark, str(tmp_path), slab=100)
    assert df.rdd.getNumPartitions() == 4
    rows = df.collect()
    assert len(rows) == a.size + b.size
    for r in rows:
        want = a[r["z"], r["y"], r["x"]] * 0.5 + 3 if r["img"] == "a" else b[r["z"], r["y"], r["x"]]
        assert r["c1"] == pytest.approx(float(want))
    (tmp_path / "c.nii").write_bytes(volume(a)[:-10])
    with pytest.raises(Exception, match="ends early"):
        paged.nifti(spark, f"{tmp_path}/c.nii").collect()
    with pytest.raises(Exception, match="No such|FileNotFound"):
        paged.nifti(spark, f"{tmp_path}/none*").collect()
