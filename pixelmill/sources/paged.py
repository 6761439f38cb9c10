"""Rasters of any size in files that are read by range: TIFF pages in strips or tiles, and NIfTI volumes, as Python data sources.

The driver reads directories and headers only; a partition is a run of strips, tiles or slices of one page or volume, and its task seeks to
them. Paths have to lie on a file system that driver and executors mount; ``files.tiff`` reads TIFF files from any store that Spark
knows, a file a task.
"""

from __future__ import annotations

import glob
import gzip
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SLAB = 16 << 20
ROWS = 1 << 18
Read = Callable[[int, int], bytes]


def lzw(data: bytes) -> bytes:
    """Undo the LZW of TIFF: codes of 9 to 12 bits, high bits first, a width used one code early; 256 clears the table, 257 ends."""
    out, table, last = bytearray(), [], b""
    bits = width = held = 0
    start = [bytes([k]) for k in range(256)] + [b"", b""]
    width = 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code, held = held >> bits, held & ((1 << bits) - 1)
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = list(start), 9, b""
                continue
            if not table:
                raise ValueError("LZW data that don't begin with a clear code")
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise ValueError("LZW data are damaged")
            out += entry
            if last:
                table.append(last + entry[:1])
                if len(table) + 1 >> width and width < 12:
                    width += 1
            last = entry
    return bytes(out)


def packbits(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += 2 + n
        else:
            out += data[k + 1 : k + 2] * (257 - n if n > 128 else 0)
            k += 2 if n > 128 else 1
    return bytes(out)


UNPACK = {1: bytes, 5: lzw, 8: zlib.decompress, 32773: packbits, 32946: zlib.decompress}


def tiff_pages(read: Read) -> Iterator[dict]:
    """Of each page: width, height, channels, kind (of numpy), packing, predictor and chunks (at, size, y, x, height, width), strips or tiles, which may go beyond the page."""
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(bytes(head[:2]))
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF file of 32-bit offsets")
    (at,) = struct.unpack(order + "I", head[4:])
    form = {1: "B", 3: "H", 4: "I"}
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack(order + "H", read(at, 2))
        entries = read(at + 2, 12 * n + 4)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", entries, 12 * k)
            if kind in form:
                spec = f"{order}{count}{form[kind]}"
                size = struct.calcsize(spec)
                raw = entries[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else read(struct.unpack_from(order + "I", entries, 12 * k + 8)[0], size)
                tags[tag] = struct.unpack(spec, raw)
        one = lambda tag, default: tags.get(tag, (default,))[0]  # noqa: E731, B023
        bits, packing = one(258, 1), one(259, 1)
        if bits not in (8, 16) or packing not in UNPACK or one(284, 1) != 1 or one(317, 1) not in (1, 2) or one(339, 1) != 1:
            raise ValueError(f"a TIFF page with {bits} bits and packing {packing}, in planes, or with signed or broken numbers can't be read")
        width, height = tags[256][0], tags[257][0]
        if 324 in tags:
            w, h = tags[322][0], tags[323][0]
            across, places, sizes = -(-width // w), tags[324], tags[325]
        else:
            w, h = width, min(one(278, height), height)
            across, places, sizes = 1, tags[273], tags[279]
        tiled = 324 in tags
        chunks = [(p, s, k // across * h, k % across * w, h if tiled else min(h, height - k // across * h), w) for k, (p, s) in enumerate(zip(places, sizes, strict=True))]
        yield {"width": width, "height": height, "channels": one(277, 1), "kind": f"{order}u{bits // 8}", "packing": packing, "predictor": one(317, 1), "chunks": chunks}
        (at,) = struct.unpack_from(order + "I", entries, 12 * n)


def chunk_pixels(page: dict, chunk: tuple, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values (a row a pixel) of a strip or tile, without what goes beyond the page."""
    _, _, y0, x0, h, w = chunk
    n = h * w * page["channels"]
    v = np.frombuffer(UNPACK[page["packing"]](raw), page["kind"], n).reshape(h, w, page["channels"])
    v = v.astype(v.dtype.newbyteorder("="))
    if page["predictor"] == 2:
        v = np.cumsum(v, axis=1, dtype=v.dtype)
    v = v[: max(page["height"] - y0, 0), : max(page["width"] - x0, 0)]
    y, x = np.indices(v.shape[:2])
    return y.ravel() + y0, x.ravel() + x0, v.reshape(-1, page["channels"])


def three_channels(v: np.ndarray) -> list[np.ndarray]:
    """The first three channels; pages with one or two repeat the first."""
    return [v[:, k if v.shape[1] > 2 else 0].astype(np.int32) for k in range(3)]


def _found(path: str) -> list[str]:
    path = path.removeprefix("file://")
    files = sorted(glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path))
    if not files:
        raise FileNotFoundError(path)
    return [f for f in files if not os.path.basename(f).startswith(("_", "."))]


def _stem(path: str) -> str:
    """As ``files.stem``, and without .nii before .gz."""
    return os.path.basename(path).removesuffix(".gz").rsplit(".", 1)[0]


def _reader(f) -> Read:
    def read(at: int, size: int) -> bytes:
        f.seek(at)
        data = f.read(size)
        if len(data) < size:
            raise ValueError("a file ends early")
        return data

    return read


class _Part(InputPartition):
    def __init__(self, path: str, what: dict, at: int):
        self.path, self.what, self.at = path, what, at


class _TiffReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.slab = options["path"], int(options.get("slab", SLAB))

    def partitions(self):
        parts = []
        for path in _found(self.paths):
            with open(path, "rb") as f:
                for z, page in enumerate(tiff_pages(_reader(f))):
                    run, size = [], 0
                    for c in page["chunks"]:
                        own = c[4] * c[5] * page["channels"]
                        if run and size + own > self.slab:
                            parts.append(_Part(path, page | {"chunks": run}, z))
                            run, size = [], 0
                        run.append(c)
                        size += own
                    if run:
                        parts.append(_Part(path, page | {"chunks": run}, z))
        return parts

    def read(self, partition):
        name = _stem(partition.path)
        with open(partition.path, "rb") as f:
            read = _reader(f)
            for c in partition.what["chunks"]:
                y, x, v = chunk_pixels(partition.what, c, read(c[0], c[1]))
                for a in range(0, len(y), ROWS):
                    s = slice(a, a + ROWS)
                    n = len(y[s])
                    cols = [pa.array([name] * n, pa.string()), *[pa.array(np.asarray(k, np.int32)) for k in (np.full(n, partition.at), y[s], x[s], *three_channels(v[s]))]]
                    yield pa.RecordBatch.from_arrays(cols, ["img", "z", "y", "x", "c1", "c2", "c3"])


class TiffPages(DataSource):
    """Pixels (img, z, y, x, c1, c2, c3) of TIFF files, a page a slice z; option ``slab``: decoded bytes a partition."""

    @classmethod
    def name(cls):
        return "tiff_pages"

    def schema(self):
        return "img string, z int, y int, x int, c1 int, c2 int, c3 int"

    def reader(self, schema):
        return _TiffReader(self.options)


#: Numbers of NIfTI's data types: fixed values of the format.
NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def nifti_header(head: bytes) -> dict:
    """width, height, depth, kind (of numpy), at (where values begin), slope and shift of a NIfTI-1 volume in one file."""
    order = next((o for o in "<>" if struct.unpack(o + "i", head[:4])[0] == 348), None)
    if order is None or head[344:347] != b"n+1":
        raise ValueError("not a NIfTI-1 file with its values")
    dims = struct.unpack(order + "8h", head[40:56])
    code = struct.unpack(order + "h", head[70:72])[0]
    if dims[0] < 2 or any(d > 1 for d in dims[4 : dims[0] + 1]) or code not in NIFTI:
        raise ValueError(f"a NIfTI file of dimensions {dims} and type {code} can't be read")
    offset, slope, shift = struct.unpack(order + "3f", head[108:120])
    scaled = slope != 0 and np.isfinite(slope) and np.isfinite(shift)
    return {"width": dims[1], "height": dims[2], "depth": dims[3] if dims[0] > 2 else 1, "kind": order + NIFTI[code], "at": int(offset), "slope": slope if scaled else 1.0, "shift": shift if scaled else 0.0}


class _NiftiReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.slab = options["path"], int(options.get("slab", SLAB))

    def partitions(self):
        parts = []
        for path in _found(self.paths):
            packed = path.endswith(".gz")
            with gzip.open(path) if packed else open(path, "rb") as f:
                h = nifti_header(f.read(348))
            step = h["depth"] if packed else max(1, self.slab // (h["width"] * h["height"] * np.dtype(h["kind"]).itemsize))
            parts += [_Part(path, h | {"slices": min(step, h["depth"] - z)}, z) for z in range(0, h["depth"], step)]
        return parts

    def read(self, partition):
        h, name = partition.what, _stem(partition.path)
        kind = np.dtype(h["kind"])
        plane = h["width"] * h["height"]
        y, x = (a.ravel().astype(np.int32) for a in np.indices((h["height"], h["width"])))
        with gzip.open(partition.path) if partition.path.endswith(".gz") else open(partition.path, "rb") as f:
            read = _reader(f)
            for z in range(partition.at, partition.at + h["slices"]):
                v = np.frombuffer(read(h["at"] + z * plane * kind.itemsize, plane * kind.itemsize), kind).astype(float) * h["slope"] + h["shift"]
                for a in range(0, plane, ROWS):
                    s = slice(a, a + ROWS)
                    n = len(y[s])
                    cols = [pa.array([name] * n, pa.string()), pa.array(np.full(n, z, np.int32)), pa.array(y[s]), pa.array(x[s]), pa.array(v[s])]
                    yield pa.RecordBatch.from_arrays(cols, ["img", "z", "y", "x", "c1"])


class NiftiVolumes(DataSource):
    """Voxels (img, z, y, x, c1) of NIfTI-1 files, scaled as their headers say; the first axis of the file is x. A file packed by gzip is one partition, others are
    cut into slabs of slices; option ``slab``: bytes a partition."""

    @classmethod
    def name(cls):
        return "nifti_volumes"

    def schema(self):
        return "img string, z int, y int, x int, c1 double"

    def reader(self, schema):
        return _NiftiReader(self.options)


def tiff(spark: SparkSession, path: str, slab: int = SLAB) -> DataFrame:
    """Pixels of the TIFF files at a path, folder or pattern; not compressed, LZW, deflate or PackBits, in strips or tiles, 8 or 16 bits. Other pages are an error."""
    spark.dataSource.register(TiffPages)
    return spark.read.format("tiff_pages").option("path", path).option("slab", slab).load()


def nifti(spark: SparkSession, path: str, slab: int = SLAB) -> DataFrame:
    """Voxels of the NIfTI files (.nii, .nii.gz) at a path, folder or pattern."""
    spark.dataSource.register(NiftiVolumes)
    return spark.read.format("nifti_volumes").option("path", path).option("slab", slab).load()
