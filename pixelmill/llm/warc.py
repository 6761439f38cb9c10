"""ZIP-packaged WARC archives: written from pages, and read by range without unpacking.

An archive is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` (one gzip member a record) and
``indexes/index.cdx`` (a line a record with its place). The reader parses the end record, with its ZIP64 form, and the central
directory, finds where the stored members begin, and then reads any record by its offset and length.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import lean, materialize, shared_path, text_batches

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Bytes of records after which an archive is closed, and bytes read at once.
ARCHIVE_BYTES, READ_BYTES = 32_000_000, 4_000_000
#: Repeated payloads are broadcast up to so many digests, else joined by shuffle with salt.
MAX_BROADCAST, SALT = 200_000, 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


def directory(f) -> dict[str, Member]:
    """The members of a ZIP file (seekable, with ``size`` and ``read_at``), from its central directory."""
    size = f.size()
    span = min(size, 65_557)
    tail = f.read_at(span, size - span)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (len(tail) - at < 22 or struct.unpack_from("<H", tail, at + 20)[0] != len(tail) - at - 22):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file, or cut off")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (where,) = struct.unpack_from("<Q", tail, at - 12)
        end = f.read_at(56, where)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("ZIP64 end record not found")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    elif 0xFFFFFFFF in (length, start) or count == 0xFFFF:
        raise ValueError("ZIP64 locator not found")
    raw, found, p = f.read_at(length, start), {}, 0
    for _ in range(count):
        if raw[p : p + 4] != b"PK\x01\x02":
            raise ValueError("central directory is damaged")
        method, = struct.unpack_from("<H", raw, p + 10)
        packed, full, n, extra, comment = struct.unpack_from("<IIHHH", raw, p + 20)
        header, = struct.unpack_from("<I", raw, p + 42)
        name = raw[p + 46 : p + 46 + n].decode("utf-8", "replace")
        q, last = p + 46 + n, p + 46 + n + extra
        while q + 4 <= last:
            kind, k = struct.unpack_from("<HH", raw, q)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{k // 8}Q", raw, q + 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            q += 4 + k
        found[name] = Member(name, method, packed, header)
        p = last + comment
    return found


def data_start(f, member: Member) -> int:
    """Where a stored member's bytes begin; its local header has lengths of its own."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; records can only be read by range from a stored member")
    head = f.read_at(30, member.header)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("local header not found")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def _line(text: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record, a response or (with ``refers_to``) a revisit, which has the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"] if refers_to is not None else []
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower-case names), HTTP header and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        part, seq, data, index = TaskContext.get().partitionId(), 0, io.BytesIO(), []

        def close():
            fs.create_dir(folder, recursive=True)
            final = f"{folder}/part-{part:05d}-{seq:04d}-{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(final) as out:
                packed = io.BytesIO()
                with zipfile.ZipFile(packed, "w", zipfile.ZIP_STORED) as z:
                    z.writestr(zipfile.ZipInfo(DATA), data.getbuffer())
                    z.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
                    z.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
                out.write(packed.getbuffer())
            return pa.record_batch([pa.array([final]), pa.array([len(index)], pa.int64())], names=["file", "records"])

        for batch in batches:
            ids, urls, digests, refs = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to"))
            for k, payload in enumerate(batch.column("payload")):
                packed = _gzip(record(ids[k], urls[k], payload.as_py(), digests[k], refs[k]))
                index.append(f'{_line(urls[k] or "-")} 20240101000000 {json.dumps({"digest": "sha1:" + digests[k], "offset": data.tell(), "length": len(packed), "filename": DATA})}')
                data.write(packed)
                if data.tell() >= ARCHIVE_BYTES:
                    yield close()
                    seq, data, index = seq + 1, io.BytesIO(), []
        if index:
            yield close()

    return run


def _index(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch.column("file").to_pylist():
                with fs.open_input_file(path) as f:
                    members = directory(f)
                    base = data_start(f, members[DATA])
                    text = f.read_at(members[INDEX].size, data_start(f, members[INDEX])).decode()
                rows = [json.loads(x.split(" ", 2)[2]) for x in text.split("\n") if x]
                yield pa.record_batch([pa.array([path] * len(rows), pa.string()), pa.array([base + r["offset"] for r in rows], pa.int64()), pa.array([r["length"] for r in rows], pa.int64())], names=["file", "at", "length"])

    return run


def _fetch(root: str):
    def page(text: str) -> int | None:
        return int(text) if (text := text.removeprefix("<urn:page:").removesuffix(">")) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(root)
        f, name = None, None
        for batch in batches:
            files, ats, lengths = (batch.column(c).to_pylist() for c in ("file", "at", "length"))
            out: list[tuple] = []
            k = 0
            while k < len(files):
                j, last = k, ats[k]
                while j < len(files) and files[j] == files[k] and ats[j] == last and last - ats[k] < READ_BYTES:  # neighbours are read at once
                    last, j = last + lengths[j], j + 1
                if files[k] != name:
                    if f:
                        f.close()
                    f, name = fs.open_input_file(files[k]), files[k]
                data = memoryview(f.read_at(last - ats[k], ats[k]))
                for i in range(k, j):
                    raw = zlib.decompress(data[ats[i] - ats[k] :][: lengths[i]], 31)
                    fields, http, payload = parse(raw)
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    size = len(payload)
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} doesn't have its digest")
                    if kind == "revisit":
                        size = int(http.lower().rpartition(b"content-length:")[2].split()[0])
                    refers = page(fields["warc-refers-to"]) if kind == "revisit" else None
                    out.append((page(fields["warc-record-id"]), size, digest, kind, refers, fields.get("warc-target-uri")))
                k = j
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
        if f:
            f.close()

    return run


def write_archives(pages: DataFrame, path: str, min_revisit: int = 1000) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)``; returns the archives (file, records).

    Of equal payloads of ``min_revisit`` bytes or more, the one with the largest page_id is a response (each of them, if it occurs
    twice), and others revisit it. Smaller ones are responses, as are rows without page_id. A null html is an empty payload, a null url
    leaves out the field. Other columns are not read; an empty table gives no archive. Each attempt of a task writes archives of its own names, and the
    table names those of the attempts that Spark committed; what others left behind is not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where((F.length("payload") >= min_revisit) & F.col("page_id").isNotNull())
    repeated = materialize(large.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("digest", "keep"), "repeated")
    if repeated.count() <= MAX_BROADCAST:
        joined = rows.join(F.broadcast(repeated), "digest", "left")
    else:
        salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")).join(salted, ["digest", "salt"], "left")
    refers = F.when((F.length("payload") >= min_revisit) & (F.col("page_id") < F.col("keep")), F.col("keep"))
    joined = joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    with text_batches(pages.sparkSession):
        return materialize(joined.mapInArrow(lean(_write(path)), "file string, records long"), "archives")


def read_archives(archives: DataFrame, path: str) -> DataFrame:
    """One row a record (page_id, payload_bytes, payload_digest, record_type, refers_to, url) from the table of archives.

    Bytes and digest are those of the full payload, of revisits as their headers state; a response whose payload doesn't have its digest is an error.
    """
    spark = archives.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = archives.select("file").repartition(n).mapInArrow(lean(_index(path)), "file string, at long, length long")
    spread = index.repartition(n, "file", F.floor(F.col("at") / READ_BYTES)).sortWithinPartitions("file", "at")
    return spread.mapInArrow(lean(_fetch(path)), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archives_round_trip(pages: DataFrame) -> DataFrame:
    """Write archives below the shared folder and read them back."""
    path = shared_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, path), path)
