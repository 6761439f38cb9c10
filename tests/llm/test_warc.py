import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from pixelmill.llm import warc


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).selectExpr("*", "page_id AS keep", "url AS digest")
    return sorted((tuple(r)[:5] for r in warc.archives_round_trip(df).collect()), key=str)


def brute(rows):
    out = []
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    for i, _, h in rows:
        b = (h or "").encode()
        ref = best.get(h or "") if i is not None and len(b) >= 1000 and i < best[h or ""] else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    big, exact = "é<p>\r\n\r\nx" * 200, "a" * 1000
    rows = [(k, f"http://h/{k}", big if k % 3 else f"own {k}") for k in range(40)] + [(50, None, None), (51, "", ""), (52, "u\r\nX: y z", exact), (53, "u", exact), (54, "u", "a" * 999), (55, "u", "a" * 999), (None, "u", exact), (60, "u", exact), (60, "u", exact), (61, "long", "z" * 3_000_000)]
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 500)
    monkeypatch.setattr(warc, "READ_BYTES", 300)
    monkeypatch.setattr(warc, "MAX_BROADCAST", 0)
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("wide", [False, True])
def test_directory(monkeypatch, wide):
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"stored bytes, more than ten")
        z.writestr("b", b"x" * 500, zipfile.ZIP_DEFLATED)
        z.writestr("c/d", b"last")
        z.comment = b"PK\x05\x06 in a comment"
    assert (b"PK\x06\x06" in out.getvalue()) == wide
    f = Bytes(out.getvalue())
    found = warc.directory(f)
    assert list(found) == ["a", "b", "c/d"]
    at = warc.data_start(f, found["a"])
    assert f.read_at(found["a"].size, at) == b"stored bytes, more than ten"
    assert f.read_at(4, warc.data_start(f, found["c/d"])) == b"last"
    with pytest.raises(ValueError):
        warc.data_start(f, found["b"])
    with pytest.raises(ValueError):
        warc.directory(Bytes(out.getvalue()[:-40]))
