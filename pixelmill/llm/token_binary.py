"""Token files: one array of ids a shard, with Elias-Fano coded document boundaries.

A shard holds the concatenated ids (2 bytes each if the vocabulary allows, else 4), then two Elias-Fano sequences (document
ends and document ids, both ascending), then a JSON footer, its length and a mark. An ascending sequence of n values below u
takes about n * (2 + log2(u / n)) bits: the low bits packed, the high bits as a unary bit vector; the place of every
256th one is kept in 32 bits, so that ``select`` scans a few bytes and no table of 64-bit offsets exists.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from string import ascii_letters
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import lean, materialize, shared_path, text_batches

MARK = b"PMTOK001"
EVERY = 256
#: Ids after which a shard is closed, and ids read from a shard at once.
SHARD_IDS, READ_IDS = 16_000_000, 2_000_000
#: The byte-level alphabet: printable bytes stand for themselves, others for the characters from 256 on.
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINT)}
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


class EliasFano:
    """An ascending sequence of non-negative integers (repeats allowed)."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.empty(0, np.uint8), np.empty(0, np.uint8), np.empty(0, np.uint32))
        width = max(0, ((int(v[-1]) + 1) // n).bit_length() - 1)
        low = np.empty((n, width), np.uint8)
        for b in range(width):
            low[:, b] = (v >> np.uint64(b)) & np.uint64(1)
        places = ((v >> np.uint64(width)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        return cls(n, width, np.packbits(low.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), places[::EVERY].astype(np.uint32))

    def _low(self, i: int) -> int:
        at, w = i * self.low_bits, self.low_bits
        chunk = int.from_bytes(self.low[at // 8 : (at + w + 7) // 8].tobytes(), "little")
        return (chunk >> (at % 8)) & ((1 << w) - 1)

    def select(self, i: int) -> int:
        """Value number i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // EVERY])
        left, byte = i % EVERY, place // 8
        current = int(self.high[byte]) & (0xFF << (place % 8))
        while left >= (ones := int(_ONES[current])):
            left -= ones
            byte += 1
            current = int(self.high[byte])
        for _ in range(left):
            current &= current - 1
        place = byte * 8 + (current & -current).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def values(self) -> np.ndarray:
        """All values."""
        if not self.n:
            return np.empty(0, np.int64)
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (places - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            low = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            for b in range(self.low_bits):
                out |= low[:, b].astype(np.int64) << b
        return out

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u4")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, w, a, b = map(int, np.frombuffer(data, "<u4", 4))
        raw = np.frombuffer(data, np.uint8)
        return cls(n, w, raw[16 : 16 + a], raw[16 + a : 16 + a + b], raw[16 + a + b :].view("<u4") if (16 + a + b) % 4 == 0 else np.frombuffer(raw[16 + a + b :].tobytes(), "<u4"))


@lru_cache(maxsize=4)
def _encoder(path: str, wide: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return _Encoder(Tokenizer.from_file(path), wide)


#: Texts that show whether a tokenizer splits at white space: what it makes of their pieces is what it makes of them.
_PROBES = ("the cat sat", " two  spaces\n\nand lines\t.", "It's 3.5 km, isn't it?  (No.)", "élan größe łódź слово 日本 語", "don't  \r\n stop\x0b\x0cnow ")


class _Encoder(dict):
    """Ids (as bytes) of the pieces between ASCII white space.

    Exact for tokenizers that split at white space before anything else, whose pieces can then be encoded one by one; whole texts go to
    others, as ``_PROBES`` tell, and one text in ``CHECK`` is encoded both ways, which is an error if they differ. Most pieces
    recur, and are looked up, in lower case if the tokenizer doesn't tell A-Z from a-z (special tokens, which it may tell, begin
    with "<|"). A worker keeps its pieces from task to task; they are dropped at ``LIMIT`` pieces, about 50 MB. New words go to the
    tokenizer's model directly, if this gives the same ids for words of several scripts.
    """

    LIMIT, CHECK = 200_000, 512

    def __init__(self, tokenizer, wide: bool):
        super().__init__()
        self.tokenizer, self.kind, self.code, self.seen = tokenizer, "<u4" if wide else "<u2", "I" if wide else "H", 0
        one = [tokenizer.encode(x, add_special_tokens=False).ids for x in (ascii_letters.upper(), ascii_letters.lower())]
        self.fold = one[0] == one[1]
        self.tails: dict[bytes, bytes] = {b"": b""}
        self.word = tokenizer.model.tokenize
        self.direct = self.fold and all(self._word(w) == self._whole(w) for w in ("a", "zebra", "xqzzy", "élan", "ñandú", "größe", "łódź", "слово", "日本"))
        self.pieces = all(self._pieces(t.encode()) == self._whole(t) for t in _PROBES)

    def _whole(self, piece: str) -> bytes:
        return array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _word(self, letters: str) -> bytes:
        """A word of lower-case letters by the tokenizer's model alone, which takes UTF-8 bytes as the characters of byte-level BPE."""
        return array(self.code, [t.id for t in self.word(letters.encode().decode("latin-1").translate(_BYTES))]).tobytes()

    def __missing__(self, piece: bytes) -> bytes:
        """A lower-case word with full stops and commas behind it, or any other piece."""
        core = piece.rstrip(b".,")
        text = piece.decode("utf-8", "replace")
        letters = text[: len(text) - len(piece) + len(core)]
        if self.direct and letters.isalpha() and letters == letters.lower() and (letters.isascii() or is_normalized("NFC", letters)):
            tail = piece[len(core) :]
            if tail not in self.tails:
                if len(self.tails) > 1000:
                    self.tails.clear()
                self.tails[tail] = self._whole(tail.decode()) if tail else b""
            ids = self._word(letters) + self.tails[tail]
        else:
            ids = self._whole(text)
        if len(self) >= self.LIMIT:
            self.clear()
        self[piece] = ids
        return ids

    def _pieces(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, (text.lower() if self.fold and b"<|" not in text else text).split()))

    def encode(self, text: bytes, end: bytes) -> bytes:
        """Ids of a text, and the end id."""
        if not self.pieces:
            return self._whole(text.decode("utf-8", "replace")) + end
        ids = self._pieces(text)
        self.seen += 1
        if self.seen % self.CHECK == 1 and len(text) < 1 << 20 and ids != self._whole(text.decode("utf-8", "replace")):
            raise ValueError("the tokenizer doesn't encode a text as its pieces between white space")
        return ids + end


def _write(path: str, tokenizer: str, end_id: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        encoder = _encoder(tokenizer, wide)
        size = 4 if wide else 2
        end = np.array([end_id], encoder.kind).tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        out, name, counts, ids, written = None, "", [], [], 0

        def close():
            ends = EliasFano.encode(np.cumsum(counts)).to_bytes()
            known = np.array([i for i in ids if i is not None], np.int64)
            base = int(known[0]) if len(known) else 0
            names = EliasFano.encode((known - base).view(np.uint64)).to_bytes()
            total = sum(counts)
            foot = json.dumps({"docs": len(ids), "no_id": len(ids) - len(known), "base": base, "ids": total, "width": size, "ends": len(ends), "names": len(names)}).encode()
            out.write(ends + names + foot + len(foot).to_bytes(4, "little") + MARK)
            out.close()
            return pa.record_batch([pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (name, pa.string()), (total, pa.int64()))], names=["part", "seq", "file", "ids"])

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for key, text in zip(keys, batch.column("text"), strict=True):
                data = encoder.encode(text.as_py() or b"", end)
                if out is None:
                    fs.create_dir(folder, recursive=True)
                    name = f"{folder}/part-{part:05d}-{seq:04d}-{uuid.uuid4().hex}.tok"
                    out, counts, ids, written = fs.open_output_stream(name), [], [], 0
                out.write(data)
                counts.append(len(data) // size)
                written += counts[-1]
                ids.append(key)
                if written >= SHARD_IDS:
                    yield close()
                    out, seq = None, seq + 1
        if out is not None:
            yield close()

    return run


class Shard:
    """A token file, opened for reading by range."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.f = fs.open_input_file(path)
        size = self.f.size()
        tail = self.f.read_at(min(size, 4096), max(0, size - 4096))
        if tail[-8:] != MARK:
            raise ValueError(f"{path} is no token file")
        n = int.from_bytes(tail[-12:-8], "little")
        self.foot = json.loads(tail[-12 - n : -12])
        at = size - 12 - n - self.foot["names"]
        self.names = EliasFano.from_bytes(self.f.read_at(self.foot["names"], at))
        self.ends = EliasFano.from_bytes(self.f.read_at(self.foot["ends"], at - self.foot["ends"]))

    def doc_ids(self) -> list[int | None]:
        return [None] * self.foot["no_id"] + (self.names.values() + self.foot["base"]).tolist()

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids number first up to last, exclusive."""
        w = self.foot["width"]
        return np.frombuffer(self.f.read_at((last - first) * w, first * w), f"<u{w}")

    def document(self, i: int) -> np.ndarray:
        """Ids of document number i of the shard."""
        return self.ids(self.ends.select(i - 1) if i else 0, self.ends.select(i))


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(fs, path)
                ends, keys = shard.ends.values(), shard.doc_ids()
                a = 0
                while a < len(ends):
                    start = int(ends[a - 1]) if a else 0
                    b = max(a + 1, int(np.searchsorted(ends, start + READ_IDS, side="right")))
                    ids = shard.ids(start, int(ends[b - 1])).astype("<u4")
                    cut = np.r_[0, ends[a:b] - start]
                    crc = [zlib.crc32(ids[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in (keys[a:b], base + start + cut[:-1], np.diff(cut), crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    a = b

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str, wide: bool = False, partitions: int | None = None) -> DataFrame:
    """Write ``docs(doc_id, text)`` below ``path`` in ascending doc_id order; returns the table of shards (part, seq, file, ids).

    A null text counts as empty, so each document has its end id at least. Rows without doc_id come first; rows with the
    same doc_id are ordered by text. Other columns are not read. An empty table gives no shard. Each attempt of a task writes
    files of its own names, and the table of shards names those of the attempts that Spark committed; what others left behind is not read.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    with text_batches(spark):
        return materialize(rows.mapInArrow(lean(_write(path, tokenizer, end_id, wide)), "part int, seq int, file string, ids long"), "shards")


def read_token_files(shards: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the files; start counts the ids of all documents before.

    The driver adds up one number a shard; documents and ids stay on the executors.
    """
    spark, base, rows = shards.sparkSession, 0, []
    for r in shards.orderBy("part", "seq").collect():
        rows.append((r["file"], base))
        base += r["ids"]
    table = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))
    return table.mapInArrow(lean(_read(path)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write token files below the shared folder and read them back."""
    path = shared_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer, end_id, path), path)
