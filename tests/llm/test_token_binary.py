import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelmill.llm import token_binary
from pixelmill.llm.token_binary import EliasFano, tokens_round_trip

P = pytest.importorskip("public_tokenizers")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano(values):
    v = np.sort(np.asarray(values, np.uint64))
    e = EliasFano.from_bytes(EliasFano.encode(v).to_bytes())
    assert e.values().tolist() == v.tolist()
    assert [e.select(i) for i in range(len(v))] == v.tolist()


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(1).integers(1, 1000, 10_000))
    assert len(EliasFano.encode(v).to_bytes()) < 10_000 * (2 + 9.2) / 8 + 10_000 / 256 * 4 + 100


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "doc_id AS start")
    return sorted(map(tuple, tokens_round_trip(df, P.path("word_bpe_49k.json"), 2).collect()), key=lambda r: r[1])


def brute(rows):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_like_whole_texts(spark, monkeypatch):
    odd = ["Don't  STOP now x", "a\x1cb\x85c\x0bd\x0ce", "<|endoftext|> <|startoftext|>x", "é ́a ẛ̣ İI ΑΣ ΑΣΒ", "​", "日本語 テキスト 12½", "x" * 5000, "👍🏽 ok\r\n\tend", "ñandú größe. élan, łódź., слово.. ǅungla ŉ ﬁn e\u0301t ÉTÉ. a.,b don't. x's, 're. ...,", "ªb ºc ʰd ſ K Å ẞ"]
    rows = [(5, None), (3, ""), (None, "no id"), (-4, "minus"), (7, "same"), (7, "same"), (7, "a first"), (9, "word " * 40_000), *((100 + k, t) for k, t in enumerate(odd))]
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(token_binary, "SHARD_IDS", 10)
    monkeypatch.setattr(token_binary, "READ_IDS", 7)
    assert run(spark, rows) == brute(rows)


def test_select_one_document(spark, tmp_path):
    from pyarrow import fs

    df = spark.createDataFrame([(k, f"text number {k} " * k) for k in range(50)], "doc_id long, text string")
    shard = token_binary.write_token_files(df, P.path("word_bpe_49k.json"), 2, f"file://{tmp_path}/t", partitions=1).first()
    s = token_binary.Shard(fs.LocalFileSystem(), shard["file"])
    assert s.doc_ids() == list(range(50)) and len(s.document(0)) == 1 and s.document(7)[-1] == 2
    assert sum(len(s.document(k)) for k in range(50)) == shard["ids"]


def test_empty(spark):
    assert run(spark, []) == []
