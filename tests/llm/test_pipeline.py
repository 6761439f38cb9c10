import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert dict(out.dtypes) == dict(first.dtypes)
            docs = out.select(first.columns)
        seen.append(out.count())
        assert out.select("doc_id").distinct().count() == seen[-1]
    assert seen == sorted(seen, reverse=True)
    assert sorted(out.columns) == ["doc_id", "ids_crc32", "n_tokens", "start"]
    assert corpus_pipeline.run(spark, SF).count() == seen[-1]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SAME = "same text here of six words"
ODD = [(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, SAME, "en", "s", 27), (2, SAME, "en", "s", 27), (3, SAME, "en", None, 27), (4, "", "en", "s", 0), (5, "w " * 40_000, "en", "t", 80_000)]


def odd(spark):
    """The odd rows, with columns whose names the stages might use themselves."""
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "doc_id * 2 AS _id", "text AS h", "source AS row", "lang AS mixed")


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


def test_odd_documents_in_each_stage(spark):
    docs = odd(spark)
    quality, near, clean, mix, tokens = (f for _, f in corpus_pipeline.STAGES)
    kept = quality(spark, docs, SF)
    assert kept.columns == docs.columns and set(ids(kept)) <= set(ids(docs)) and ids(kept).count(2) in (0, 2) and None in ids(kept)
    once = near(spark, docs, SF)
    assert once.columns == docs.columns and ids(once) == [1, 2, 4, 5, None]
    assert {r["h"] for r in once.where("doc_id = 2").collect()} == {SAME}
    left = clean(spark, docs, SF)
    assert left.columns == docs.columns and ids(left) == ids(docs)
    mixed = mix(spark, docs, SF)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= {None, 2, 3, 5} and ids(mixed).count(2) <= 1
    assert all(r["n_chars"] == len(r["text"]) and r["text"].split() for r in mixed.collect())
    written = tokens(spark, docs, SF).collect()
    assert len(written) == len(ODD) and sorted(r["start"] for r in written)[0] == 0 and {r["n_tokens"] for r in written if r["doc_id"] in (1, 4)} == {1}


def test_empty_table_in_each_stage(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd(spark).limit(0), SF).count() == 0


@pytest.fixture(autouse=True, scope="module")
def needs_tokenizers():
    pytest.importorskip("public_tokenizers")
