"""A training corpus from documents: quality, near duplicates, benchmark passages, mix, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm.common import materialize
from pixelmill.llm.decontam import contaminated
from pixelmill.llm.mixing import mix_documents
from pixelmill.llm.ngram_join import similar_documents
from pixelmill.llm.quality import select_documents
from pixelmill.llm.token_binary import tokens_round_trip


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, with all their columns.

    Rows without doc_id stay, since no decision names them; repeated rows share their fate; a null or empty text is weighed as one
    without n-grams. Without labels of both kinds all stay, but for toxic ones. An empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    gone = materialize(select_documents(docs, labels).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct(), "rejected")
    return _without(docs, gone)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest doc_id, with all its columns; of rows with one doc_id, one.

    Null, empty and wordless texts are similar to nothing and stay, as do rows without doc_id. Of repeated rows the one with the least hash stays.
    """
    found = materialize(similar_documents(docs), "similar")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct()
    kept = _without(docs, materialize(gone, "copies"))
    repeated = materialize(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id")), "repeated")
    if repeated.isEmpty():
        return kept
    row = F.struct(*[F.col(c) for c in docs.columns])
    once = kept.join(repeated, kept["doc_id"] == repeated["_id"], "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(row)).alias("row"))
    return _without(kept, repeated).unionByName(once.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, with all their columns.

    Rows without doc_id stay, repeated rows share their fate, null and empty texts hold no passage. Without items all stay.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, materialize(contaminated(docs, benchmark).select(F.col("doc_id").alias("_id")).distinct(), "leaks"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with, as text, what the mix takes of each, and n_chars of it; other columns as they are.

    Documents of which nothing is taken go, as do null, empty and wordless ones; a null source is a source. Repeated rows become one.
    """
    return mix_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token files, read back: doc_id, start, n_tokens, ids_crc32.

    A null text counts as empty; rows without doc_id come first, with one another, and repeated rows are documents of their own.
    """
    import public_tokenizers

    return tokens_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


def _without(docs: DataFrame, gone: DataFrame, small: int = 500_000) -> DataFrame:
    """The documents whose ids aren't in ``gone``, which is broadcast while it is small."""
    gone = F.broadcast(gone) if gone.count() <= small else gone
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_files),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", ""))
    return docs
