"""Token counts as delta-maintained rollups.

A batch holds events: ``insert`` and ``revise`` give a document's count under a tokenizer version, ``delete`` withdraws it. Against the
ledger (the last state of each document and version), events become signed deltas, and these add up by source, language and
version. A commit writes ledger rows and deltas of a batch to a folder of its own and then its mark; a batch that
has its mark is skipped, one without is written over, so that a repeated or broken commit counts once. Totals are sums of the committed deltas.
``compact`` folds the batches so far into one, so that a commit reads one state and what came after it. One writer at a time commits to a rollup.

A tokenizer version is a pattern, whose matches are counted, or a tokenizer's file, which encodes whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm.common import lean, materialize, text_batches

KEY = ["source", "lang", "version"]
EVENTS = "doc_id long, version string, source string, lang string, n_tokens long, op string, seq long"
LEDGER = "doc_id long, version string, source string, lang string, n_tokens long, live boolean"
DELTAS = "source string, lang string, version string, docs long, tokens long"
#: What each version counts: words between white space; words and marks; characters.
VERSIONS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "marks-2": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]",
}


class Rollup:
    """A rollup below ``path``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _done(self) -> tuple[int | None, list[int]]:
        """The last compacted batch, if any, and the committed batches after it, in order."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return None, []
        found = {"batch": [], "upto": []}
        for s in fs.listStatus(root):
            kind, _, number = s.getPath().getName().partition("=")
            if kind in found and fs.exists(hadoop.Path(f"{self.path}/{kind}={number}/deltas/_SUCCESS")):
                found[kind].append(int(number))
        upto = max(found["upto"], default=None)
        return upto, sorted(b for b in found["batch"] if upto is None or b > upto)

    def committed(self) -> list[int]:
        """Numbers of the committed batches that aren't compacted, in order; after ``compact`` the last compacted one stands for those before."""
        upto, after = self._done()
        return ([] if upto is None else [upto]) + after

    def _read(self, what: str, schema: str) -> DataFrame:
        upto, after = self._done()
        folders = ([] if upto is None else [(upto, f"upto={upto}")]) + [(b, f"batch={b}") for b in after]
        out = self.spark.createDataFrame([], schema + ", batch long")
        for b, folder in folders:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/{what}").withColumn("batch", F.lit(b).cast("long")))
        return out

    def compact(self) -> None:
        """Write the state and totals of all committed batches as one; their own folders are no longer read."""
        upto, after = self._done()
        if after:
            where = f"{self.path}/upto={after[-1]}"
            self.ledger().write.mode("overwrite").parquet(f"{where}/ledger")
            sums = self._read("deltas", DELTAS).groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            sums.coalesce(1).write.mode("overwrite").parquet(f"{where}/deltas")

    def ledger(self) -> DataFrame:
        """The last state of each (doc_id, version)."""
        last = F.max_by(F.struct("source", "lang", "n_tokens", "live"), "batch").alias("s")
        return self._read("ledger", LEDGER).groupBy("doc_id", "version").agg(last).select("doc_id", "version", "s.*")

    def commit(self, batch: int, events: DataFrame) -> bool:
        """Commit ``events(doc_id, version, source, lang, n_tokens, op, seq)``; False if the batch is committed already.

        Of a document's events under one version the one with the largest seq (then the largest op, n_tokens) counts. Inserting what
        is there revises it; deleting or revising what isn't there does nothing, or inserts it. Events without doc_id or version
        are ignored, a null count is 0; null sources and languages are keys of their own. Batches are committed in order.
        """
        upto, after = self._done()
        done = self.committed()
        if batch in after or upto is not None and batch <= upto:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after {done[-1]}")
        where = f"{self.path}/batch={batch}"
        e = events.where("doc_id is not null and version is not null and op in ('insert', 'delete', 'revise')")
        last = F.max_by(F.struct("source", "lang", "n_tokens", "op"), F.struct("seq", "op", "n_tokens", "source", "lang")).alias("s")
        e = e.groupBy("doc_id", "version").agg(last).select("doc_id", "version", "s.source", "s.lang", F.coalesce("s.n_tokens", F.lit(0)).cast("long").alias("n_tokens"), (F.col("s.op") != "delete").alias("live"))
        e.write.mode("overwrite").parquet(f"{where}/ledger")
        new = self.spark.read.schema(LEDGER).parquet(f"{where}/ledger")
        plus = new.where("live").select(*KEY, F.lit(1).alias("docs"), F.col("n_tokens").alias("tokens"))
        if done:
            old = self.ledger().where("live").join(new.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
            plus = plus.union(old.select(*KEY, F.lit(-1), -F.col("n_tokens")))
        deltas = plus.groupBy(*KEY).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
        deltas.where("docs <> 0 or tokens <> 0").coalesce(1).write.mode("overwrite").parquet(f"{where}/deltas")
        return True

    def totals(self) -> DataFrame:
        """Rows (source, lang, version, n_docs, n_tokens), of keys that still have documents."""
        sums = self._read("deltas", DELTAS).groupBy(*KEY).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0")


def count_events(docs: DataFrame, op: str, seq: int = 0, versions: dict[str, str] = VERSIONS, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """Events of ``docs(doc_id, text, source, lang)`` for each pattern of ``versions`` and each tokenizer's file of ``tokenizers``.

    A null text has 0 tokens; other columns are not read. Repeated rows of a doc_id give one event each, of which a commit takes one. An
    empty table gives no event.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    kind = "array<struct<version:string,n:long>>"
    counts = F.array(*[F.struct(F.lit(v).alias("version"), F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long").alias("n")) for v, p in versions.items()]).cast(kind)
    if tokenizers:
        with text_batches(docs.sparkSession):
            encoded = rows.select("doc_id", "source", "lang", counts.alias("by_pattern"), F.col("text").cast("binary").alias("text"))
            rows = materialize(encoded.mapInArrow(lean(_encoded(tokenizers)), f"doc_id long, source string, lang string, by_pattern {kind}, by_file {kind}"), "counted")
        counts = F.concat("by_pattern", "by_file")
    rows = rows.select("doc_id", "source", "lang", F.explode(counts).alias("c"))
    return rows.select("doc_id", "c.version", "source", "lang", F.col("c.n").alias("n_tokens"), F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"))


def _encoded(tokenizers: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        known = {v: Tokenizer.from_file(p) for v, p in tokenizers.items()}
        kind = pa.list_(pa.struct([("version", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            texts = [(t.as_py() or b"").decode("utf-8", "replace") for t in batch.column("text")]
            counts = {v: [len(t.encode(x, add_special_tokens=False).ids) for x in texts] for v, t in known.items()}
            made = [[{"version": v, "n": counts[v][k]} for v in counts] for k in range(len(texts))]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "source", "lang", "by_pattern")), pa.array(made, kind)], names=["doc_id", "source", "lang", "by_pattern", "by_file"])

    return run
