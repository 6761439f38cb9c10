"""Benchmark decontamination by templates.

Words lose outer punctuation and case; numbers, units after numbers and names (capitalised words inside a sentence)
become typed placeholders. Windows of ``width`` words of the template, and of the plain words, are hashed and joined with
those of the benchmark. Template matches count only where the slots are consistent: over the matching windows at one offset, or over a stretch of them
without a gap that is half of the item or more, each value of the item stands for one value of the document (two of the item may stand for the same), so a question asked again with other
numbers or names is caught, and a chance likeness of form isn't; nor does one chance window elsewhere hide a true stretch.

A third, merged form takes capitalised words that begin a sentence for names, too, and runs of names, and a number with its unit, for one
slot each; its places and offsets are its own. In templates at least ``MIN_PLAIN`` words of a window are plain. An item with
fewer than ``width`` words in a form has one window there, the whole of it; with fewer than ``SHORTEST`` it is matched by documents that consist of its words.
In languages that write nouns with capitals, nouns are names, too, so that fewer windows have enough plain words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.common import lean, materialize, text_batches
from pixelmill.llm.words import windows

WIDTH, SHORTEST, MIN_PLAIN, MIN_RUN, MIN_SHARE = 8, 4, 4, 6, 0.5
#: Hashes of benchmark windows are broadcast up to so many (8 bytes each), else windows are joined by shuffle.
MAX_BROADCAST = 2_000_000
#: Words that are units where a number comes before them (fixed values).
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec ms min h hr hrs hour hours day days week weeks month months year years % percent usd eur dollars euros cents "
    "kb mb gb tb hz khz mhz ghz w kw v a n j pa c f k mph kmh meters metres miles grams kilograms liters litres minutes seconds "
    "tag tage tagen stunde stunden woche wochen monat monate jahr jahre jahren minuten sekunden meter kilometer kilogramm gramm liter prozent "
    "jour jours heure heures semaine semaines mois an ans secondes mètres kilomètres grammes litres día días hora horas semana semanas mes meses año años minutos segundos metros gramos litros".split())

_NUMBER = re.compile(r"[-+$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?")
_JOINED = re.compile(r"([-+$€£]?\d[\d.,:/]*)([^\W\d_]+|%)")
PLAIN, NUMBER, UNIT, NAME, EMPTY, ENDS = 0, 1, 2, 3, 4, 8
#: Forms of windows.
WORDS, TYPED, MERGED, WHOLE = 0, 1, 2, 3
#: Words whose hash stands for a placeholder; the low four bits of a hash hold the kind.
_SLOT = {k: np.uint64(xxhash.xxh3_64_intdigest(f"<{k}>") & ~15) for k in (NUMBER, UNIT, NAME)}


class Canon(dict):
    """Raw word to the hash of its plain form; the low four bits hold its kind and whether it ends a sentence."""

    LIMIT = 100_000

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        plain = raw.rstrip(b".,")
        if plain.isalpha() and plain.islower():  # most words; the same as below, but sooner
            low = plain.decode()
            self[raw] = h = (xxhash.xxh3_64_intdigest(low) & ~15) | (UNIT if low in UNITS else PLAIN) | (ENDS if raw.endswith(b".") else 0)
            return h
        word = unicodedata.normalize("NFKC", raw.decode("utf-8", "replace"))
        ends = ENDS if re.search(r"[.!?:;][\"'”’)\]]*$", word) else 0
        core = re.sub(r"^[\W_]+(?<![-+$€£])|[\W_]+(?<!%)$", "", word)
        low = core.lower()
        if not low:
            kind = EMPTY
        elif _NUMBER.fullmatch(low) or (j := _JOINED.fullmatch(low)) and j[2] in UNITS:
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif core[:1].isupper() and not (len(core) > 1 and core.isupper()):
            kind = NAME
        else:
            kind = PLAIN
        self[raw] = h = (xxhash.xxh3_64_intdigest(low) & ~15) | kind | ends
        return h


def _kinds(canon: Canon, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Plain hashes and kinds of the words of texts, whether they begin a sentence, and the number of their text."""
    split = [text.split() for text in texts]
    sizes = [len(w) for w in split]
    n = sum(sizes)
    v = np.fromiter(map(canon.__getitem__, chain.from_iterable(split)), np.uint64, n)
    doc = np.repeat(np.arange(len(texts)), sizes)
    code = (v & np.uint64(15)).astype(np.int8)
    kind, ends = code & 7, (code & ENDS) > 0
    first = np.r_[True, (doc[1:] != doc[:-1]) | ends[:-1]] if n else np.empty(0, bool)
    first[1:] |= (first & (kind == EMPTY))[:-1]
    keep = kind != EMPTY
    v, kind, first, doc = v[keep] & ~np.uint64(15), kind[keep], first[keep], doc[keep]
    after = np.r_[False, (kind[:-1] == NUMBER) & (doc[1:] == doc[:-1])] if len(v) else np.empty(0, bool)
    kind[(kind == UNIT) & ~after] = PLAIN
    return v, kind, first, doc


def _shape(v: np.ndarray, kind: np.ndarray) -> np.ndarray:
    shape = v.copy()
    for k, h in _SLOT.items():
        shape[kind == k] = h
    return shape


def template(canon: Canon, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plain hashes, template hashes and kinds of a text's words."""
    v, kind, first, _ = _kinds(canon, [text])
    kind[(kind == NAME) & first] = PLAIN
    return v, _shape(v, kind), kind


def _forms(canon: Canon, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(form, plain hashes, template hashes, kinds, numbers of texts) of the words of texts in each form."""
    v, kind, first, doc = _kinds(canon, texts)
    if not len(v):
        return
    yield WORDS, v, v, kind, doc
    typed = np.where((kind == NAME) & first, PLAIN, kind)
    yield TYPED, v, _shape(v, typed), typed, doc
    start = ~((kind[1:] == NAME) & (kind[:-1] == NAME) & ~first[1:] | (kind[1:] == UNIT))
    at = np.flatnonzero(np.r_[True, start])
    within = np.arange(len(v)) - np.repeat(at, np.diff(np.r_[at, len(v)]))
    # a value is the sum of its words' hashes, each turned by its place
    v, kind = np.add.reduceat(v * (np.uint64(2) * within.astype(np.uint64) + np.uint64(1)), at), kind[at]
    yield MERGED, v, _shape(v, kind), kind, doc[at]


class Wanted:
    """The hashes of an index, to be looked up: a table of their low bits sorts out most others."""

    BITS = 22

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.low = np.sort(hashes), np.zeros(1 << self.BITS, bool)
        self.low[self._low(hashes)] = True

    def _low(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def among(self, h: np.ndarray) -> np.ndarray:
        """Places of ``h`` whose hash is wanted."""
        at = np.flatnonzero(self.low[self._low(h)])
        if not len(at):
            return at
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        return at[self.hashes[k] == h[at]]


def _candidates(form: int, v: np.ndarray, shape: np.ndarray, kind: np.ndarray, doc: np.ndarray, width: int, wanted: Wanted | None) -> Iterator[tuple]:
    """(number of the text, place, hash, form, slot values) of windows; of those ``wanted`` only, if given."""
    h = windows(shape, width)
    at = np.arange(len(h)) if wanted is None else wanted.among(h)
    at = at[doc[at] == doc[at + width - 1]]
    if form != WORDS:
        sums = np.cumsum(np.r_[0, kind != PLAIN])
        slots = sums[at + width] - sums[at]
        at = at[(slots >= (form == TYPED)) & (width - slots >= MIN_PLAIN)]
    begin = np.searchsorted(doc, doc[at])
    for d, p, x, k in zip(doc[at].tolist(), (at - begin).tolist(), h[at].view(np.int64).tolist(), at.tolist(), strict=True):
        yield d, p, x, form, v[k : k + width][kind[k : k + width] != PLAIN].view(np.int64).tolist() if form != WORDS else []


def _short(v: np.ndarray, doc: np.ndarray, wanted: Wanted | None) -> Iterator[tuple]:
    """(number of the text, 0, hash, form, no values) of the texts of fewer than ``SHORTEST`` words, as a whole; of those ``wanted`` only, if given."""
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
    size = np.diff(np.r_[begin, len(doc)])
    for n in range(1, SHORTEST):
        at = begin[size == n]
        if len(at):
            h = windows(v, n)[at]
            keep = np.arange(len(at)) if wanted is None else wanted.among(h)
            yield from ((d, 0, x, WHOLE, []) for d, x in zip(doc[at[keep]].tolist(), h[keep].view(np.int64).tolist(), strict=True))


def _of_items(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in batches:
            out: list[tuple] = []
            for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text"), strict=True):
                for form, v, *rest in _forms(canon, [text.as_py() or b""]):
                    w = min(width, len(v))
                    if form == WORDS:
                        out += [(i, *row[1:], 0) for row in _short(v, rest[-1], None)]
                    if w >= SHORTEST:
                        out += [(i, *row[1:], w) for row in _candidates(form, v, *rest, w, None)]
                if len(out) > 100_000:
                    yield _batch(out, ["item_id", "place", "hash", "form", "vals", "width"])
                    out = []
            if out:
                yield _batch(out, ["item_id", "place", "hash", "form", "vals", "width"])

    return run


def _of_documents(widths: list[int], wanted):
    names = ["doc_id", "place", "hash", "form", "vals"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon, known = Canon(), wanted() if wanted else None
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            a = 0
            while a < len(ids):
                b, size, part = a, 0, []
                while b < len(ids) and (not part or size < 1 << 20):  # about a megabyte of text at once
                    part.append(texts[b].as_py() or b"")
                    size += len(part[-1])
                    b += 1
                out: list[tuple] = []
                for form in _forms(canon, part):
                    if form[0] == WORDS:
                        out += [(ids[a + d], *row) for d, *row in _short(form[1], form[-1], known)]
                    for w in widths:
                        for d, *row in _candidates(*form, w, known):
                            out.append((ids[a + d], *row))
                            if len(out) > 100_000:
                                yield _batch(out, names)
                                out = []
                if out:
                    yield _batch(out, names)
                a = b

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32())
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds)], names=names)


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, item_id, item_windows, n_plain, n_template) for each document that holds enough of an item.

    Enough is ``MIN_RUN`` windows, or ``MIN_SHARE`` of the item's where these are fewer, matched as plain words anywhere, or as a
    template with consistent slots at one offset. Reads ``docs(doc_id, text)`` and ``benchmark(item_id, text)`` only. An item of fewer than ``SHORTEST``
    words is held by documents of the same words and no others. Texts without words match nothing; nor do rows without id. Repeated rows count as one. Empty tables give an empty
    result.
    """
    spark = docs.sparkSession
    shape = "long, place int, hash long, form int, vals array<long>"
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    with text_batches(spark):
        items = items.mapInArrow(lean(_of_items(width)), f"item_id {shape}, width int")
        items = materialize(items.withColumnRenamed("place", "item_place").withColumnRenamed("vals", "item_vals"), "items")
        hashes = items.select("hash").distinct()
        wanted = None
        if hashes.count() <= MAX_BROADCAST:
            share = spark.sparkContext.broadcast(hashes.toArrow().column("hash").to_numpy().view(np.uint64))
            wanted = lambda: Wanted(share.value)
        widths = sorted(r["width"] for r in items.where("width > 0").select("width").distinct().collect())
        hits = materialize(rows.mapInArrow(lean(_of_documents(widths, wanted)), f"doc_id {shape}"), "hits")
    pairs = hits.join(items, ["hash", "form"]).select("doc_id", "item_id", "item_place", "form", (F.col("form") == MERGED).alias("merged"), (F.col("place") - F.col("item_place")).alias("offset"), F.arrays_zip("vals", "item_vals").alias("z"))
    # an item has few windows, so a group is small; copies of a passage within a document have offsets of their own
    at = ["doc_id", "item_id", "merged", "offset"]
    order = Window.partitionBy(*at).orderBy("item_place")
    gap = F.col("item_place") - F.coalesce(F.lag("item_place").over(order), F.col("item_place")) > 1
    pairs = pairs.withColumn("gap", gap.cast("int")).withColumn("stretch", F.sum("gap").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    stretches = pairs.groupBy(*at, "stretch").agg(
        F.collect_set(F.when(F.col("form").isin(WORDS, WHOLE), F.col("item_place"))).alias("plain"),
        F.size(F.collect_set("item_place")).alias("both"),
        F.array_distinct(F.flatten(F.collect_set("z"))).alias("z"))
    one_value = lambda z: F.size(F.array_distinct(F.transform(z, lambda x: x["item_vals"]))) == F.size(z)
    runs = stretches.groupBy(*at).agg(
        F.flatten(F.collect_list("plain")).alias("plain"), F.sum("both").alias("all"), F.array_distinct(F.flatten(F.collect_list("z"))).alias("z"),
        F.max(F.when(one_value(F.col("z")), F.col("both"))).alias("longest"))
    of_all = F.when(one_value(F.col("z")), F.col("all"))
    most = lambda m, c: F.coalesce(F.max(F.when(F.col("merged") == m, c)), F.lit(0)).cast("long")
    found = runs.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("plain")))).cast("long").alias("n_plain"),
        most(False, of_all).alias("n_typed"), most(True, of_all).alias("n_merged"), most(False, F.col("longest")).alias("typed_run"), most(True, F.col("longest")).alias("merged_run"))
    places = lambda m: (F.max(F.when((F.col("form") == MERGED) == m, F.col("item_place"))) + 1).cast("long")
    total = items.groupBy("item_id").agg(places(False).alias("item_windows"), places(True).alias("merged_windows"))
    need = lambda n: F.least(F.lit(MIN_RUN), F.ceil(F.col(n) * MIN_SHARE))
    # a stretch on its own has to be the larger part of the item
    part = lambda n: F.greatest(need(n), F.ceil(F.col(n) * MIN_SHARE))
    enough = (F.greatest("n_plain", "n_typed") >= need("item_windows")) | (F.col("typed_run") >= part("item_windows"))
    enough = enough | ((F.col("n_merged") > 0) & (F.col("n_merged") >= need("merged_windows"))) | ((F.col("merged_run") > 0) & (F.col("merged_run") >= part("merged_windows")))
    return found.join(total, "item_id").where(enough).select("doc_id", "item_id", "item_windows", "n_plain", F.greatest("n_typed", "n_merged", "typed_run", "merged_run").alias("n_template"))
