"""Personal data: spans by pattern, and terms that give protected entities away. DataFrame and SQL functions only.

Base spans are e-mail and IP addresses, card and phone numbers; secrets (long hexadecimal runs, and what is assigned to a token, key or password)
are added to them. What is protected are entities of two levels: each value found, and its class (an address's domain, the first half of
an IP address, the first digits of a number). The context of an entity is ``REACH`` code points on either side; its terms are the words there that
are neither part of a base span of the text nor key words of the patterns.

The corpus tells how strongly a term of the context reveals an entity. With document frequencies over the whole corpus, its share is the
pointwise mutual information of term and entity divided by the entity's own information, after ``SMOOTH`` texts that hold the term alone
are added: near 1 where the term occurs with the entity only. A term is flagged, wherever it occurs, where the share reaches ``GENERALISE`` and the evidence
is beyond chance: the different contexts that hold both are more than texts with the term would meet the entity by themselves. The bound of that chance, -k log2(k / (e n q)) bits for k
contexts, n different texts with the term and an entity in a share q of all different texts, has to be ``SURE`` bits below one in as many as there are pairs. Few contexts so suffice for a
rare entity in a large corpus, and copies of one text are no evidence. Terms whose share reaches ``REMOVE`` are removed; others are generalised to the class of terms with
the same first ``STEM`` letters if this class reveals less than ``GENERALISE``, and removed if it doesn't.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import materialize

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "term")
REACH, SMOOTH, SURE, GENERALISE, REMOVE, STEM = 80, 0.5, 10, 0.7, 0.9, 3
#: Words that the patterns demand before a secret.
KEYS = ("token", "secret", "key", "password", "passwd")
#: Small tables of terms or documents are broadcast up to so many terms or ids, else joined by shuffle, with salt for texts that occur often.
MAX_BROADCAST, SALT = 500_000, 16
TERM = r"\p{L}{4,}"
# A match can only begin where a run begins, or where the last match ended, so no start is tried within a run; what follows
# a possessive part could never use what it gives back. Both leave the matches as they are and the time linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = (
    r"(?<![0-9A-Za-z])(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])"
    r"|(?<=(?i:token|secret|key|password|passwd)[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"'])[^\s\"']{8,}+(?=[\"'])")
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
SPAN = "array<struct<s:long,k:int,e:long,v:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: every second digit from the right counts double, less 9 above 9."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _is_card(m: Column) -> Column:
    return F.when(F.length(_digits(m)).between(14, 19), _luhn(_digits(m))).otherwise(False)


def _spans(text: Column, pattern: str, kind: int, valid) -> Column:
    """Spans (start, kind, end, value) of the valid matches: a match's place follows from the pieces before it."""
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(p.alias("p"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), x["m"].alias("v")))
        return F.struct(e.cast("long").alias("at"), F.when(x["m"].isNotNull() & valid(x["m"]), F.concat(acc["out"], one)).otherwise(acc["out"]).cast(SPAN).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """All base spans of a text, and secrets, by start, then kind."""
    none = F.array().cast(SPAN)
    found = (
        (F.contains(text, F.lit("@")), EMAIL, lambda m: F.lit(True)),
        (F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]")), IP, lambda m: F.rlike(m, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))),
        (F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){13}")), CARD, _is_card),
        (F.contains(text, F.lit("+")), PHONE, lambda m: F.length(_digits(m)).between(10, 15)),
        (F.rlike(text, F.lit(r"[0-9A-Fa-f]{32}|[=:][\x20\t]{0,3}[\"']")), SECRET, lambda m: F.lit(True)),
    )
    return F.sort_array(F.concat(*[F.when(gate, _spans(text, p, k, ok)).otherwise(none) for k, (gate, p, ok) in enumerate(found)]))


def _entities(b: Column) -> Column:
    """The entities that a span stands for: its value and its class."""
    kind, digits = F.element_at(F.array(*map(F.lit, KINDS)), b["k"] + 1), _digits(b["v"])
    of_class = F.when(b["k"] == 0, F.substring_index(F.lower(b["v"]), "@", -1)).when(b["k"] == 1, F.substring_index(b["v"], ".", 2)).when(b["k"] == 4, None).otherwise(F.substring(digits, 1, 4))
    return F.array_compact(F.array(F.concat_ws("=", kind, F.lower(b["v"])), F.when(of_class.isNotNull(), F.concat_ws("~", kind, of_class))))


def _named(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")


def _small(df: DataFrame, items: Column | None = None) -> DataFrame:
    """``df``, to be broadcast if it has few rows (or few ``items`` in all)."""
    n = df.count() if items is None else df.agg(F.sum(items)).first()[0] or 0
    return F.broadcast(df) if n <= MAX_BROADCAST else df


def _terms(text: Column) -> Column:
    """The different terms of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def disclosure(rows: DataFrame, based: DataFrame) -> DataFrame:
    """Rows (term, share, coarse) of the terms to generalise or remove, from ``rows(doc_id, text, h)`` and ``based(h, base)``.

    ``coarse`` is the share of the term's class. Copies of a text count in all frequencies, but as one context.
    """
    held = based.where(F.size("base") > 0)
    copies = materialize(held.groupBy("h").agg(F.count("*").alias("copies"), F.first("base").alias("base")), "copies")
    entity = F.explode(F.array_distinct(F.flatten(F.transform("base", _entities)))).alias("entity")
    entities = copies.select("copies", entity).groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("d_entity"))
    texts = rows.join(_small(copies.select("h", "copies")), "h").dropDuplicates(["h"])
    found = texts.withColumn("base", base_spans(F.col("text")))
    # letters of other values of the text aren't words of a context
    own = _terms(F.concat_ws(" ", F.transform("base", lambda x: x["v"]), F.array(*map(F.lit, KEYS))))
    def around(b: Column) -> Column:
        left = F.substring("text", F.greatest(b["s"] - REACH, F.lit(0)).cast("int") + 1, F.least(b["s"], F.lit(REACH)).cast("int"))
        return F.struct(F.concat_ws(" ", left, F.substring("text", b["e"].cast("int") + 1, F.lit(REACH))).alias("context"), _entities(b).alias("entities"))

    # contexts are cut out before rows are made of them, so that a text isn't repeated for each of its values
    contexts = found.select("h", "copies", own.alias("own"), F.transform("base", around).alias("around")).select("h", "copies", "own", F.explode("around").alias("a"))
    near = contexts.select("h", "copies", F.xxhash64("a.context").alias("c"), "a.entities", F.array_except(_terms(F.col("a.context")), F.col("own")).alias("terms"))
    near = near.select("h", "copies", "c", F.explode("entities").alias("entity"), "terms").select("h", "copies", "c", "entity", F.explode("terms").alias("term"))
    # sums are made before any join by entity, and contexts are told apart by aggregation, so a frequent entity is no group of its own
    one = near.groupBy("entity", "term", "h").agg(F.first("copies").alias("copies"), F.min("c").alias("c"))
    one = one.groupBy("entity", "term", "c").agg(F.sum("copies").alias("n"))
    both = one.groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("n_both"))
    entities = materialize(entities.where(F.col("n_entity") > 1), "entities")  # one context is no evidence
    pairs = materialize(both.where(F.col("contexts") > 1).join(_small(entities), "entity"), "pairs")
    if pairs.isEmpty():
        return pairs.select("term", F.lit(0.0).alias("share"), F.lit(0.0).alias("coarse"))
    total, different = rows.count(), based.select("h").distinct().count()
    frequency = rows.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    # terms of the contexts, and those whose class has one of them
    stem = F.substring("term", 1, STEM)
    stems = pairs.select(stem.alias("stem")).distinct()
    frequency = materialize(frequency.withColumn("stem", stem).join(stems, "stem", "left_semi"), "frequency")
    own = -F.log2(F.col("n_entity") / total)

    def share(n_both: str, n_term: str) -> Column:
        return F.when(own > 0, 1 + F.log2(F.col(n_both) / (F.col(n_term) + SMOOTH)) / own).otherwise(0.0)

    of_class = pairs.groupBy("entity", "n_entity", stem.alias("stem")).agg(F.sum("n_both").alias("class_both"))
    of_class = of_class.join(frequency.groupBy("stem").agg(F.sum("n_term").alias("class_term")), "stem").select("entity", "stem", share("class_both", "class_term").alias("coarse"))
    shares = pairs.join(frequency, "term").withColumn("share", share("n_both", "n_term")).where(F.col("share") >= GENERALISE)
    # of the terms that are left, the different texts that hold them
    shares = materialize(shares, "shares")
    spread = rows.select("h", F.explode(_terms(F.col("text"))).alias("term")).join(_small(shares.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count_distinct("h").alias("d_term"))
    bits = F.col("contexts") * F.log2(F.col("contexts") * different / (math.e * F.col("d_term") * F.col("d_entity")))
    shares = shares.join(spread, "term").where(bits >= SURE + math.log2(pairs.count()))
    return shares.join(of_class, ["entity", "stem"]).groupBy("term").agg(F.max("share").alias("share"), F.max("coarse").alias("coarse"))


def find_spans(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, h, digest, base, terms) for ``docs(doc_id, text)``: arrays of spans (s, k, e, v), places in code points, ends exclusive.

    ``base`` holds secrets, too; terms lie outside of them. h is the hash of the text, null counting as empty, digest its SHA-256; the value of a term's span is "generalise" or "remove". Repeated
    rows come back repeated, a null doc_id is an id like any, other columns are not read, an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    based = materialize(rows.select("doc_id", "h", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), base_spans(F.col("text")).alias("base")), "base")
    terms = materialize(disclosure(rows, based), "terms")
    none = F.array().cast(SPAN)
    if terms.isEmpty():
        return based.withColumn("terms", none)
    gone = (F.col("share") >= REMOVE) | (F.col("coarse") >= GENERALISE)
    held = rows.select("h", F.explode(_terms(F.col("text"))).alias("term"))
    flagged = held.join(_small(terms), "term").groupBy("h").agg(F.collect_set("term").alias("all"), F.collect_set(F.when(gone, F.col("term"))).alias("gone"))
    flagged = materialize(flagged, "flagged")
    inside = F.struct(F.col("b.s"), F.col("b.k"), F.col("b.e"), F.when(F.array_contains("gone", F.lower("b.v")), "remove").otherwise("generalise").alias("v"))
    texts = rows.join(_small(flagged, F.size("all") + 2), "h").dropDuplicates(["h"])
    texts = texts.select("h", "gone", F.explode(_spans(F.col("text"), TERM, len(KINDS) - 1, lambda m: F.array_contains("all", F.lower(m)))).alias("b"))
    spans = materialize(texts.groupBy("h").agg(F.sort_array(F.collect_list(inside)).alias("terms")), "term-spans")
    if (spans.agg(F.sum(F.size("terms") + 2)).first()[0] or 0) <= MAX_BROADCAST:
        joined = based.join(F.broadcast(spans), "h", "left")
    else:  # a text may occur very often
        salted = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = based.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(salted, ["h", "salt"], "left")
    apart = F.filter("terms", lambda t: ~F.exists("base", lambda x: (x["s"] < t["e"]) & (t["s"] < x["e"])))
    return joined.select("doc_id", "h", "digest", "base", F.coalesce(apart, none).alias("terms"))


def span_digests(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_term, n_spans, clean_sha256) by ``find_spans``.

    base_sha256 is of the four base kinds; ``spans`` has all; clean_sha256 is of the text that ``sanitise`` leaves.
    """
    found = materialize(find_spans(docs), "spans")
    marked = found.where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["h"]).select("h", F.sort_array(F.concat("base", "terms")).alias("spans"))
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("whole")).withColumn("h", F.xxhash64("whole")).join(_small(marked, F.size("spans") + 2), "h").dropDuplicates(["h"])
    cleaned = materialize(texts.select("h", F.sha2(_cleaned(F.col("whole")).cast("binary"), 256).alias("clean")), "cleaned")
    if cleaned.count() <= MAX_BROADCAST:
        found = found.join(F.broadcast(cleaned), "h", "left")
    else:  # a text may occur very often
        salted = cleaned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(salted, ["h", "salt"], "left")

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    base = F.filter("base", lambda x: x["k"] < len(BASE))
    n_spans = (F.size("base") + F.size("terms")).cast("long").alias("n_spans")
    return found.select(
        "doc_id", *[count(k) for k in range(4)], F.sha2(_named(base), 256).alias("base_sha256"), _named(F.sort_array(F.concat("base", "terms"))).alias("spans"),
        count(4), F.size("terms").cast("long").alias("n_term"), n_spans, F.coalesce("clean", "digest").alias("clean_sha256"))


def _cleaned(text: Column) -> Column:
    """The text with its ``spans`` replaced."""
    term = len(KINDS) - 1
    kinds = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        coarse = F.concat(F.substring(text, x["s"].cast("int") + 1, F.lit(STEM)), F.lit("*"))
        tag = F.when(x["k"] < term, F.element_at(kinds, x["k"] + 1)).when(x["v"] == "remove", "").otherwise(coarse)
        gap = F.substring(text, acc["at"].cast("int") + 1, (x["s"] - acc["at"]).cast("int"))
        out = F.when(x["s"] >= acc["at"], F.concat(acc["out"], gap, tag)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    def last(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text)))

    return F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, last)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns, its text without personal data: base spans and secrets become ``<KIND>``; terms go, or become their first letters and ``*``.

    Overlapping spans are covered from the first start to the last end, under the first one's name. Columns of any name are kept; a
    null text without spans stays null.
    """
    found = find_spans(docs).where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["h"])
    found = found.select("h", F.sort_array(F.concat("base", "terms")).alias("spans"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("whole")).withColumn("h", F.xxhash64("whole"))
    joined = rows.join(_small(found, F.size("spans") + 2), "h", "left")
    return joined.select(*[F.when(F.col("spans").isNull(), F.col(f"row.`{c}`")).otherwise(_cleaned(F.col("whole"))).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
