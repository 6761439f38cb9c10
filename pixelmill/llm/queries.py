"""Thin queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelmill.llm.warc import archives_round_trip

    return archives_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelmill.llm.embed_dedup import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelmill.llm.token_binary import tokens_round_trip

    return tokens_round_trip(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), 2)


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelmill.llm.pii import span_digests

    return span_digests(_table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelmill.llm.mixing import mix_counts

    return mix_counts(_table(spark, sf_dir, "documents"))


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelmill.llm.decontam import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelmill.llm.ngram_join import similar_documents

    return similar_documents(_table(spark, sf_dir, "documents"))


def op8_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelmill.llm.quality import select_documents

    return select_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents; delete those under 5 words; recount the French ones without bare marks. Each batch is sent twice."""
    from pixelmill.llm.common import shared_path
    from pixelmill.llm.token_counts import Rollup, count_events

    docs = _table(spark, sf_dir, "documents")
    rollup = Rollup(spark, shared_path(spark, "rollup"))
    added = count_events(docs, "insert")
    rollup.commit(0, added)
    short = rollup.ledger().where("version = 'words-1' and n_tokens < 5").select("doc_id")
    gone = rollup.ledger().join(short, "doc_id", "left_semi").selectExpr("doc_id", "version", "source", "lang", "n_tokens", "'delete' AS op", "1L AS seq")
    rollup.commit(1, gone)
    kept = docs.where("lang = 'fr'").join(rollup.ledger().where("live").select("doc_id").distinct(), "doc_id", "left_semi")
    recount = count_events(kept, "revise", 2, {"words-1": r"[^\x20\x09-\x0D]*[A-Za-z0-9][^\x20\x09-\x0D]*"})
    rollup.commit(2, recount)
    for batch, events in ((0, added), (1, gone), (2, recount)):
        if rollup.commit(batch, events):
            raise AssertionError("a committed batch was taken again")
    return rollup.totals()


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelmill.llm.line_dedup import remove_boilerplate

    found = remove_boilerplate(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelmill.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


#: Verdict, host and path of the rules that ``op12_url_aliases`` applies.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op12_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pixelmill.llm.url_filter import filter_pages

    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return filter_pages(_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, checked against documents of which those with an even crc32 of doc_id have lost their line feeds."""
    from pixelmill.llm.merkle import leaves_of, manifest, verified

    lost = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return verified(manifest(leaves_of(_table(spark, sf_dir, "documents"), {"text": lost})))


QUERIES = {
    "op1_warc_archives": op1_warc_archives,
    "op2_embedding_forest": op2_embedding_forest,
    "op3_token_files": op3_token_files,
    "op4_pii_spans": op4_pii_spans,
    "op5_source_mix": op5_source_mix,
    "op6_template_decontamination": op6_template_decontamination,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_quality_resampling": op8_quality_resampling,
    "op9_token_rollups": op9_token_rollups,
    "op10_line_spread": op10_line_spread,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_url_aliases": op12_url_aliases,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE: dict[str, str] = {
    "op1_warc_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < keep THEN keep END AS refers_to
FROM k""",
    "op2_embedding_forest": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS s, b.vec_id AS t FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
c(id, low) USING KEY (id) AS (SELECT vec_id, vec_id FROM v
  UNION SELECT e.t, min(n.low) FROM c n JOIN e ON e.s = n.id JOIN recurring.c r ON r.id = e.t WHERE n.low < r.low GROUP BY e.t)
SELECT vec_id, (SELECT count(*) FROM e WHERE s = vec_id)::BIGINT AS n_links, low AS component_id, vec_id = low AS kept FROM v JOIN c ON id = vec_id""",
    "op7_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a AS s, b AS t FROM l UNION ALL SELECT b, a FROM l),
c(id, low) USING KEY (id) AS (SELECT doc_id, doc_id FROM s
  UNION SELECT e.t, min(n.low) FROM c n JOIN e ON e.s = n.id JOIN recurring.c r ON r.id = e.t WHERE n.low < r.low GROUP BY e.t)
SELECT doc_id, len(s)::BIGINT AS n_shingles, low AS component_id FROM s JOIN c ON id = doc_id""",
    "op9_token_rollups": r"""
WITH d AS (SELECT source, lang,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS w,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]*[A-Za-z0-9][^\x20\x09-\x0D]*'))::BIGINT AS wf,
    len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]'))::BIGINT AS m
  FROM documents),
e AS (
  SELECT source, lang, 'words-1' AS version, CASE WHEN lang = 'fr' THEN wf ELSE w END AS n FROM d WHERE w >= 5
  UNION ALL SELECT source, lang, 'marks-2', m FROM d WHERE w >= 5)
SELECT source, lang, version, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM e GROUP BY ALL""",
    "op10_line_spread": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS site, text FROM documents),
x AS (SELECT r, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM x),
b AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= 10),
a AS (SELECT r, count(*) AS n, count(b.key) AS gone, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.key IS NULL), '') AS t
  FROM k LEFT JOIN b ON k.key = b.key GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_removed, length(t)::BIGINT AS n_chars_left, sha256(t) AS text_sha256
FROM d LEFT JOIN a ON d.r = a.r""",
    "op12_url_aliases": r"""
WITH RECURSIVE rules(rv, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
l AS (SELECT url AS src, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
m AS (SELECT url AS src, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
links AS (SELECT src, regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS dst FROM l WHERE regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b')
  UNION ALL SELECT src, regexp_extract(tag, '(?i)\burl\s*=\s*([^"''\s>]+)', 1) FROM m WHERE regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh\b')),
u AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT src FROM links UNION ALL SELECT dst FROM links) WHERE contains(url, '://')),
h AS (SELECT url, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM u),
k AS (SELECT *, regexp_replace(host, '\.?(:80|:443)?$', '') || CASE WHEN path = '' THEN '/' ELSE path END || '?'
    || ltrim(regexp_replace(query, '(^|&)(utm_[a-z]+|gclid|fbclid|msclkid)=[^&]*', '', 'g'), '&') AS key FROM h),
j AS (SELECT url, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(rv, length(rh) + length(rp)) AS verdict
  FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY url),
e AS (SELECT a.key AS s, b.key AS t FROM links JOIN k a ON a.url = src JOIN k b ON b.url = dst UNION SELECT b.key, a.key FROM links JOIN k a ON a.url = src JOIN k b ON b.url = dst),
hit(key) AS (SELECT DISTINCT key FROM k JOIN j USING (url) WHERE verdict = 'block' UNION SELECT t FROM hit JOIN e ON s = hit.key)
SELECT page_id, coalesce(k.host, '') AS host, coalesce(k.path, '') AS path, j.rule, coalesce(j.verdict, CASE WHEN hit.key IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM pages LEFT JOIN k ON k.url = pages.url LEFT JOIN j ON j.url = pages.url LEFT JOIN hit ON hit.key = k.key""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE b AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '-') AS tree, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    xor(4294967295, list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT),
      lambda c, x: list_reduce(range(8), lambda y, z: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, x)), 4294967295::BIGINT)) AS crc
  FROM documents),
c AS (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS lost FROM b),
d AS (SELECT r, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(lost) || ':' || lost, '-')) AS claimed FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, claimed, r) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d),
t AS (SELECT tree, 0 AS lvl, idx, n, leaf AS h FROM n
  UNION ALL SELECT tree, lvl + 1, idx // 3, any_value(n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY tree, lvl, idx // 3),
s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, idx, n, subroot AS h FROM s
  UNION ALL SELECT lvl + 1, idx // 3, any_value(n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY lvl, idx // 3),
f AS (SELECT r, tree, 0 AS lvl, idx, n, claimed AS h, '' AS proof FROM n
  UNION ALL SELECT f.r, f.tree, f.lvl + 1, f.idx // 3, (f.n + 2) // 3, sha256(string_agg(CASE WHEN t.idx = f.idx THEN f.h ELSE t.h END, '' ORDER BY t.idx)),
    f.proof || coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (WHERE t.idx <> f.idx), '')
  FROM f JOIN t ON t.tree = f.tree AND t.lvl = f.lvl AND t.idx // 3 = f.idx // 3 WHERE f.n > 1 GROUP BY f.r, f.tree, f.lvl, f.idx, f.n, f.proof),
g AS (SELECT r, 0 AS lvl, s.idx, s.n, f.h, f.proof FROM f JOIN s ON s.tree = f.tree WHERE f.n = 1
  UNION ALL SELECT g.r, g.lvl + 1, g.idx // 3, (g.n + 2) // 3, sha256(string_agg(CASE WHEN u.idx = g.idx THEN g.h ELSE u.h END, '' ORDER BY u.idx)),
    g.proof || coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (WHERE u.idx <> g.idx), '')
  FROM g JOIN u ON u.lvl = g.lvl AND u.idx // 3 = g.idx // 3 WHERE g.n > 1 GROUP BY g.r, g.lvl, g.idx, g.n, g.proof)
SELECT n.doc_id, n.leaf, s.subroot, u.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = u.h AS verified
FROM n JOIN s ON s.tree = n.tree JOIN u ON u.n = 1 JOIN g ON g.r = n.r AND g.n = 1""",
}
