"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from deltatree.llm import decontaminate, jaccard, language, licenses, merkle, packing, pages, quality_rules, quality_svm, substrings, token_counts, urls, vector_codes

#: allow or block, and host/path
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

Plan = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_svm.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_report(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10).drop(
        "longest_match", "longest_item")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Plan] = {f.__name__: f for f in (
    op1_quality_classifier, op2_license_scans, op3_language_id, op4_best_fit_packing, op5_substring_dedup, op6_quality_rules, op7_html_extraction, op8_ngram_jaccard_join, op9_benchmark_decontamination, op10_url_filters,
    op11_merkle_manifest, op12_token_counts, op13_vector_codes,
    pipeline,
)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERED = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

def _framed(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode(CAST({column} AS VARCHAR))) || ':' || {column} END"


#: Whether the CRC-32 of the decimal digits is even: a bit at a time, -1 stands for a step.
_EVEN = """(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
 lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
 lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) & 1) = 1"""

def _vector_rounds() -> str:
    """The assignments and codebooks of four rounds and the last assignment, one table each."""
    parts = []
    for i in range(5):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT rid, p, min(dist * 256 + e) // 256 AS dist, min(dist * 256 + e) % 256 AS e FROM (
  SELECT rid, v.p, e, CAST(sum((v.x - c.x) * (v.x - c.x)) AS HUGEINT) AS dist FROM v JOIN c{i} c USING (p, j) GROUP BY rid, v.p, e) GROUP BY rid, p)""")
        if i < 4:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT p, e, j, CAST(CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS x FROM c{i} c
  LEFT JOIN (SELECT a.p, a.e, v.j, count(*) AS n, CAST(sum(v.x) AS HUGEINT) AS s FROM a{i} a JOIN v USING (rid, p) GROUP BY a.p, a.e, v.j) USING (p, e, j))""")
    return ",\n".join(parts)


ORACLES: dict[str, str] = {
    "op13_vector_codes": f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT rid, pos // (n // 4) AS p, pos % (n // 4) AS j, x FROM (SELECT rid, len(x) AS n, unnest(range(len(x))) AS pos, unnest(x) AS x FROM k)),
c0 AS (SELECT p, rid AS e, j, x FROM v WHERE rid < 256),
{_vector_rounds()},
f AS (SELECT rid, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a4 GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) FROM c4) AS codebooks_sha256
FROM k JOIN f USING (rid)""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, {_framed('doc_id')} || {_framed('source')} || {_framed('lang')} || {_framed('n_chars')} AS head, text,
         CASE WHEN doc_id IS NOT NULL AND {_EVEN} THEN replace(text, chr(10), '') ELSE text END AS tampered FROM documents),
l AS (SELECT *, sha256(head || {_framed('text')}) AS leaf, sha256(head || {_framed('tampered')}) AS changed FROM d),
s AS (SELECT dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree, *,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
t(lvl, tree, pos, n, h) AS (SELECT 0, tree, pos, n, leaf FROM s
  UNION ALL SELECT lvl + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lvl, tree, pos // 3, n),
sub AS (SELECT tree, h, count(*) OVER () AS n FROM t WHERE n = 1),
c(lvl, pos, n, h) AS (SELECT 0, tree, n, h FROM sub
  UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM c WHERE n > 1 GROUP BY lvl, pos // 3, n),
runs AS (SELECT lvl, tree, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM t WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT 100 + lvl, NULL, pos // 3, list(h ORDER BY pos) FROM c WHERE n > 1 GROUP BY ALL),
steps AS (SELECT rid, lvl, CASE WHEN lvl < 100 THEN s.pos ELSE s.tree END // CAST(pow(3, lvl % 100) AS BIGINT) AS here, runs.run, hs
  FROM s JOIN runs ON (runs.tree = s.tree OR runs.tree IS NULL)
   AND runs.run = CASE WHEN lvl < 100 THEN s.pos ELSE s.tree END // CAST(pow(3, lvl % 100 + 1) AS BIGINT)),
p AS (SELECT rid, list(array_to_string(hs[:here % 3], '') || '*' || array_to_string(hs[here % 3 + 2:], '') ORDER BY lvl) AS path FROM steps GROUP BY rid)
SELECT *, folded_root = root AS verified FROM (
SELECT doc_id, leaf, sub.h AS subroot, (SELECT h FROM c WHERE n = 1) AS root, sha256(replace(array_to_string(coalesce(path, []), ''), '*', '')) AS proof_sha256,
       list_reduce(list_prepend(changed, coalesce(path, [])), lambda a, x: sha256(replace(x, '*', a))) AS folded_root
FROM s JOIN sub USING (tree) LEFT JOIN p USING (rid))""",
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
    "op8_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, {_SPACED} AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda p: w[p] || ' ' || w[p + 1] || ' ' || w[p + 2])) END AS s FROM w),
g AS MATERIALIZED (SELECT min(rid) AS g, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s), s),
t AS MATERIALIZED (SELECT g, n, unnest(s) AS t FROM g),
e AS MATERIALIZED (SELECT a.g AS a, b.g AS b FROM t a JOIN t b ON a.t = b.t AND a.g <> b.g AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
        GROUP BY a.g, b.g, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT g, g FROM g UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT r.a AS g, min(x.doc_id) AS component_id FROM r JOIN g ON g.g = r.b JOIN s x ON list_sort(x.s) = list_sort(g.s) GROUP BY r.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE c.component_id END AS component_id
FROM s LEFT JOIN g ON list_sort(g.s) = list_sort(s.s) LEFT JOIN c ON c.g = g.g""",
    "op9_benchmark_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LETTERED} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_LETTERED} AS w FROM benchmark),
bm AS (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, w[p:p + m - 1] AS seq FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS p FROM bm)),
dw AS (SELECT rid, m, p, w[p:p + m - 1] AS seq FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
h AS (SELECT rid, p, dw.m, item_id FROM dw JOIN win USING (m, seq)),
n AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, p + unnest(range(0, m)) AS q FROM h) GROUP BY rid),
i AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)""",
}
