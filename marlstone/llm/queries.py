"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import secret_scan, url_filters
from marlstone.llm.bpe import bpe_encode
from marlstone.llm.fingerprints import NEAR, NEAR_BANDS, NEAR_ROWS, minhash_classes
from marlstone.llm.ngram_join import ngram_jaccard_join
from marlstone.llm.packing import best_fit_packing
from marlstone.llm.quality_classifier import quality_scores
from marlstone.llm.quality_rules import quality_rules
from marlstone.llm.suffix_dedup import repeated_spans
from marlstone.llm.toxicity import toxic_documents


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_documents(spark, sf_dir))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(_documents(spark, sf_dir))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_classes(_documents(spark, sf_dir), bands=NEAR_BANDS, rows=NEAR_ROWS, threshold=NEAR)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_secret_scans(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """``ledger`` is the folder of the ledger (see ``secret_scan`` for what holds without it)."""
    return secret_scan.secret_findings(_documents(spark, sf_dir), secret_scan.Ledger(spark, ledger))


def op9_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(_documents(spark, sf_dir), _labels(spark, sf_dir))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_url_filters": op5_url_filters,
    "op6_secret_scans": op6_secret_scans,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_byte_level_bpe": op9_byte_level_bpe,
    "op10_toxicity": op10_toxicity,
}

_WORDS = r"regexp_extract_all(lower(text), '[^ \t\n\x0b\f\r]+')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_GLOBS = ", ".join(f"({k}, {_quoted(url_filters.regex(r))})" for k, r in enumerate(url_filters.RULES))

ORACLE = {
    "op6_secret_scans": r"""
WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
f AS (
SELECT doc_id, 'aws_access_key' AS rule, 1 AS version, unnest(regexp_extract_all(text, '\b(AKIA|ASIA)[A-Z0-9]{16}\b')) AS s FROM d
UNION ALL SELECT doc_id, 'github_token', 2, unnest(regexp_extract_all(text, '\b(ghp|gho|ghu|ghs|ghr)_[a-zA-Z0-9]{36}[a-zA-Z0-9]*')) FROM d
UNION ALL SELECT doc_id, 'slack_token', 2, unnest(regexp_extract_all(text, '\bxox(a|b|p|r|s)-[-a-zA-Z0-9]{10}[-a-zA-Z0-9]*')) FROM d
UNION ALL SELECT doc_id, 'google_api_key', 2, unnest(regexp_extract_all(text, '\bAIza[-_a-zA-Z0-9]{35}[-_a-zA-Z0-9]*')) FROM d
UNION ALL SELECT doc_id, 'payment_key', 2, unnest(regexp_extract_all(text, '\b(pk|rk|sk)_(live|test)_[a-zA-Z0-9]{16}[a-zA-Z0-9]*')) FROM d
UNION ALL SELECT doc_id, 'json_web_token', 1, unnest(regexp_extract_all(text, '\beyJ[-_a-zA-Z0-9]{8,}[.]eyJ[-_a-zA-Z0-9]{8,}[.][-_a-zA-Z0-9]{8,}')) FROM d
UNION ALL SELECT doc_id, 'private_key', 2, unnest(regexp_extract_all(text, '(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----(.*?-----END [A-Z ]*PRIVATE KEY-----|[a-zA-Z0-9+/= \t\n\x0b\f\r]*)')) FROM d
UNION ALL SELECT doc_id, 'url_password', 2, unnest(regexp_extract_all(text, '[a-z][-+.a-z0-9]{0,30}://[^:/@ \t\n\x0b\f\r]+:[^/@ \t\n\x0b\f\r]+@[^/ \t\n\x0b\f\r]+')) FROM d
UNION ALL SELECT doc_id, 'assigned_secret', 2, unnest(regexp_extract_all(text, '((?i)password|passwd|secret|token|api-?key|api_key)["'']?[ \t]*(=|:)[ \t]*["'']?[^]"''`<>(){}[,; \t\n\x0b\f\r]{12,}["'']?')) FROM d)
SELECT DISTINCT doc_id, rule, version, sha256(s) AS secret_sha256 FROM f""",
    "op5_url_filters": rf"""
WITH r(k, p) AS (VALUES {_GLOBS}),
a AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(url, ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '(?s)#.*$', '') AS u FROM pages),
b AS (SELECT page_id, u, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*') AS h FROM a),
c AS (SELECT page_id, CASE WHEN h = '' THEN u ELSE regexp_replace(lower(h), '^(http://[^/]*):80$|^(https://[^/]*):443$', '\1\2')
        || CASE WHEN starts_with(substr(u, length(h) + 1), '/') THEN '' ELSE '/' END || substr(u, length(h) + 1) END AS url FROM b),
u AS (SELECT DISTINCT url FROM c),
m AS (SELECT u.url, list(r.k ORDER BY r.k) FILTER (u.url <> '' AND regexp_full_match(u.url, r.p)) AS rules FROM u CROSS JOIN r GROUP BY u.url)
SELECT page_id, c.url, coalesce(rules, []::INT[]) AS rules, rules IS NOT NULL AS blocked FROM c JOIN m USING (url)""",
    "op2_suffix_array_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0b\f\r]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, i - 1 AS p, hash(list_slice(w, i, i + 49)) AS h1, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h2
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
g AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h1, h2 ORDER BY doc_id, p) = 1 AS is_first, count(*) OVER (PARTITION BY h1, h2) AS n FROM s),
b AS (SELECT doc_id, p, is_first, coalesce(p > lag(p) OVER o + 50, true)::INT AS new FROM g WHERE n > 1 WINDOW o AS (PARTITION BY doc_id, is_first ORDER BY p)),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, is_first ORDER BY p) AS island FROM b)
SELECT doc_id, min(p)::INT AS start_word, (max(p) + 50)::INT AS end_word, is_first FROM k GROUP BY doc_id, is_first, island""",
    "op7_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS g FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, count(*) AS n, list(g ORDER BY g) AS gs FROM g GROUP BY doc_id),
r AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY gs) AS rep FROM s),
gr AS (SELECT g.doc_id, g.g, r.n FROM g JOIN r ON g.doc_id = r.doc_id AND r.rep = r.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o, any_value(a.n) AS x, any_value(b.n) AS y
      FROM gr a JOIN gr b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE o / (x + y - o)::DOUBLE >= 0.6),
c AS (SELECT rep, count(*) AS copies FROM r GROUP BY rep),
l AS (SELECT e.a AS rep, sum(c.copies) AS links FROM e JOIN c ON c.rep = e.b GROUP BY e.a),
t(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.node WHERE t.root < e.b),
k AS (SELECT node, min(root) AS root FROM t GROUP BY node)
SELECT doc_id, coalesce(k.root, r.rep) AS class_id, (c.copies - 1 + coalesce(l.links, 0))::BIGINT AS links
FROM r JOIN c USING (rep) LEFT JOIN l USING (rep) LEFT JOIN k ON k.node = r.rep WHERE c.copies - 1 + coalesce(l.links, 0) > 0""",
}
