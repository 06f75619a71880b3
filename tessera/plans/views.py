"""The reviewed-corpus tables, derived from the driver's tables by SQL that Spark and DuckDB both run.

Whole tables and whole texts. Blank pages, scans (every tenth conversation) and documents
without a record of their type (every tenth) come from column values, never from dropped rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCS = """
SELECT doc_id AS id, text AS raw_text, source AS source_name, 'title ' || CAST(doc_id AS STRING) AS source_title,
  CASE doc_id % 3 WHEN 0 THEN 'regulation' WHEN 1 THEN 'penalty' ELSE 'product_document' END AS data_type,
  CASE doc_id % 5 WHEN 1 THEN 'constructed_for_evaluation' WHEN 2 THEN 'demo_only' WHEN 3 THEN 'pending_verification' ELSE 'verified_public' END AS authenticity_type,
  CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'ftp://x/y' WHEN 2 THEN 'HTTPS://host/p' WHEN 3 THEN 'http:///p' WHEN 4 THEN 'file:///x'
    ELSE 'https://' || coalesce(source, 'none') || '.example/' || CAST(doc_id AS STRING) END AS source_url,
  doc_id % 16 = 0 AS local_source,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'raw/' || CAST(doc_id AS STRING) || CASE doc_id % 13 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' WHEN 2 THEN '' ELSE '.TXT' END END AS raw_file_path,
  CASE WHEN doc_id % 4 = 0 THEN 'parsed' ELSE 'pending' END AS parse_status,
  CASE doc_id % 7 WHEN 0 THEN 'collected' WHEN 1 THEN 'pending_review' WHEN 2 THEN 'approved' WHEN 3 THEN 'approved_with_revision' ELSE 'parsed' END AS final_review_status,
  CASE WHEN doc_id % 14 = 2 THEN 'indexed' ELSE 'not_indexed' END AS knowledge_index_status
FROM {documents}"""
RECORDS = """
SELECT doc_id * 2 + n AS id, doc_id AS document_id,
  CASE WHEN doc_id % 10 = 9 THEN 'other' WHEN doc_id % 3 = 0 THEN 'regulation' WHEN doc_id % 3 = 1 THEN 'penalty' ELSE 'product_document' END AS data_type,
  CASE WHEN doc_id % 4 <> 0 THEN substring(text, 1, 60) WHEN doc_id % 8 = 0 THEN '' ELSE substring(text, 1, 30) || '~' END AS source_quote,
  CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS disclosed,
  CASE WHEN doc_id % 9 IN (0, 1) THEN 'said' ELSE '' END AS wording, 'article ' || CAST(doc_id % 17 AS STRING) AS article
FROM {documents} {twice}
WHERE n = 0 OR doc_id % 6 = 0"""
CRAWL = """
SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'ftp://x/a.pdf' WHEN 1 THEN url || '/a.PDF' WHEN 2 THEN url || '/a.pdf?x=1' WHEN 3 THEN NULL ELSE url END AS url, html,
  CASE page_id % 4 WHEN 0 THEN NULL ELSE url || '/to' END AS final_url, CASE page_id % 3 WHEN 0 THEN NULL ELSE 'Thu, 29 Feb 2024 00:00:00 GMT' END AS last_modified,
  CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN NULL WHEN 2 THEN 204 ELSE 200 END AS http_status,
  CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'TEXT/HTML; charset=x' WHEN 2 THEN 'text/html ;x' WHEN 3 THEN 'application/pdf' ELSE 'application/octet-stream' END AS content_type
FROM {pages}"""
DECISIONS = """
SELECT doc_id + 1 AS line_no, CASE
  WHEN doc_id % 23 = 0 THEN '  '
  WHEN doc_id % 23 = 1 THEN '[1]'
  WHEN doc_id % 23 = 2 THEN '{{"record_id": ' || CAST(doc_id AS STRING) || ', "reviewer": null}}'
  WHEN doc_id % 23 = 3 THEN 'not json'
  ELSE '{{"record_id": ' || CASE doc_id % 19 WHEN 0 THEN '"x"' WHEN 1 THEN '1.5' WHEN 2 THEN '"' || CAST(doc_id AS STRING) || '"' ELSE CAST(doc_id - doc_id % 2 AS STRING) END
    || ', "record_type": "' || CASE (doc_id - doc_id % 2) % 3 WHEN 0 THEN 'regulation' WHEN 1 THEN 'penalty' ELSE 'product_document' END
    || '", "final_status": "' || CASE WHEN doc_id % 29 = 0 THEN 'made_up' WHEN quality = 1 AND toxic = 0 THEN 'approved' WHEN quality = 1 THEN 'approved_with_revision' WHEN toxic = 0 THEN 'rejected' ELSE 'requires_expert_review' END
    || '", "reviewer": "r", "evidence_quality": "' || CASE WHEN doc_id % 31 = 0 THEN 'E' ELSE 'B' END || '"'
    || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN ', "corrections": {{"article": "new ' || CAST(doc_id AS STRING) || '", "id": "5", "disclosed": true, "tags": ["a",1]}}'
      WHEN 2 THEN ', "corrections": {{"wording": null, "none": "n", "disclosed": "no"}}' ELSE CASE WHEN doc_id % 8 = 3 THEN ', "corrections": ["a"]' ELSE ', "corrections": {{"article": ' || CAST(doc_id AS STRING) || ', "disclosed": null}}' END END || '}}'
  END AS line FROM {labels}"""
#: Two lines for each labelled id: one of the document, one of the evaluation sample with the same id.
BOTH_DECISIONS = """
SELECT doc_id * 2 + n AS line_no, '{{"record_id": ' || CAST(doc_id AS STRING) || ', "reviewer": "r", "evidence_quality": "A", "record_type": "' || CASE n WHEN 1 THEN 'evaluation_sample' ELSE
  CASE doc_id % 3 WHEN 0 THEN 'regulation' WHEN 1 THEN 'penalty' ELSE 'product_document' END END || CASE n
  WHEN 1 THEN '", "final_status": "rejected", "corrections": {{"article": "of the sample", "split": "test", "authenticity_type": "x", "final_review_status": "indexed", "sample_category": null, "risk_labels": ["x","y"]}}}}'
  ELSE '", "final_status": "approved", "corrections": {{"article": "of the document", "source_quote": "x", "wording": 7, "disclosed": null}}}}' END AS line
FROM {labels} {twice}"""
TRANSITIONS = """
SELECT user_id AS record_id, ts, event_id, CASE event_type WHEN 'view' THEN 'parsed' WHEN 'click' THEN 'pending_review' WHEN 'signup' THEN 'approved' WHEN 'purchase' THEN 'indexed' ELSE 'rejected' END AS to_status
FROM {events}"""
PAGES = "SELECT conv_id AS doc, turn + 1 AS page_number, CASE WHEN turn % 3 = 1 OR conv_id % 10 = 0 THEN '  ' ELSE text END AS text, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS image_count FROM {conversations}"
PARAGRAPHS = """SELECT conv_id AS doc, turn AS idx, CASE WHEN role = 'system' THEN 'Title' WHEN turn % 4 = 1 THEN 'Heading 1' WHEN turn % 4 = 2 THEN '标题 2' END AS style,
  CASE WHEN turn % 5 = 3 THEN '' ELSE text END AS text, 'stem ' || CAST(conv_id AS STRING) AS stem FROM {conversations}"""
SOURCES = """
SELECT row_number() OVER (ORDER BY source) AS id, source AS name, CASE WHEN length(source) % 2 = 0 THEN 'https://' || source ELSE 'http://' END AS base_url,
  CAST(NULL AS STRING) AS publisher, CASE WHEN source LIKE '%9' THEN 'blog' ELSE 'regulation' END AS source_type, CAST(NULL AS BOOLEAN) AS enabled,
  CAST(length(source) * 1000 - 3900 AS DOUBLE) AS rate_limit_seconds FROM (SELECT DISTINCT source FROM {documents}) AS s"""
SAMPLES = """
SELECT doc_id AS id, coalesce(text, '') AS sample_text, CASE doc_id % 2 WHEN 0 THEN 'risky' ELSE 'compliant' END AS sample_category, 'built' AS construction_basis,
  'constructed_for_evaluation' AS authenticity_type, 'train' AS split, CASE WHEN doc_id % 3 = 0 THEN 'pending_review' ELSE 'approved' END AS final_review_status FROM {documents}"""

_TABLES = ("documents", "pages", "labels", "events", "conversations", "benchmark")


#: Each row with n = 0 and with n = 1
_TWICE = "LATERAL VIEW explode(array(0, 1)) AS n"
_TWICE_IN_DUCKDB = "CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1) AS two"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql.replace("{twice}", _TWICE), **used)


def text(sql: str) -> str:
    """The same view for DuckDB."""
    return sql.format(twice=_TWICE_IN_DUCKDB, **{t: t for t in _TABLES})
