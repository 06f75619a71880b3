"""Queries of the reviewed-corpus operators, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.staging import shared_dir
from tessera.functions.text import LINE_END, REFERENCES, SPACE
from tessera.operators import assemble, chunk, html, index, ingest, parse, quote_scan, review, validate
from tessera.plans import views
from tessera.schemas import APPROVED, AUTOMATIC, DECIDABLE, MAX_BYTES, QUOTES
from tessera.sources import files, registry, tables

Query = Callable[[SparkSession, str], DataFrame]
_AS_OF = "2024-02-29 00:00:00"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    v = views.view(spark, d, views.DOCS)
    return v.withColumn("sha256", ingest.content_hash(F.coalesce("raw_text", F.lit(""))))


def _fresh(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/tessera-staged/{uuid.uuid4().hex}"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, views.RECORDS)


V = {n: views.text(getattr(views, n)) for n in ("DOCS", "RECORDS", "CRAWL", "DECISIONS", "TRANSITIONS", "PAGES", "PARAGRAPHS", "SOURCES", "SAMPLES", "BOTH_DECISIONS")}
_DOCS = f"docs AS (SELECT *, sha256(coalesce(raw_text, '')) AS sha256 FROM ({V['DOCS']}))"
_STRIP = rf"'\A[{SPACE}]+|[{SPACE}]+\z', '', 'g'"
_lines = lambda x: rf"[y FOR y IN [regexp_replace(z, {_STRIP}) FOR z IN regexp_split_to_array({x}, '{LINE_END}')] IF y <> '']"


# Identity and ingest


@query("SELECT doc_id AS id, min(doc_id) OVER w AS document_id, doc_id = min(doc_id) OVER w AS created FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')))")
def q_dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    return ingest.insert_if_absent(_docs(spark, d).select("id", "sha256")).select("id", "document_id", "created")


@query("""WITH d AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS h FROM documents), s AS (SELECT h, min(id) AS known FROM d WHERE id % 3 = 0 GROUP BY h), f AS (SELECT *, min(id) OVER (PARTITION BY h) AS first FROM d)
SELECT f.id, coalesce(s.known, f.first) AS document_id, s.known IS NULL AND f.id = f.first AS created FROM f LEFT JOIN s ON s.h = f.h""")
def q_dedup_store(spark: SparkSession, d: str) -> DataFrame:
    """All documents against a bucketed store that has a third of them."""
    rows, name = _docs(spark, d).select("id", "sha256"), f"tessera_store_{uuid.uuid4().hex}"
    tables.append_store(rows.where("id % 3 = 0"), name, 16, _fresh(spark))
    return ingest.insert_if_absent(rows, spark.table(name), 16).select("id", "document_id", "created")


@query("SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS hash_count FROM documents GROUP BY ALL")
def q_hash_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of three runs, each over its own documents, the second one repeated."""
    rows, path = _docs(spark, d).select("id", "sha256"), _fresh(spark)
    for run in (0, 1, 1, 2):
        tables.add_counts(rows.where(F.col("id") % 3 == run), path, run)
    return tables.hash_counts(spark, path)


@query(
    "WITH x AS (SELECT doc_id = min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS c, doc_id % 50 = 7 AS bad FROM documents) "
    "SELECT count(*) FILTER (NOT bad AND c) AS created, count(*) FILTER (NOT bad AND NOT c) AS duplicates, count(*) FILTER (bad) AS failed FROM x"
)
def q_ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.insert_if_absent(_docs(spark, d).select("id", "sha256"))
    return ingest.summary(rows.withColumn("error", F.when(F.col("id") % 50 == 7, "unreadable")))


@query(
    f"WITH {_DOCS} SELECT id, sha256, data_type, 'collected' AS collection_status, 'pending' AS parse_status, 'collected' AS final_review_status, 'not_indexed' AS knowledge_index_status "
    "FROM (SELECT *, min(id) OVER (PARTITION BY sha256) AS f FROM docs) WHERE id = f"
)
def q_document_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.insert_if_absent(_docs(spark, d).select("id", "sha256", "data_type"))
    return ingest.document_rows(rows)


_SUFFIX = (
    "CASE lower(split_part(content_type, ';', 1)) WHEN 'application/pdf' THEN '.pdf' WHEN 'text/html' THEN '.html' WHEN 'text/plain' THEN '.txt' "
    r"ELSE CASE WHEN lower(regexp_extract(url, '[^/.][^/]*?(\.[^./]+)$', 1)) IN ('.pdf', '.docx', '.html', '.htm', '.txt') THEN lower(regexp_extract(url, '[^/.][^/]*?(\.[^./]+)$', 1)) ELSE '.bin' END END"
)


@query(f"SELECT page_id, {_SUFFIX} AS suffix, 'raw/' || sha256(html) || {_SUFFIX} AS raw_file_path FROM ({V['CRAWL']})")
def q_suffix(spark: SparkSession, d: str) -> DataFrame:
    v = views.view(spark, d, views.CRAWL)
    v = v.withColumn("suffix", files.storage_suffix(F.col("content_type"), F.col("url")))
    return v.select("page_id", "suffix", F.concat(F.lit("raw/"), ingest.content_hash(F.col("html")), "suffix").alias("raw_file_path"))


@query(
    f"""SELECT page_id, coalesce(content_type, 'application/octet-stream') AS content_type, coalesce(final_url, url) AS final_url,
  '{{"response_headers":"{{\\"last-modified\\":' || coalesce('\\"' || last_modified || '\\"', 'null') || '}}"}}' AS metadata, CASE
  WHEN NOT coalesce(regexp_matches(url, '\\Ahttps?://'), false) THEN 'Only public HTTP(S) URLs are supported'
  WHEN NOT coalesce(http_status BETWEEN 200 AND 299, false) THEN 'HTTP status ' || coalesce(CAST(http_status AS VARCHAR), 'missing')
  WHEN strlen(html) > {MAX_BYTES} THEN 'Download exceeds configured size limit' END AS error FROM ({V["CRAWL"]})"""
)
def q_crawl_gate(spark: SparkSession, d: str) -> DataFrame:
    return registry.crawl_rows(views.view(spark, d, views.CRAWL)).select("page_id", "content_type", "final_url", F.to_json("metadata").alias("metadata"), "error")


@query(
    f"""SELECT id, name, true AS enabled, CASE WHEN NOT coalesce(length(name) BETWEEN 1 AND 255, false) THEN 'name must have 1 to 255 characters'
  WHEN NOT regexp_matches(base_url, '(?i)^https?://[^/?#]+') THEN 'base_url must be an HTTP(S) URL' WHEN source_type = 'blog' THEN 'source_type is unknown'
  WHEN rate_limit_seconds < 0 THEN 'rate_limit_seconds must not be negative' WHEN rate_limit_seconds > 3600 THEN 'rate_limit_seconds must be at most 3600' END AS error FROM ({V["SOURCES"]})"""
)
def q_source_register(spark: SparkSession, d: str) -> DataFrame:
    return registry.register(views.view(spark, d, views.SOURCES)).select("id", "name", "enabled", "error")


@query(f"SELECT id, name, base_url, publisher, source_type, true AS enabled, rate_limit_seconds FROM ({V['SOURCES']}) WHERE rate_limit_seconds >= 0 AND base_url IS NOT NULL ORDER BY id")
def q_source_list(spark: SparkSession, d: str) -> DataFrame:
    return registry.list_sources(registry.register(views.view(spark, d, views.SOURCES), strict=False).where("error is null"))


# Parsing


def _duck_without(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', chr(10), 'g')"
    for tag in html.DROPPED:
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', chr(10), 'g')"
    return x


def _duck_decode(x: str) -> str:
    for name, character in REFERENCES:
        if name == "&amp;":
            x = f"regexp_replace({x}, '&#0*39;|&#x0*27;', '''', 'g')"
            x = f"regexp_replace({x}, '&#0*160;|&#x0*[aA]0;', chr(160), 'g')"
        x = f"replace({x}, '{name}', {'chr(160)' if name == '&nbsp;' else repr(character) if character != chr(39) else chr(39) * 4})"
    return x


_ROOT = "CASE " + " ".join(rf"WHEN regexp_matches(p, '(?is)<{t}\b') THEN regexp_extract(p, '(?is)<{t}\b[^>]*>(.*?)(?:</{t}\s*>|\z)', 1)" for t in ("main", "article", "body")) + " ELSE p END"


@query(rf"""WITH w AS (SELECT page_id, html, {_duck_without("html")} AS p FROM pages)
SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title\b') THEN regexp_replace({_duck_decode(r"regexp_extract(p, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)")}, {_STRIP}) ELSE 'stem' END AS title FROM w""")
def q_html_title(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", html.html_title(F.col("html"), F.lit("stem")).alias("title"))


@query(f"""WITH w AS (SELECT page_id, {_duck_without("html")} AS p FROM pages), r AS (SELECT page_id, {_ROOT} AS r FROM w)
SELECT page_id, array_to_string({_lines(_duck_decode("regexp_replace(r, '(?s)<[^>]*>', chr(10), 'g')"))}, chr(10)) AS text FROM r""")
def q_html_text(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", html.html_text(F.col("html")).alias("text"))


_ASSEMBLED = f"""WITH p AS (SELECT doc, page_number, image_count, regexp_replace(coalesce(text, ''), {_STRIP}) AS text FROM ({V["PAGES"]})),
a AS (SELECT doc, count(*) AS n_pages, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_number) FILTER (text <> ''), '') AS plain_text, max(image_count) > 0 AS img FROM p GROUP BY doc)"""


@query(f"{_ASSEMBLED} SELECT doc, n_pages, plain_text FROM a")
def q_page_assembly(spark: SparkSession, d: str) -> DataFrame:
    made = assemble.from_pages(views.view(spark, d, views.PAGES))
    return made.select("doc", F.size("pages").cast("bigint").alias("n_pages"), "plain_text")


@query(
    f"{_ASSEMBLED} SELECT doc, img AND length(regexp_replace(plain_text, {_STRIP})) < greatest(20, 10 * n_pages) AS requires_ocr, "
    f"CASE WHEN img AND length(regexp_replace(plain_text, {_STRIP})) < greatest(20, 10 * n_pages) THEN 'suspected_scanned_pdf' ELSE '' END AS warning FROM a"
)
def q_ocr_flag(spark: SparkSession, d: str) -> DataFrame:
    made = assemble.from_pages(views.view(spark, d, views.PAGES))
    return made.select("doc", "requires_ocr", F.array_join("warnings", ",").alias("warning"))


@query(f"""WITH p AS (SELECT doc, idx, coalesce(style, '') AS style, stem, regexp_replace(coalesce(text, ''), {_STRIP}) AS text FROM ({V["PARAGRAPHS"]})),
k AS (SELECT * FROM p WHERE text <> '')
SELECT doc, coalesce(min_by(text, idx) FILTER (style = 'Title' OR style LIKE '标题%'), any_value(stem)) AS title,
  coalesce(string_agg(CAST(idx AS VARCHAR) || ':' || text, chr(10) ORDER BY idx) FILTER (style LIKE 'Heading%' OR style LIKE '标题%'), '') AS headings,
  string_agg(text, chr(10) ORDER BY idx) AS plain_text FROM k GROUP BY doc""")
def q_paragraph_assembly(spark: SparkSession, d: str) -> DataFrame:
    made = assemble.from_paragraphs(views.view(spark, d, views.PARAGRAPHS))
    named = F.transform("headings", lambda h: F.concat_ws(":", h["idx"].cast("string"), h["text"]))
    return made.select("doc", "title", F.array_join(named, "\n").alias("headings"), "plain_text")


_CHUNKS = f"""WITH RECURSIVE arr AS (SELECT doc_id AS d, {_lines("coalesce(text, '')")} AS ls FROM documents),
li AS (SELECT d, unnest(ls) AS t, generate_subscripts(ls, 1) AS i FROM arr),
pieces AS (SELECT d, row_number() OVER (PARTITION BY d ORDER BY i, k) AS n, substring(t, k * 1200 + 1, 1200) AS t, length(t) > 1200 AS long
  FROM (SELECT d, i, t, unnest(range(0, (length(t) - 1) // 1200 + 1)) AS k FROM li)),
walk AS (SELECT d, n, CASE WHEN long THEN 0 ELSE length(t) END AS used, 0 AS c FROM pieces WHERE n = 1
  UNION ALL SELECT p.d, p.n, CASE WHEN p.long THEN 0 WHEN w.used > 0 AND w.used + 1 + length(p.t) <= 1200 THEN w.used + 1 + length(p.t) ELSE length(p.t) END,
    CASE WHEN NOT p.long AND w.used > 0 AND w.used + 1 + length(p.t) <= 1200 THEN w.c ELSE w.c + 1 END
  FROM walk w JOIN pieces p ON p.d = w.d AND p.n = w.n + 1),
chunks AS (SELECT d, c, string_agg(t, chr(10) ORDER BY n) AS text FROM walk JOIN pieces USING (d, n) GROUP BY d, c)"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    return chunk.chunks(docs.select(F.col("doc_id").alias("document_id"), text.alias("plain_text"), F.array(F.struct(F.lit(1).alias("page_number"), text.alias("text"))).alias("pages")))


@query(f"{_CHUNKS} SELECT d AS document_id, c AS chunk_index, length(text) AS n_chars, sha256(text) AS sha256 FROM chunks")
def q_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("document_id", "chunk_index", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


@query(f"""{_CHUNKS},
spans AS (SELECT h.d, h.c, CASE WHEN strpos(t.text, h.text) > 0 THEN strpos(t.text, h.text) - 1 ELSE 0 END AS s, strpos(t.text, h.text) > 0 AS exact, length(h.text) AS n
    FROM chunks h JOIN documents t ON t.doc_id = h.d WHERE h.c = 0
  UNION ALL SELECT h.d, h.c, CASE WHEN strpos(substring(t.text, p.s + p.n + 1), h.text) > 0 THEN p.s + p.n + strpos(substring(t.text, p.s + p.n + 1), h.text) - 1 ELSE p.s + p.n END,
    strpos(substring(t.text, p.s + p.n + 1), h.text) > 0, length(h.text)
  FROM spans p JOIN chunks h ON h.d = p.d AND h.c = p.c + 1 JOIN documents t ON t.doc_id = h.d)
SELECT d AS document_id, c AS chunk_index, s AS start_offset, s + n AS end_offset, exact FROM spans""")
def q_chunk_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("document_id", "chunk_index", "start_offset", "end_offset", "exact")


@query(f"""{_CHUNKS}, old AS (SELECT doc_id, i FROM documents, range(0, 3) AS r(i))
SELECT document_id, count(*) AS n_chunks FROM (SELECT d AS document_id FROM chunks WHERE d % 4 <> 0 UNION ALL SELECT doc_id FROM old WHERE doc_id % 4 = 0) GROUP BY document_id""")
def q_chunk_replace(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("document_id"))
    old = docs.select("document_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("chunk_index"), F.lit("old").alias("text"))
    parsed = docs.where("document_id % 4 <> 0")
    new = _chunks(spark, d).where("document_id % 4 <> 0").select("document_id", "chunk_index", "text")
    return chunk.replace_chunks(old, parsed, new).groupBy("document_id").agg(F.count("*").alias("n_chunks"))


@query(f"""{_CHUNKS}, old AS (SELECT doc_id, i FROM documents, range(0, 3) AS r(i))
SELECT document_id, count(*) AS n_chunks FROM (SELECT d AS document_id FROM chunks WHERE d % 4 = 1 UNION ALL SELECT doc_id FROM old WHERE doc_id % 4 <> 1) GROUP BY document_id""")
def q_chunk_write_back(spark: SparkSession, d: str) -> DataFrame:
    """A stored table of chunks; those of the documents that were parsed again are replaced in their folders."""
    docs, path = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("document_id")), _fresh(spark)
    tables.write_table(docs.select("document_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("chunk_index"), F.lit("old").alias("text")), path, "document_id", 16)
    new = _chunks(spark, d).where("document_id % 4 = 1").select("document_id", "chunk_index", "text")
    tables.replace_rows(docs.where("document_id % 4 = 1"), new, path, "document_id", 16)
    return tables.read_table(spark, path).groupBy("document_id").agg(F.count("*").alias("n_chunks"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_pending(_docs(spark, d).withColumn("content", F.coalesce("raw_text", F.lit("")).cast("binary")))


_PENDING = r"""p AS (SELECT id, raw_text, source_title, lower(regexp_extract(raw_file_path, '[^/.][^/]*?(\.[^./]+)$', 1)) AS ending FROM docs WHERE parse_status = 'pending')"""


@query(
    f"WITH {_DOCS}, {_PENDING} SELECT id, source_title AS title, CASE WHEN ending IN ('.html', '.txt') THEN 'parsed' ELSE 'pending' END AS parse_status, "
    "CASE WHEN ending IN ('.html', '.txt') THEN 'parsed' END AS to_status, CASE WHEN ending = '.txt' THEN length(raw_text) ELSE 0 END AS n_text_chars FROM p"
)
def q_parse_state(spark: SparkSession, d: str) -> DataFrame:
    made = parse.parsed_state(_parsed(spark, d))
    return made.select("id", "title", "parse_status", "to_status", F.when(F.col("raw_file_path").endswith(".TXT"), F.length("plain_text")).otherwise(0).cast("bigint").alias("n_text_chars"))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'content is not valid UTF-8' END AS error, CASE WHEN doc_id % 7 <> 0 THEN sha256(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) END AS sha256 FROM documents""")
def q_text_decode(spark: SparkSession, d: str) -> DataFrame:
    """Bytes with a byte order mark, with line ends of two other kinds, and with an invalid byte at the end."""
    docs, text = _docs(spark, d), F.coalesce("raw_text", F.lit(""))
    ends = F.when(F.col("id") % 2 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(F.replace(text, F.lit("\n"), F.lit("\r")))
    content = F.concat(F.when(F.col("id") % 3 == 0, "\ufeff").otherwise("").cast("binary"), ends.cast("binary"), F.when(F.col("id") % 7 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    made = parse.parse_pending(docs.withColumns({"content": content, "raw_file_path": F.lit("x.txt"), "parse_status": F.lit("pending")}))
    return made.select("id", "error", F.sha2("plain_text", 256).alias("sha256"))


@query(f"WITH {_DOCS}, {_PENDING} SELECT id, CAST(id AS VARCHAR) || ': Unsupported document type: ' || ending AS message FROM p WHERE ending NOT IN ('.html', '.txt')")
def q_parse_errors(spark: SparkSession, d: str) -> DataFrame:
    return parse.errors(_parsed(spark, d))


@query(f"WITH {_DOCS}, {_PENDING} SELECT count(*) FILTER (ending IN ('.html', '.txt')) AS parsed, count(*) FILTER (ending NOT IN ('.html', '.txt')) AS failed FROM p")
def q_parse_report(spark: SparkSession, d: str) -> DataFrame:
    return parse.report(_parsed(spark, d))


# Validation

_ONE = f"""{_DOCS}, records AS ({V["RECORDS"]}),
one AS (SELECT document_id, data_type, min(id) AS rid, min_by(source_quote, id) AS quote, arg_min_null(disclosed, id) AS disclosed, min_by(wording, id) AS wording FROM records GROUP BY document_id, data_type),
j AS (SELECT d.*, o.rid, o.quote, o.disclosed, o.wording, count(*) OVER (PARTITION BY d.sha256) AS hash_count FROM docs d LEFT JOIN one o ON o.document_id = d.id AND o.data_type = d.data_type)"""
_CODES = {
    "required": "concat_ws(',', CASE WHEN coalesce(raw_text, '') = '' THEN 'required:raw_text' END, CASE WHEN raw_file_path = '' THEN 'required:raw_file_path' END)",
    "source_url": "CASE WHEN local_source OR coalesce(source_url, '') LIKE 'file://%' OR regexp_matches(coalesce(source_url, ''), '(?i)^https?://[^/?#]+') THEN '' ELSE 'invalid_source:source_url' END",
    "duplicate_hash": "CASE WHEN hash_count > 1 THEN 'duplicate_hash:sha256' ELSE '' END",
    "source_quote": "CASE WHEN rid IS NULL THEN '' WHEN quote = '' THEN 'missing_quote' WHEN raw_text <> '' AND NOT contains(raw_text, quote) THEN 'quote_not_found' ELSE '' END",
    "authenticity": "CASE WHEN rid IS NULL AND authenticity_type = 'constructed_for_evaluation' THEN 'constructed_wrong_type:authenticity_type' ELSE '' END",
    "original_wording": "CASE WHEN rid IS NOT NULL AND data_type = 'penalty' AND NOT coalesce(disclosed, false) AND wording <> '' THEN 'fabricated_wording:original_sales_wording' ELSE '' END",
}


def _codes(column: str = "issues"):
    return F.array_join(F.transform(column, lambda i: F.concat_ws(":", i["code"], i["field"])), ",")


def _rule_query(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = validate.with_record(validate.with_hash_count(_docs(spark, d)), _records(spark, d))
        found = F.filter(F.array(*validate.RULES[name](False)), lambda x: x.isNotNull())
        return rows.select("id", found.alias("issues")).select("id", _codes().alias("issues"))

    run.__name__ = f"q_rule_{name}"
    query(f"WITH {_ONE} SELECT id, {_CODES[name]} AS issues FROM j")(run)


for _name in _CODES:
    _rule_query(_name)


@query(f"WITH {_DOCS}, r AS (SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN '2024-02-' || lpad(CAST(id % 31 + 1 AS VARCHAR), 2, '0') ELSE 'soon' END AS decision_date FROM docs) SELECT id, CASE WHEN decision_date IS NOT NULL AND try_cast(decision_date AS DATE) IS NULL THEN 'decision_date is invalid' END AS message FROM r")
def q_rule_date(spark: SparkSession, d: str) -> DataFrame:
    day = F.concat(F.lit("2024-02-"), F.lpad((F.col("id") % 31 + 1).cast("string"), 2, "0"))
    rows = _docs(spark, d).withColumn("decision_date", F.when(F.col("id") % 3 == 1, day).when(F.col("id") % 3 == 2, "soon"))
    return rows.select("id", validate.bad_date("decision_date")["message"].alias("message"))


_ISSUES = f"concat_ws(',', {', '.join(f'nullif({c}, {chr(39) * 2})' for c in _CODES.values())})"


@query(f"WITH {_ONE}, v AS (SELECT id, {_ISSUES} AS issues FROM j WHERE final_review_status = 'parsed') SELECT id, issues, CASE WHEN issues = '' THEN 'pending_review' ELSE 'auto_validation_failed' END AS to_status FROM v")
def q_validate(spark: SparkSession, d: str) -> DataFrame:
    return validate.validate(_docs(spark, d), _records(spark, d)).select("id", _codes().alias("issues"), "to_status")


@query(f"WITH {_ONE}, v AS (SELECT {_ISSUES} AS issues FROM j WHERE final_review_status = 'parsed') SELECT count(*) FILTER (issues = '') AS passed, count(*) FILTER (issues <> '') AS failed FROM v")
def q_validate_summary(spark: SparkSession, d: str) -> DataFrame:
    return validate.summary(validate.validate(_docs(spark, d), _records(spark, d)))


@query("""SELECT b.item_id, d.doc_id AS document_id, CAST(strpos(d.text, b.text) - 1 AS INTEGER) AS start, CAST(len(string_split(d.text, b.text)) - 1 AS BIGINT) AS n_places
FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''""")
def q_quote_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark passage in every document."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("raw_text"))
    return quote_scan.quote_scan(docs, spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text"))


# Review


def _issue_json(code: str, message: str, validator: str, field: str | None) -> str:
    return f'{{"validator":"{validator}","code":"{code}","message":"{message}","field":{"null" if field is None else f'"{field}"'}}}'


#: An issue's code as _CODES lists it -> its JSON
_AS_JSON = {
    "required:raw_text": _issue_json("required", "raw_text is required", "RequiredFieldValidator", "raw_text"),
    "required:raw_file_path": _issue_json("required", "raw_file_path is required", "RequiredFieldValidator", "raw_file_path"),
    "invalid_source:source_url": _issue_json("invalid_source", "Public data requires a valid HTTP(S) URL or explicit local source", "SourceUrlValidator", "source_url"),
    "duplicate_hash:sha256": _issue_json("duplicate_hash", "Duplicate SHA-256 detected", "HashDuplicateValidator", "sha256"),
    "missing_quote": _issue_json("missing_quote", "Key extraction requires source_quote", "SourceQuoteValidator", None),
    "quote_not_found": _issue_json("quote_not_found", "source_quote is not present in immutable raw text", "SourceQuoteValidator", None),
    "constructed_wrong_type:authenticity_type": _issue_json("constructed_wrong_type", "constructed_for_evaluation is restricted to evaluation_sample", "AuthenticityValidator", "authenticity_type"),
    "fabricated_wording:original_sales_wording": _issue_json("fabricated_wording", "original_sales_wording must be empty when the source did not disclose it", "OriginalWordingValidator", "original_sales_wording"),
}
_ISSUE_OF = "CASE i " + " ".join(f"WHEN '{code}' THEN '{text}'" for code, text in _AS_JSON.items()) + " END"
_OUTCOME = f"""'{{"valid":' || CASE WHEN issues = '' THEN 'true' ELSE 'false' END || ',"issues":[' || CASE WHEN issues = '' THEN '' ELSE array_to_string([{_ISSUE_OF} FOR i IN string_split(issues, ',')], ',') END || ']}}'"""


@query(f"WITH {_ONE}, v AS (SELECT id, {_ISSUES} AS issues FROM j WHERE final_review_status = 'parsed') SELECT id, {_OUTCOME} AS automatic_validation FROM v")
def q_automatic_validation(spark: SparkSession, d: str) -> DataFrame:
    """What validation leaves in the documents' metadata."""
    checked = validate.validate(_docs(spark, d), _records(spark, d))
    return checked.select("id", F.element_at("metadata", F.lit(AUTOMATIC)).alias("automatic_validation"))


@query(f"""WITH {_ONE}, v AS (SELECT *, {_ISSUES} AS issues FROM j WHERE final_review_status IN ('parsed', 'pending_review') AND data_type = 'penalty')
SELECT id AS record_id, source_url, source_title, substring(coalesce(raw_text, ''), 1, 500) AS raw_text_summary, '{{}}' AS parsed_fields, coalesce(substring(raw_text, 1, 20), '') AS quotes,
  CASE WHEN final_review_status = 'parsed' THEN {_OUTCOME} ELSE '{{}}' END AS automatic_validation, 'pending_review' AS current_status
FROM v WHERE issues = '' OR final_review_status = 'pending_review'""")
def q_review_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents that validation has just sent to review, and those that wait there already; their quotes are in the metadata."""
    docs = _docs(spark, d)
    quotes = F.to_json(F.array(F.coalesce(F.substring("raw_text", 1, 20), F.lit(""))))
    docs = docs.withColumn("metadata", F.create_map(F.lit(QUOTES), quotes))
    checked = validate.validate(docs, _records(spark, d)).withColumn("final_review_status", F.col("to_status")).select(*docs.columns)
    rows = review.document_rows(review.pending(checked.unionByName(docs.where("final_review_status = 'pending_review'")), "penalty"))
    return rows.select("record_id", "source_url", "source_title", "raw_text_summary", "parsed_fields", F.array_join("source_quotes", ",").alias("quotes"), "automatic_validation", "current_status")


@query(f"""SELECT id AS record_id, 'evaluation_sample' AS record_type, substring(sample_text, 1, 500) AS raw_text_summary, '[]' AS source_quotes,
  '{{"sample_category":"' || sample_category || '","risk_labels":["demo"],"expected_evidence":{{}},"construction_basis":"built","split":"train"}}' AS parsed_fields FROM ({V["SAMPLES"]}) WHERE final_review_status = 'pending_review'""")
def q_review_flat(spark: SparkSession, d: str) -> DataFrame:
    samples = views.view(spark, d, views.SAMPLES).withColumns({"risk_labels": F.array(F.lit("demo")), "expected_evidence": F.create_map().cast("map<string,string>")})
    rows = files.flat(review.sample_rows(samples.where("final_review_status = 'pending_review'")))
    return rows.select("record_id", "record_type", "raw_text_summary", "source_quotes", "parsed_fields")


@query(f"WITH {_DOCS} SELECT CAST(1 AS BIGINT) AS id, 'penalty-20240229000000' AS batch_name, 'penalty' AS data_type, CAST(count(*) AS INTEGER) AS record_count, 'out' AS export_path, 'exported' AS status FROM docs WHERE final_review_status = 'pending_review' AND data_type = 'penalty'")
def q_batch(spark: SparkSession, d: str) -> DataFrame:
    return review.batch(review.pending(_docs(spark, d), "penalty"), 1, "penalty", "20240229000000", "out")


_TYPE = "CASE {0} % 3 WHEN 0 THEN 'regulation' WHEN 1 THEN 'penalty' ELSE 'product_document' END"
_quoted = lambda names: ", ".join(f"'{n}'" for n in names)
_MATCHED = f"""{_DOCS}, dec AS ({V["DECISIONS"]}), k AS (SELECT line_no, line, CASE WHEN json_valid(line) THEN line END AS j FROM dec WHERE regexp_replace(line, {_STRIP}) <> ''),
f AS (SELECT line_no, j, json_type(j) = 'OBJECT' AS obj, json_keys(CASE WHEN json_type(j) = 'OBJECT' THEN j ELSE '{{}}' END) AS ks, j ->> '$.record_id' AS rid, j ->> '$.record_type' AS record_type, j ->> '$.final_status' AS fs, j ->> '$.evidence_quality' AS eq, json_extract(j, '$.corrections') AS co FROM k),
e AS (SELECT *, CASE WHEN regexp_full_match(rid, '[+-]?[0-9]+') THEN CAST(rid AS BIGINT) END AS record_id, co IS NULL AS none,
  array_to_string([x FOR x IN ['evidence_quality', 'final_status', 'record_id', 'record_type', 'reviewer'] IF NOT list_contains(ks, x)], ', ') AS missing FROM f),
c AS (SELECT e.*, d.id, d.final_review_status AS current_status, CASE WHEN j IS NULL THEN 'invalid JSON' WHEN NOT obj THEN 'payload must be an object' WHEN missing <> '' THEN 'Missing fields: ' || missing
  WHEN e.record_id IS NULL THEN 'record_id must be an integer' WHEN fs NOT IN ({_quoted(DECIDABLE)}) THEN 'Illegal final_status: ' || fs WHEN eq NOT IN ('A', 'B', 'C', 'D') THEN 'evidence_quality must be A, B, C, or D'
  WHEN fs = 'approved_with_revision' AND none THEN 'approved_with_revision requires corrections' WHEN NOT none AND json_type(co) <> 'OBJECT' THEN 'corrections must be an object'
  WHEN d.id IS NULL THEN 'record_id and record_type do not identify a document' END AS error FROM e LEFT JOIN docs d ON d.id = e.record_id AND d.data_type = e.record_type)"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return review.match_decisions(review.parse_decisions(views.view(spark, d, views.DECISIONS)), _docs(spark, d))


@query(f"WITH {_MATCHED} SELECT line_no, 'line ' || CAST(line_no AS VARCHAR) || ': ' || error AS message FROM c WHERE error IS NOT NULL")
def q_decision_errors(spark: SparkSession, d: str) -> DataFrame:
    return review.import_errors(_matched(spark, d)).select("line_no", "message")


@query(f"WITH {_MATCHED} SELECT count(*) FILTER (error IS NULL) AS imported, count(*) FILTER (error IS NOT NULL) AS failed FROM c")
def q_import_summary(spark: SparkSession, d: str) -> DataFrame:
    return review.import_summary(_matched(spark, d))


_LATEST = """u AS (SELECT record_id, line_no, unnest(json_keys(co)) AS k, co FROM c WHERE error IS NULL AND NOT none),
l AS (SELECT record_id, k, max_by(CAST(json_extract(co, '$.' || k) AS VARCHAR), line_no) AS v FROM u GROUP BY record_id, k)"""
_NEW = lambda c: f"CASE WHEN r.id <> f.first OR m.{c} IS NULL THEN r.{c} ELSE m.{c} ->> '$' END AS {c}"


@query(f"""WITH {_MATCHED}, {_LATEST},
m AS (SELECT record_id, {", ".join(f"max(v) FILTER (k = '{c}') AS {c}" for c in ("article", "wording", "disclosed"))} FROM l GROUP BY record_id)
SELECT r.id, r.document_id, {_NEW("article")}, {_NEW("wording")}, CASE WHEN r.id <> f.first OR m.disclosed IS NULL THEN r.disclosed WHEN m.disclosed = 'null' THEN NULL WHEN m.disclosed = 'true' THEN true ELSE false END AS disclosed, r.source_quote
FROM ({V["RECORDS"]}) r JOIN (SELECT document_id, data_type, min(id) AS first FROM ({V["RECORDS"]}) GROUP BY document_id, data_type) f USING (document_id, data_type)
LEFT JOIN m ON m.record_id = r.document_id AND r.data_type = {_TYPE.format("r.document_id")}""")
def q_corrections(spark: SparkSession, d: str) -> DataFrame:
    return review.correct_records(_records(spark, d), review.merged(_matched(spark, d))).select("id", "document_id", "article", "wording", "disclosed", "source_quote")


def _with_fields(docs: DataFrame) -> DataFrame:
    """Documents with corrections of an earlier import."""
    kept = F.create_map(F.lit("article"), F.parse_json(F.lit('"old"')), F.lit("kept"), F.col("id").cast("variant"))
    return docs.withColumn("corrected_fields", F.when(F.col("id") % 3 < 2, kept))


@query(f"""WITH {_MATCHED}, {_LATEST}, decided AS (SELECT DISTINCT record_id FROM c WHERE error IS NULL),
o AS (SELECT record_id, unnest(['article', 'kept']) AS k, unnest(['"old"', CAST(record_id AS VARCHAR)]) AS v FROM decided WHERE record_id % 3 < 2),
a AS (SELECT * FROM l UNION ALL SELECT * FROM o ANTI JOIN l USING (record_id, k))
SELECT record_id, coalesce(string_agg(k || '=' || v, ',' ORDER BY k), '') AS corrected_fields FROM decided LEFT JOIN a USING (record_id) GROUP BY record_id""")
def q_corrected_fields(spark: SparkSession, d: str) -> DataFrame:
    matched = review.match_decisions(review.parse_decisions(views.view(spark, d, views.DECISIONS)), _with_fields(_docs(spark, d)))
    entries = F.transform(F.array_sort(F.map_entries(F.transform_values("corrected_fields", lambda k, v: F.to_json(v)))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return review.merged(matched).select("record_id", F.array_join(entries, ",").alias("corrected_fields"))


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Samples, and decisions in which documents and samples have the same ids."""
    samples = views.view(spark, d, views.SAMPLES).withColumn("risk_labels", F.array(F.lit("demo")))
    lines = review.parse_decisions(views.view(spark, d, views.BOTH_DECISIONS))
    return samples, review.match_decisions(lines, _docs(spark, d), samples)


@query(f"""SELECT s.id, CASE WHEN l.doc_id IS NULL THEN s.split ELSE 'test' END AS split, s.authenticity_type, CASE WHEN l.doc_id IS NULL THEN s.final_review_status ELSE 'rejected' END AS final_review_status,
  CASE WHEN l.doc_id IS NULL THEN s.sample_category END AS sample_category, CASE WHEN l.doc_id IS NULL THEN 'demo' ELSE 'x,y' END AS risk_labels, CASE WHEN l.doc_id IS NOT NULL THEN 'indexed' END AS from_status FROM ({V["SAMPLES"]}) s LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = s.id""")
def q_sample_corrections(spark: SparkSession, d: str) -> DataFrame:
    samples, matched = _both(spark, d)
    made = review.correct_samples(samples, review.merged(matched)).withColumn("risk_labels", F.array_join("risk_labels", ","))
    return made.select("id", "split", "authenticity_type", "final_review_status", "sample_category", "risk_labels", "from_status")


@query(f"""SELECT l.n AS line_no, CASE WHEN l.n % 2 = 1 THEN 'evaluation_sample' ELSE d.data_type END AS record_type, l.doc_id AS record_id, CASE WHEN l.n % 2 = 1 THEN 'indexed' ELSE d.final_review_status END AS from_status,
  CASE WHEN l.n % 2 = 1 THEN 'rejected' ELSE 'approved' END AS to_status FROM (SELECT doc_id, doc_id * 2 + unnest([0, 1]) AS n FROM labels) l JOIN ({V["DOCS"]}) d ON d.id = l.doc_id""")
def q_sample_history(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds' transitions; a sample's corrections have set its state before the decision does."""
    return review.decision_history(_both(spark, d)[1]).select("line_no", "record_type", "record_id", "from_status", "to_status")


@query(f"""SELECT r.id, r.document_id, CASE WHEN l.doc_id IS NOT NULL AND r.id = f.first AND r.data_type = {_TYPE.format("r.document_id")} THEN 'of the document' ELSE r.article END AS article, CASE WHEN l.doc_id IS NOT NULL AND r.id = f.first AND r.data_type = {_TYPE.format("r.document_id")} THEN '7' ELSE r.wording END AS wording,
  CASE WHEN l.doc_id IS NOT NULL AND r.id = f.first AND r.data_type = {_TYPE.format("r.document_id")} THEN NULL ELSE r.disclosed END AS disclosed, r.source_quote
FROM ({V["RECORDS"]}) r JOIN (SELECT document_id, data_type, min(id) AS first FROM ({V["RECORDS"]}) GROUP BY document_id, data_type) f USING (document_id, data_type)
LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = r.document_id""")
def q_record_corrections(spark: SparkSession, d: str) -> DataFrame:
    """The document's decision reaches its record, that of the sample with the same id does not."""
    return review.correct_records(_records(spark, d), review.merged(_both(spark, d)[1])).select("id", "document_id", "article", "wording", "disclosed", "source_quote")


@query(f"WITH {_MATCHED} SELECT record_type, record_id, max_by(fs, line_no) AS final_status, count(*) AS n_decisions FROM c WHERE error IS NULL GROUP BY record_type, record_id")
def q_decision_apply(spark: SparkSession, d: str) -> DataFrame:
    return review.merged(_matched(spark, d)).select("record_type", "record_id", "final_status", "n_decisions")


@query(f"WITH {_MATCHED} SELECT line_no, record_type, record_id, fs AS decision, eq AS evidence_quality, CAST(j ->> '$.reviewer' AS VARCHAR) AS reviewer FROM c WHERE error IS NULL")
def q_decision_log(spark: SparkSession, d: str) -> DataFrame:
    return review.decision_log(_matched(spark, d)).select("line_no", "record_type", "record_id", "decision", "evidence_quality", "reviewer")


@query(f"WITH {_MATCHED} SELECT line_no, record_id, coalesce(lag(fs) OVER (PARTITION BY record_type, record_id ORDER BY line_no), current_status) AS from_status, fs AS to_status FROM c WHERE error IS NULL")
def q_decision_history(spark: SparkSession, d: str) -> DataFrame:
    return review.decision_history(_matched(spark, d)).select("line_no", "record_id", "from_status", "to_status")


# Index, history, reads, seeding

_ELIGIBLE = f"final_review_status IN ({_quoted(APPROVED)}) AND authenticity_type NOT IN ('demo_only', 'pending_verification') AND knowledge_index_status <> 'indexed'"


@query(f"WITH {_DOCS} SELECT id, CASE WHEN {_ELIGIBLE} THEN 'indexed' ELSE final_review_status END AS final_review_status, CASE WHEN {_ELIGIBLE} THEN 'indexed' ELSE knowledge_index_status END AS knowledge_index_status, CASE WHEN {_ELIGIBLE} THEN final_review_status END AS from_status FROM docs")
def q_index_gate(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).withColumn("indexed_at", F.lit(None).cast("timestamp"))
    return index.mark_indexed(docs, "2024-02-29 00:00:00").select("id", "final_review_status", "knowledge_index_status", "from_status")


@query(f"WITH {_DOCS} SELECT count(*) FILTER ({_ELIGIBLE} AND authenticity_type = 'verified_public') AS indexed FROM docs")
def q_index_count(spark: SparkSession, d: str) -> DataFrame:
    return index.indexed_count(_docs(spark, d), strict=True)


@query(f"SELECT record_id, event_id, lag(to_status) OVER (PARTITION BY record_id ORDER BY ts, event_id) AS from_status, to_status FROM ({V['TRANSITIONS']})")
def q_history(spark: SparkSession, d: str) -> DataFrame:
    rows = views.view(spark, d, views.TRANSITIONS).withColumn("seq", F.struct("ts", "event_id"))
    return ingest.transitions(rows).select("record_id", "event_id", "from_status", "to_status")


@query(f"""WITH t AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE record_id END AS record_id, ts, event_id, to_status FROM ({V['TRANSITIONS']}))
SELECT record_id, event_id, lag(to_status) OVER (PARTITION BY record_id ORDER BY ts, event_id) AS from_status, to_status FROM t""")
def q_history_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A record with a third of all rows, over ranges of them."""
    rows = views.view(spark, d, views.TRANSITIONS).withColumns({"record_id": F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("record_id")), "seq": F.struct("ts", "event_id")})
    return ingest.transitions(rows, most_rows=300).select("record_id", "event_id", "from_status", "to_status")


@query(f"WITH {_DOCS} SELECT id, CASE WHEN {_ELIGIBLE} THEN 'indexed' ELSE final_review_status END AS final_review_status, CASE WHEN {_ELIGIBLE} THEN 'indexed' ELSE knowledge_index_status END AS knowledge_index_status, CASE WHEN {_ELIGIBLE} THEN '{_AS_OF}' END AS indexed_at FROM docs")
def q_index_write_back(spark: SparkSession, d: str) -> DataFrame:
    """A stored table of documents in which the eligible ones are marked, in their folders."""
    docs, path = _docs(spark, d).withColumn("indexed_at", F.lit(None).cast("timestamp")), _fresh(spark)
    tables.write_table(docs, path, "id", 16)
    index.write_indexed(spark, path, _AS_OF, parts=16)
    return tables.read_table(spark, path).select("id", "final_review_status", "knowledge_index_status", F.col("indexed_at").cast("string").alias("indexed_at"))


@query(
    f"WITH {_DOCS}, e AS (SELECT *, lower(regexp_extract(raw_file_path, '[^/.][^/]*?(\\.[^./]+)$', 1)) AS ending FROM docs) SELECT id, source_title, CASE WHEN parse_status = 'pending' AND ending IN ('.html', '.txt') THEN 'parsed' ELSE parse_status END AS parse_status, "
    "CASE WHEN parse_status = 'pending' AND ending IN ('.html', '.txt') THEN 'parsed' ELSE final_review_status END AS final_review_status, parse_status = 'pending' AND ending IN ('.html', '.txt') AS has_report FROM e"
)
def q_state_write_back(spark: SparkSession, d: str) -> DataFrame:
    """A stored table of documents in which the parsed ones have their next state."""
    docs = _docs(spark, d).withColumns({"content": F.coalesce("raw_text", F.lit("")).cast("binary"), "metadata": F.create_map().cast("map<string,string>")})
    path = _fresh(spark)
    tables.write_table(docs, path, "id", 16)
    parse.parse_stored(spark, path, _AS_OF)
    return tables.read_table(spark, path).select("id", "source_title", "parse_status", "final_review_status", F.map_contains_key("metadata", "parsing").alias("has_report"))


_VIEW = "id, data_type, source_url, source_title, authenticity_type, final_review_status, knowledge_index_status"
_FIELDS = """CASE WHEN id % 3 < 2 THEN '{{"article":"old","kept":' || CAST(id AS VARCHAR) || '}}' ELSE '{{}}' END AS corrected_fields"""


@query(f"WITH {_DOCS} SELECT {_VIEW}, {_FIELDS} FROM docs WHERE final_review_status = 'approved' AND data_type = 'penalty' ORDER BY id".replace("{{", "{").replace("}}", "}"))
def q_list(spark: SparkSession, d: str) -> DataFrame:
    listed = index.list_records(index.record_view(_with_fields(_docs(spark, d))), "approved", "penalty")
    return listed.withColumn("corrected_fields", F.to_json("corrected_fields"))


@query(f"WITH {_DOCS} SELECT {_VIEW}, {_FIELDS}, raw_text, '{{}}' AS metadata FROM docs WHERE id = 100 AND data_type = 'penalty'".replace("{{", "{").replace("}}", "}"))
def q_get(spark: SparkSession, d: str) -> DataFrame:
    one = index.get_record(index.record_view(_with_fields(_docs(spark, d)), with_text=True), "penalty", 100)
    return one.withColumns({c: F.to_json(c) for c in ("corrected_fields", "metadata")})


@query(f"WITH {_DOCS} SELECT {_VIEW}, {_FIELDS}, raw_text, '{{}}' AS metadata FROM docs".replace("{{", "{").replace("}}", "}"))
def q_record_view(spark: SparkSession, d: str) -> DataFrame:
    made = index.record_view(_with_fields(_docs(spark, d)), with_text=True)
    return made.withColumns({c: F.to_json(c) for c in ("corrected_fields", "metadata")})


@query(f"""WITH {_ONE}, {_PENDING}, v AS (SELECT id, data_type, {_ISSUES} AS issues FROM j WHERE final_review_status = 'parsed'),
h AS (SELECT data_type, id, 'collected' AS f, 'collected' AS t, 'collection completed' AS r FROM (SELECT *, min(id) OVER (PARTITION BY sha256) AS first FROM docs) WHERE id = first
  UNION ALL SELECT d.data_type, p.id, d.final_review_status, 'parsed', 'parsed' FROM p JOIN docs d ON d.id = p.id WHERE ending IN ('.html', '.txt')
  UNION ALL SELECT data_type, id, 'parsed', CASE WHEN issues = '' THEN 'pending_review' ELSE 'auto_validation_failed' END, 'deterministic validation' FROM v
  UNION ALL SELECT data_type, id, final_review_status, 'indexed', 'trusted index marker' FROM docs WHERE {_ELIGIBLE})
SELECT data_type AS record_type, id AS record_id, f AS from_status, t AS to_status, r AS reason, '{_AS_OF}' AS changed_at FROM h""")
def q_transition_log(spark: SparkSession, d: str) -> DataFrame:
    """What collection, parsing, validation and indexing log."""
    docs = _docs(spark, d)
    collected = ingest.document_rows(ingest.insert_if_absent(docs.select("id", "sha256", "data_type")))
    marked = index.mark_indexed(docs.withColumn("indexed_at", F.lit(None).cast("timestamp")), _AS_OF)
    logs = [
        ingest.collection_history(collected, _AS_OF),
        ingest.history(parse.parsed_state(_parsed(spark, d)), "parsed", _AS_OF),
        ingest.history(validate.validate(docs, _records(spark, d)), "deterministic validation", _AS_OF),
        index.index_history(marked, _AS_OF),
    ]
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out.withColumn("changed_at", F.col("changed_at").cast("string"))


@query(f"WITH r AS ({V['RECORDS']}), n AS (SELECT id + 1000000 AS id, document_id FROM r WHERE document_id % 2 = 0) SELECT id, document_id FROM r WHERE document_id % 4 = 0 UNION ALL SELECT id, document_id FROM n WHERE document_id % 4 <> 0")
def q_seed_absent(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).select("id", "document_id")
    new = r.where("document_id % 2 = 0").withColumn("id", F.col("id") + 1000000)
    return index.insert_absent_records(r.where("document_id % 4 = 0"), new)


@query(f"SELECT id, sample_category, final_review_status, 'kept' AS came FROM ({V['SAMPLES']}) UNION ALL SELECT id, sample_category, final_review_status, 'new' FROM ({V['SAMPLES']})")
def q_fill_if_empty(spark: SparkSession, d: str) -> DataFrame:
    """A table with rows stays, an empty one is filled."""
    samples = views.view(spark, d, views.SAMPLES).select("id", "sample_category", "final_review_status")
    kept, new = samples.withColumn("came", F.lit("kept")), samples.withColumn("came", F.lit("new"))
    return index.fill_if_empty(kept, new).unionByName(index.fill_if_empty(kept.where("id is null"), new))


@query(f"SELECT id, sample_category, final_review_status FROM ({V['SAMPLES']})")
def q_fill_empty(spark: SparkSession, d: str) -> DataFrame:
    samples = views.view(spark, d, views.SAMPLES).select("id", "sample_category", "final_review_status")
    return index.fill_if_empty(samples.where("id < 0"), samples)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Chunks per distinct document: hash, pack, insert if absent; no text is shuffled."""
    made = _docs(spark, d).select("id", "sha256", F.size(chunk.chunk_texts(F.col("raw_text"))).alias("n_chunks"))
    return ingest.insert_if_absent(made).where("created").select("id", "sha256", "n_chunks")
