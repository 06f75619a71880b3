"""Operators on hand-made rows."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.text import strip, suffix
from tessera.operators import assemble, chunk, html, index, ingest, parse, review, validate
from tessera.sources import files, registry
from tessera.streaming.arrivals import drain_new


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_same_content_is_created_once(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b"), (4, None)], "id bigint, t string").withColumn("sha256", ingest.content_hash(F.coalesce("t", F.lit(""))))
    out = {r["id"]: (r["document_id"], r["created"]) for r in ingest.insert_if_absent(df).collect()}
    assert out == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True)}
    again = {r["id"]: (r["document_id"], r["created"]) for r in ingest.insert_if_absent(df, df.where("id = 1")).collect()}
    assert again[1] == (1, False) and again[3] == (3, True)
    assert len(ingest.document_rows(ingest.insert_if_absent(df)).collect()) == 3


def test_unicode_strip_and_suffix(spark):
    df = spark.createDataFrame([("　 a b ", "x/.y"), ("", "A.PDF"), (None, "a.b/c")], "t string, p string")
    assert values(df, strip(F.col("t")), suffix(F.col("p"))) == [("a b", ""), ("", ".pdf"), (None, "")]


HTML = [
    ("<html><head><title> 演示规则 </title><style>p{}</style></head><body><nav>导航</nav><main><p>a &amp;lt; b<!-- c -->d</p></main><article>no</article></body></html>", "演示规则", "a &lt; b\nd"),
    ("<main></main><article>full</article>", "stem", ""),
    ("plain <b>x</b> y<script>'</p>'</script>", "stem", "plain\nx\ny"),
    ("<title></title><body>t</body>", "", "t"),
    (None, None, None),
]


def test_html(spark):
    df = spark.createDataFrame([(h,) for h, _, _ in HTML], "h string")
    got = values(df, html.html_title(F.col("h"), F.lit("stem")), html.html_text(F.col("h")))
    assert got[:4] == [(t, x) for _, t, x in HTML[:4]] and got[4][1] is None


WHOLE = [
    ("<title>It&#8217;s &eacute;t&#xe9; &#x2014; &hellip;</title><p>caf&#233; &#8364;5 &amp;amp; &#39;x&#39; &euro;</p>", "It’s été — …", "It’s été — …\ncafé €5 &amp; 'x' €"),
    ("<body><article>a<article>b</article>c</article>d</body>", "stem", "a\nb\nc"),
    ("<main>a<main>b</main><p>c</p></main>d", "stem", "a\nb\nc"),
    ("<body>a<nav>x<nav>y</nav>z</nav>b</body>", "stem", "a\nb"),
    ("<body><p>a</p><div><nav>x<p>y</p></div>b</body>", "stem", "a\nb"),
    ("<body>a<nav>x", "stem", "a"),
    ("<body>a<script>if (1 < 2) x", "stem", "a"),
    ("<nav><title>t</title><main>m</main></nav><article>a</article>", "stem", "a"),
    ("<p title='a > b'>1 < 2</p>", "stem", "1 < 2"),
    ("<body>a<![foo[x]]>b", "stem", "a\nb"),
]


def test_html_nested_unclosed_and_references(spark):
    df = spark.createDataFrame([(h,) for h, _, _ in WHOLE], "h string")
    assert values(df, html.html_title(F.col("h"), F.lit("stem")), html.html_text(F.col("h"))) == [(t, x) for _, t, x in WHOLE]


def test_pages_and_paragraphs(spark):
    pages = spark.createDataFrame([(1, 2, " b ", 0), (1, 1, "a", 0), (1, 3, "", 0), (2, 1, " ", 1), (3, 1, None, 0)], "doc int, page_number int, text string, image_count int")
    out = {r["doc"]: r for r in assemble.from_pages(pages).collect()}
    assert out[1]["plain_text"] == "a\n\nb" and [p["page_number"] for p in out[1]["pages"]] == [1, 2, 3] and not out[1]["requires_ocr"]
    assert out[2]["requires_ocr"] and out[2]["warnings"] == ["suspected_scanned_pdf"] and not out[3]["requires_ocr"]
    rows = [(1, 0, "Title", "演示产品条款", "s"), (1, 1, None, " ", "s"), (1, 2, "Heading 1", "责任范围", "s"), (1, 3, None, "text", "s"), (2, 0, None, "x", "s")]
    out = {r["doc"]: r for r in assemble.from_paragraphs(spark.createDataFrame(rows, "doc int, idx int, style string, text string, stem string")).collect()}
    assert out[1]["title"] == "演示产品条款" and [tuple(h) for h in out[1]["headings"]] == [(2, "责任范围")] and out[1]["plain_text"] == "演示产品条款\n责任范围\ntext"
    assert out[2]["title"] == "s" and out[2]["headings"] == []


def pack(text, most):
    """The packing as a plain fold."""
    out, current = [], ""
    for line in (x.strip() for x in text.splitlines()):
        if not line:
            continue
        if len(line) > most:
            if current:
                out.append(current)
            current = ""
            out += [line[i : i + most] for i in range(0, len(line), most)]
        elif current and len(current) + 1 + len(line) <= most:
            current += "\n" + line
        else:
            if current:
                out.append(current)
            current = line
    return out + [current] if current else out


def offsets(chunks, plain):
    cursor, out = 0, []
    for c in chunks:
        at = plain.find(c, cursor)
        start = cursor if at < 0 else at
        cursor = start + len(c)
        out.append((start, cursor, at >= 0))
    return out


TEXT = st.text(alphabet="ab \n\r　 \U0001d518", max_size=60)


@settings(max_examples=6, deadline=None)
@given(st.lists(TEXT, min_size=30, max_size=60), st.integers(3, 9))
def test_chunks_equal_a_plain_fold(spark, texts, most):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("c", chunk.chunk_texts(F.col("t"), most))
    for i, c, spans in values(df, "i", "c", chunk.chunk_offsets(F.col("c"), F.col("t"))):
        assert c == pack(texts[i], most) and all(len(x) <= most for x in c)
        assert [tuple(s) for s in spans] == offsets(c, texts[i])


def test_chunk_borders_and_pages(spark):
    text = "a" * 1200 + "\n" + "b" * 1201 + "\nshort\n" + "c" * 600 + "\n" + "d" * 599
    docs = spark.createDataFrame([(1, text + "z", [(1, text), (2, "z")]), (2, None, [(1, None)])], "document_id int, plain_text string, pages array<struct<page_number:int,text:string>>")
    out = chunk.chunks(docs).orderBy("chunk_index").collect()
    assert [r["text"] for r in out] == [*pack(text, 1200), "z"] and [r["page_number"] for r in out][-1] == 2
    assert len(pack(text, 1200)) == 5


def test_parse(spark):
    rows = [(1, "a/x.txt", None, b"\xef\xbb\xbfa\r\nb\rc", "pending"), (2, "x.HTML", "t", b"<title>q</title>w", "pending"), (3, "x.txt", "", b"\xff", "pending"), (4, "x.pdf", None, b"", "pending"), (5, "x.txt", None, b"", "parsed"), (6, "e.txt", None, b"", "pending")]
    out = parse.parse_pending(spark.createDataFrame(rows, "id int, raw_file_path string, source_title string, content binary, parse_status string"))
    got = {r["id"]: r for r in parse.parsed_state(out).collect()}
    assert got[1]["plain_text"] == "a\nb\nc" and got[1]["title"] == "x" and got[2]["title"] == "t" and got[2]["plain_text"] == "q\nw"
    assert got[3]["error"] and got[3]["parse_status"] == "pending" and got[4]["error"] == "Unsupported document type: .pdf"
    assert got[6]["plain_text"] == "" and got[6]["to_status"] == "parsed" and 5 not in got
    assert tuple(parse.report(out).first()) == (3, 2)


DOC = "id bigint, raw_text string, sha256 string, raw_file_path string, source_url string, local_source boolean, data_type string, authenticity_type string, final_review_status string"
RECORD = "id bigint, document_id bigint, data_type string, source_quote string, disclosed boolean, wording string"


def issues(spark, doc, records=(), strict=False):
    docs = spark.createDataFrame([doc], DOC)
    out = validate.validate(docs, spark.createDataFrame(list(records), RECORD), strict).first()
    return [(i["code"], i["field"]) for i in out["issues"]], out["to_status"]


def test_rules(spark):
    fine = (1, "raw quote text", "h", "p", "https://x.example/a", False, "penalty", "verified_public", "parsed")
    assert issues(spark, fine) == ([], "pending_review")
    change = lambda **kw: tuple(kw.get(n.split()[0], v) for n, v in zip(DOC.split(", "), fine, strict=True))
    assert issues(spark, fine, [(1, 1, "penalty", "quote", False, "said")])[0] == [("fabricated_wording", "original_sales_wording")]
    assert issues(spark, fine, [(1, 1, "penalty", "quote", None, "said")])[0] == [("fabricated_wording", "original_sales_wording")]
    assert issues(spark, fine, [(1, 1, "penalty", "Quote", True, "")])[0] == [("quote_not_found", None)]
    assert issues(spark, fine, [(2, 1, "penalty", "no", True, ""), (1, 1, "penalty", "", True, "")])[0] == [("missing_quote", None)]
    made = change(authenticity_type="constructed_for_evaluation", data_type="regulation")
    assert issues(spark, made)[0] == [("constructed_wrong_type", "authenticity_type")]
    record = [(1, 1, "regulation", "quote", True, "")]
    assert issues(spark, made, record)[0] == [] and issues(spark, made, record, True)[0] == [("constructed_wrong_type", "authenticity_type")]
    assert issues(spark, change(authenticity_type="constructed_for_evaluation", data_type="evaluation_sample"))[0] == []
    assert issues(spark, change(raw_text="", raw_file_path=None, sha256=" "))[0] == [("required", "raw_text"), ("required", "raw_file_path")]
    for url, ok in (("http://", False), ("http:///p", False), ("HTTPS://x", True), ("ftp://x", False), ("file:///x", True), (None, False)):
        assert (issues(spark, change(source_url=url))[0] == []) is ok
    assert issues(spark, change(source_url=None, local_source=True))[0] == []


LINES = [
    ('{"record_id": 1, "record_type": "penalty", "final_status": "approved", "reviewer": null, "evidence_quality": "A", "corrections": {"wording": "三十日", "id": 9}}', None),
    ("   ", None),
    ("nope", "invalid JSON"),
    ("[1]", "payload must be an object"),
    ('{"record_id": 1}', "Missing fields: evidence_quality, final_status, record_type, reviewer"),
    ('{"record_id": "x", "record_type": "penalty", "final_status": "approved", "reviewer": "r", "evidence_quality": "A"}', "record_id must be an integer"),
    ('{"record_id": "1", "record_type": "penalty", "final_status": "made_up_status", "reviewer": "r", "evidence_quality": "A"}', "Illegal final_status: made_up_status"),
    ('{"record_id": 1, "record_type": "penalty", "final_status": "rejected", "reviewer": "r", "evidence_quality": "E"}', "evidence_quality must be A, B, C, or D"),
    ('{"record_id": 1, "record_type": "penalty", "final_status": "approved_with_revision", "reviewer": "r", "evidence_quality": "A"}', "approved_with_revision requires corrections"),
    ('{"record_id": 1, "record_type": "penalty", "final_status": "approved", "reviewer": "r", "evidence_quality": "A", "corrections": ["a"]}', "corrections must be an object"),
    ('{"record_id": 1, "record_type": "regulation", "final_status": "approved", "reviewer": "r", "evidence_quality": "A"}', "record_id and record_type do not identify a document"),
    ('{"record_id": "7", "record_type": "evaluation_sample", "final_status": "rejected", "reviewer": "r", "evidence_quality": "D", "corrections": {"split": "test", "authenticity_type": "x"}}', None),
    ('{"record_id": 1, "record_type": "penalty", "final_status": "approved_with_revision", "reviewer": "r", "evidence_quality": "C", "corrections": {"wording": "late"}}', None),
]


def test_review_loop(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_text("\n".join(x for x, _ in LINES), encoding="utf-8")
    docs = spark.createDataFrame([(1, "penalty", "pending_review")], "id bigint, data_type string, final_review_status string")
    samples = spark.createDataFrame([(7, "train", "constructed_for_evaluation", "pending_review")], "id bigint, split string, authenticity_type string, final_review_status string")
    matched = review.match_decisions(review.parse_decisions(files.read_decisions(spark, str(path))), docs, samples)
    got = {r["line_no"]: r["error"] for r in matched.collect()}
    assert got == {n: e for n, (line, e) in enumerate(LINES, 1) if line.strip()}
    assert tuple(review.import_summary(matched).first()) == (3, 9)
    decided = review.merged(matched)
    one = {r["record_id"]: r for r in decided.collect()}
    assert one[1]["final_status"] == "approved_with_revision" and {k: v.toPython() for k, v in one[1]["corrected_fields"].items()} == {"wording": "late", "id": 9} and one[1]["n_decisions"] == 2
    records = spark.createDataFrame([(1, 1, "penalty", "q", None, "old"), (2, 1, "penalty", "q", None, "old")], RECORD)
    assert [(r["id"], r["wording"]) for r in review.correct_records(records, decided).orderBy("id").collect()] == [(1, "late"), (2, "old")]
    assert tuple(review.correct_samples(samples, decided).first()) == (7, "test", "constructed_for_evaluation", "rejected", "pending_review")
    history = [(r["from_status"], r["to_status"]) for r in review.decision_history(matched).where("record_id = 1").orderBy("line_no").collect()]
    assert history == [("pending_review", "approved"), ("approved", "approved_with_revision")]
    assert review.decision_log(matched).count() == 3


def test_index_gate(spark):
    rows = [(1, "pending_review", "verified_public"), (2, "approved", "verified_public"), (3, "approved", "demo_only"), (4, "approved", "constructed_for_evaluation")]
    docs = spark.createDataFrame([(*r, "not_indexed") for r in rows], "id bigint, final_review_status string, authenticity_type string, knowledge_index_status string").withColumn("indexed_at", F.lit(None).cast("timestamp"))
    once = index.mark_indexed(docs, "2024-02-29")
    assert [r["id"] for r in once.where("knowledge_index_status = 'indexed'").collect()] == [2, 4]
    assert index.indexed_count(docs, strict=True).first()[0] == 1
    assert index.indexed_count(once).first()[0] == 0
    assert index.mark_indexed(once.drop("from_status"), "2025-01-01").where("from_status is not null").count() == 0
    assert index.get_record(docs.withColumn("data_type", F.lit("penalty")), "penalty", 2).count() == 1
    assert index.fill_if_empty(docs.limit(0), docs).count() == 4


def test_files(spark, tmp_path):
    for name, text in (("b/z.TXT", "x"), ("a.html", "<p>y"), ("b.md", "no"), ("b/c.docx", "12345")):
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    found = files.scan_directory(spark, str(tmp_path / "in"))
    assert [r["path"].rpartition("/in/")[2] for r in files.in_order(found).collect()] == ["a.html", "b/c.docx", "b/z.TXT"]
    rows = files.collect_files(found, max_bytes=4).orderBy("title").collect()
    assert [r["title"] for r in rows] == ["a", "c", "z"] and [r["content_type"] for r in rows][::2] == ["text/html", "text/plain"]
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "4")  # a file above the reader's own limit is not read either
    try:
        assert len(files.collect_files(found, max_bytes=4).collect()) == 3
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert rows[1]["error"] == "File exceeds 4 bytes" and rows[1]["content"] is None
    kinds = [("text/html; charset=x", None, ".html"), ("TEXT/HTML", None, ".html"), ("text/html ;x", "u", ".bin"), (None, "u/a.PDF", ".pdf"), ("application/octet-stream", "a.pdf?x=1", ".bin")]
    df = spark.createDataFrame([k[:2] for k in kinds], "c string, u string")
    assert [r[0] for r in values(df, files.storage_suffix(F.col("c"), F.col("u")))] == [k[2] for k in kinds]
    raw = spark.createDataFrame([("ab1", ".txt", b"1"), ("ab1", ".txt", b"1")], "sha256 string, suffix string, content binary")
    files.write_raw(raw, str(tmp_path / "raw"))
    files.write_raw(raw.union(spark.createDataFrame([("ab2", ".txt", b"2")], raw.schema)), str(tmp_path / "raw"))
    assert sorted(r["sha256"] for r in spark.read.parquet(str(tmp_path / "raw")).collect()) == ["ab1", "ab2"]
    assert spark.read.parquet(str(tmp_path / "raw")).where("prefix = 'ab'").count() == 2
    (tmp_path / "s.jsonl").write_text('{"id": 1, "sample_text": "t", "risk_labels": ["demo"]}\n', encoding="utf-8")
    samples = files.read_samples(spark, str(tmp_path / "s.jsonl"))
    assert samples.first()["expected_evidence"] == {}
    files.write_review_lines(review.sample_rows(samples), str(tmp_path / "out"))
    line = next((tmp_path / "out").glob("*.json")).read_text(encoding="utf-8")
    assert json.loads(line)["source_url"] is None and "人工构造评测样本" in line


def test_registry(spark):
    rows = [(1, "n", None, None, "penalty", None, 1.0), (2, "", "ftp://x", "p", "x", True, -1.0), (3, "n", "http://a", "p" * 256, "penalty", True, 4000.0)]
    df = spark.createDataFrame(rows, "id bigint, name string, base_url string, publisher string, source_type string, enabled boolean, rate_limit_seconds double")
    out = registry.register(df).orderBy("id").collect()
    assert [r["error"] is None for r in out] == [True, False, False] and out[0]["enabled"] is True
    loose = registry.register(df, strict=False).orderBy("id").collect()
    fetched = spark.createDataFrame([("http://a", 200, None, "x", "http://b", "then"), ("ftp://a", 200, "t", "x", None, None)], "url string, http_status int, content_type string, html string, final_url string, last_modified string")
    pages = registry.crawl_rows(fetched).collect()
    assert [(r["final_url"], json.loads(r["metadata"]["response_headers"])["last-modified"], r["error"] is None) for r in pages] == [("http://b", "then", True), ("ftp://a", None, False)]
    assert registry.crawl_rows(fetched.drop("final_url", "last_modified")).first()["final_url"] == "http://a"
    assert [r["error"] for r in loose] == ["base_url is required", "rate_limit_seconds must not be negative", None]


def test_arrivals_are_inserted_once(spark, tmp_path):
    arrive = lambda rows: spark.createDataFrame(rows, "id bigint, text string").write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: drain_new(spark, str(tmp_path / "in"), "id bigint, text string", str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    arrive([(1, "a"), (2, "a"), (3, "b")])
    run()
    arrive([(4, "b"), (5, "c")])
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [1, 3, 5]


def test_closed_chain(spark):
    """Collected text to an index that takes no untrusted document."""
    rows = [(1, "a.txt", "监管规则\n第一条".encode(), "regulation", "demo_only"), (2, "b.txt", "条款".encode(), "product_document", "verified_public")]
    docs = spark.createDataFrame(rows, "id bigint, raw_file_path string, content binary, data_type string, authenticity_type string")
    docs = docs.withColumns({"source_title": F.lit(None).cast("string"), "parse_status": F.lit("pending"), "sha256": ingest.content_hash(F.col("content")), "source_url": F.lit(None).cast("string"), "local_source": F.lit(True)})
    parsed = parse.parsed_state(parse.parse_pending(docs)).withColumn("final_review_status", F.col("to_status"))
    records = spark.createDataFrame([(1, 1, "regulation", "第一条", None, ""), (2, 2, "product_document", "条款", None, "")], RECORD)
    checked = validate.validate(parsed, records)
    assert [r["to_status"] for r in checked.collect()] == ["pending_review"] * 2
    rows = review.document_rows(checked.withColumn("final_review_status", F.col("to_status"))).collect()
    assert [json.loads(r["automatic_validation"]) for r in rows] == [{"valid": True, "issues": []}] * 2
    assert all(set(r["metadata"]) == {"parsing", "automatic_validation"} for r in checked.collect())
    approved = checked.withColumns({"final_review_status": F.lit("approved"), "knowledge_index_status": F.lit("not_indexed"), "indexed_at": F.lit(None).cast("timestamp")})
    assert [r["id"] for r in index.mark_indexed(approved, "2024-02-29").where("knowledge_index_status = 'indexed'").collect()] == [2]


@pytest.mark.parametrize("bad", ["2024-02-30", "soon", ""])
def test_raw_dates(spark, bad):
    df = spark.createDataFrame([(bad,), ("2024-02-29",), (None,)], "d string")
    assert [r[0] is None for r in values(df, validate.bad_date("d"))] == [False, True, True]


def test_parsed_state_merges_what_it_knows(spark):
    rows = [(1, "a.txt", "t", b"new", "pending", "old", {"local_source": "true", "parsing": "x"}), (2, "a.pdf", "t", b"", "pending", "old", None)]
    docs = spark.createDataFrame(rows, "id bigint, raw_file_path string, source_title string, content binary, parse_status string, raw_text string, metadata map<string,string>")
    out = {r["id"]: r for r in parse.parsed_state(parse.parse_pending(docs)).collect()}
    assert out[1]["raw_text"] == "new" and out[1]["metadata"] == {"local_source": "true", "parsing": '{"metadata":{},"warnings":[]}'}
    assert out[2]["raw_text"] == "old" and out[2]["metadata"] == {} and out[2]["parse_status"] == "pending"


def test_long_documents_are_chunked_in_linear_time():
    import time

    text = "\n".join("word " * (1 + i % 40) + "x" for i in range(200_000))
    began = time.time()
    made = chunk.packed(text, 1200)
    at = chunk.spans(made, text)
    assert time.time() - began < 5 and len(text) > 20_000_000 and all(text[s:e] == c and x for c, (s, e, x) in zip(made, at, strict=True))
    assert chunk.packed("x" * 5_000_001, 1200)[-1] == "x" * (5_000_001 % 1200)
