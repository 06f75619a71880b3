"""Operators where a text, a record or a file is large, and what they find against plain programs."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import grams
from tessera.operators import chunk, html, ingest, quote_scan, review
from tessera.sources import files


def within(seconds, run):
    began = time.perf_counter()
    out = run()
    assert time.perf_counter() - began < seconds
    return out


# Pages


@pytest.mark.parametrize("piece", ["a <b ", '<a x="', '<a x=">" ', "<!--", "<!-- a --", "<script>", "</", "<", "&#" + "1" * 5000, "<a ", "<p>", "<![x", "<?", "</b ", "<a x= '", "<a b=", "<a b=c/"])
def test_any_markup_is_read_in_linear_time(piece):
    def run():
        made = html._Page(piece * (2_000_000 // len(piece)))
        return made.title(), made.text()

    within(12, run)


def test_what_never_ends():
    text = lambda page: html._Page(page).text()
    assert text("a<b title='x>y") == "a\ny"  # a quote that never closes is no quote
    assert text("a<p>b<i never ends, c") == "a\nb"  # a tag that never ends takes the rest
    assert text("a<!-- c") == "a" and text("a<script>b<p>") == "a" and text("1 < 2 <3") == "1 < 2 <3"
    assert text("<p title=a'b>c</p>d'") == "c\nd'" and text("a<b x=\"1>2\" y='3>4'>c") == "a\nc"
    assert text("a<nav/>b<script src='x'/>c<a href=x/>d</a><script src=y />e") == "a\nb\nc\nd\ne" and text("a<nav class=x/>b") == "a"
    assert text("&#99999999999; &#0065;&#x41;") == "� AA"


def test_only_pages_are_parsed(spark):
    from tessera.operators import parse

    rows = [(1, "x.txt", b"<p>no page", "pending"), (2, "x.html", b"<title>t</title><p>page", "pending")]
    docs = spark.createDataFrame(rows, "id int, raw_file_path string, content binary, parse_status string").withColumn("source_title", F.lit(None).cast("string"))
    made = parse.parse_pending(docs)
    assert {r["id"]: (r["title"], r["plain_text"]) for r in made.collect()} == {1: ("x", "<p>no page"), 2: ("t", "t\npage")}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [_parsed") == 1


# Chunks


def test_a_batch_of_texts_is_chunked_in_little_memory():
    """Of a batch only a stretch of rows is Python's at once, and a text that is the only page comes once."""
    import tracemalloc

    import pyarrow as pa

    text = "\n".join(f"line {i} of a text" for i in range(300))
    kind = pa.list_(pa.struct([("page_number", pa.int32()), ("text", pa.string())]))
    pages = pa.array([[{"page_number": 1, "text": f"{i} {text}"}] for i in range(4000)], kind)
    tracemalloc.start()
    made = chunk._made(1200)(pages, pa.nulls(len(pages), pa.string()), pa.array([True] * len(pages)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) == len(pages) and most < 8_000_000  # the texts are 22 MB
    assert [c["text"] for c in made[3999].as_py()] == chunk.packed(f"3999 {text}", 1200) and all(c["exact"] for c in made[3999].as_py())


def test_chunks_where_the_page_is_and_is_not_the_text(spark):
    rows = [(1, "a\nb", [(1, "a\nb")]), (2, None, [(1, "a")]), (3, "x a", [(1, "a")]), (4, None, [(1, None)]), (5, "a", None), (6, "a\nb", [(1, "a"), (2, "b")]), (7, "a", [(None, "a")])]
    docs = spark.createDataFrame(rows, "document_id int, plain_text string, pages array<struct<page_number:int,text:string>>")
    got = sorted(tuple(r) for r in chunk.chunks(docs).select("document_id", "chunk_index", "text", "start_offset", "end_offset", "exact").collect())
    assert got == [(1, 0, "a\nb", 0, 3, True), (2, 0, "a", 0, 1, False), (3, 0, "a", 2, 3, True), (6, 0, "a", 0, 1, True), (6, 1, "b", 2, 3, True), (7, 0, "a", 0, 1, True)]


def plain_offsets(chunks, text):
    cursor, out = 0, []
    for c in chunks:
        at = text.find(c, cursor)
        start = max(at, cursor)
        cursor = start + len(c)
        out.append((start, cursor, at >= 0))
    return out


@pytest.mark.parametrize("size", [50, 200, 1 << 20])
def test_places_against_find(size, monkeypatch):
    monkeypatch.setattr(grams, "SLICE", size)
    rnd = random.Random(size)
    for _ in range(800):
        text = "".join(rnd.choice(rnd.choice(["ab \n", "abcde \n\r", "\U0001d518é\n x", "a\n"])) for _ in range(rnd.randrange(400))) * rnd.randrange(1, 4)
        made = chunk.packed(text, rnd.randrange(1, 40))
        assert chunk.spans(made, text) == plain_offsets(made, text)
        some = [text[(a := rnd.randrange(len(text) + 1)) : a + rnd.randrange(60)] for _ in range(rnd.randrange(12))]
        assert chunk.spans(some, text) == plain_offsets(some, text)


@pytest.mark.parametrize("text", ["\n\n".join(f"word{i} and more of the line {i * 7} " * (1 + i % 5) for i in range(140_000)), ("x\n" * 700 + "\n") * 14_000, "the same line\n\n" * 1_300_000], ids=["blank lines", "periods", "repeats"])
def test_chunks_that_are_not_verbatim_take_linear_time(text):
    assert len(text) > 15_000_000
    made = chunk.packed(text, 1200)
    at = within(25, lambda: chunk.spans(made, text))
    assert all(text.startswith(c, s) == x for c, (s, e, x) in zip(made, at, strict=True))


# Quotes


def test_quotes_against_search(spark, monkeypatch):
    monkeypatch.setattr(quote_scan, "_SLICE", 60)
    rnd = random.Random(7)
    words = ["the", "Town", "né", "\U0001d518", "a", "of", "\n", "..", "same same same same same same same"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(60))) for _ in range(40)] + [None, "", "aaaaaaaaaaaaaaaa" * 9]
    quotes = [t[(s := rnd.randrange(len(t))) : s + rnd.choice([1, 2, 3, 5, 8, 12, 15, 20, 47, 48, 90])] for t in texts * 3 if t]
    quotes += [None, "", "nowhere at all in any text, however long one looks for it", "A", "a" * 47, "a" * 50, *quotes[:4], *[q.upper() for q in quotes[:20]]]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, raw_text string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(quotes)), "item_id bigint, text string").repartition(2)
    got = sorted(tuple(r) for r in quote_scan.quote_scan(docs, asked).collect())
    assert got == sorted((j, i, t.find(q), t.count(q)) for j, q in enumerate(quotes) if q for i, t in enumerate(texts) if t and q in t)
    assert quote_scan.quote_scan(docs, asked.where("text = ''")).collect() == [] == quote_scan.quote_scan(docs.limit(0), asked).collect()
    plan = quote_scan.quote_scan(docs, asked)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_selection_depends_on_the_passage_alone():
    import numpy as np

    rnd = random.Random(3)
    for window in (1, 2, 8, 32):
        for _ in range(100):
            h = np.array([rnd.randrange(9) for _ in range(rnd.randrange(90))], np.uint64)
            want = {i for s in range(len(h) - window + 1) for i in range(s, s + window) if h[i] == h[s : s + window].min()}
            assert list(grams.selected(h, window)) == sorted(want)


# Histories


def test_a_hot_record_is_spread(spark):
    rnd = random.Random(1)
    rows = [(1 if rnd.random() < 0.6 else rnd.choice([None, *range(2, 40)]), n, rnd.choice("abc"), "first") for n in range(3000)]
    rnd.shuffle(rows)
    events = spark.createDataFrame(rows, "record_id bigint, seq bigint, to_status string, current string").repartition(5)
    plainly = {}
    want = []
    for record, seq, to, current in sorted(rows, key=lambda r: r[1]):
        want.append((record, seq, plainly.get(record, current), to))
        plainly[record] = to
    for most in (10, 500, 10_000):
        made = ingest.transitions(events, most_rows=most)
        assert sorted(map(repr, (tuple(r) for r in made.select("record_id", "seq", "from_status", "to_status").collect()))) == sorted(map(repr, want))
        assert made.columns == [*events.columns, "from_status"]
    seen = []

    def sizes(large, first):
        parts = large.repartitionByRange(4, "_key", "seq").withColumn("_part", F.spark_partition_id())
        seen.extend(r["n"] for r in parts.groupBy("_key", "_part").agg(F.count("*").alias("n")).collect())

    sizes(events.withColumn("_key", F.struct("record_id")).where("record_id = 1"), None)
    assert len(seen) == 4 and max(seen) < 0.5 * sum(seen)  # no task holds the record


# Decision files and corrections


def line(n, record, corrections, status="approved", kind="penalty"):
    return json.dumps({"record_id": record, "record_type": kind, "final_status": status, "reviewer": f"r{n}", "evidence_quality": "A", "corrections": corrections})


def test_lines_of_large_files_are_numbered_by_splits(spark, tmp_path):
    said = {"a.jsonl": [f"line {i}" + " x" * (i % 40) if i % 7 else "" for i in range(500)], "b.jsonl": ["one", "", "three"]}
    for name, lines in said.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = files.read_decisions(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 2
        got = sorted((r["file"].rpartition("/")[2], r["line_no"], r["line"]) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted((name, n, x) for name, lines in said.items() for n, x in enumerate(lines, 1))


def test_decisions_of_several_files_are_in_order_of_file_and_line(spark, tmp_path):
    (tmp_path / "1.jsonl").write_text("\n".join([line(1, 1, {"wording": "first", "rate": 1}), line(2, 1, {"wording": "second"}, "rejected")]))
    (tmp_path / "2.jsonl").write_text("\n" + line(3, 1, {"wording": "third"}, "approved_with_revision") + "\n")
    docs = spark.createDataFrame([(1, "penalty", "pending_review")], "id bigint, data_type string, final_review_status string")
    matched = review.match_decisions(review.parse_decisions(files.read_decisions(spark, str(tmp_path))), docs)
    one = review.merged(matched).first()
    assert one["final_status"] == "approved_with_revision" and {k: v.toPython() for k, v in one["corrected_fields"].items()} == {"wording": "third", "rate": 1}
    log = [(r["from_status"], r["to_status"]) for r in review.decision_history(matched).orderBy("file", "line_no").collect()]
    assert log == [("pending_review", "approved"), ("approved", "rejected"), ("rejected", "approved_with_revision")]


def test_corrections_keep_types_and_nulls(spark):
    kind = "id bigint, document_id bigint, data_type string, source_quote string, rate double, flag boolean, wording string, tags array<string>, day date, n int, more map<string,string>"
    records = spark.createDataFrame([(1, 1, "penalty", "q", 0.5, False, "old", ["z"], None, 3, None)], kind)
    docs = spark.createDataFrame([(1, "penalty", "pending_review", {"kept": "5", "wording": "x"})], "id bigint, data_type string, final_review_status string, corrected_fields map<string,string>")
    given = {"rate": 5, "flag": True, "wording": None, "tags": ["a"], "day": "2024-02-29", "n": "many", "more": {"k": 1}, "unknown": 1.5, "id": 9, "source_quote": "w"}
    lines = spark.createDataFrame([(1, line(1, 1, given)), (2, line(2, 1, {}))], "line_no bigint, line string")
    matched = review.match_decisions(review.parse_decisions(lines), docs)
    decided = review.merged(matched)
    fields = {k: v.toPython() for k, v in decided.first()["corrected_fields"].items()}
    assert {k: float(v) if k == "unknown" else v for k, v in fields.items()} == {**given, "kept": "5"} and type(fields["rate"]) is int
    row = review.correct_records(records, decided).first()
    assert (row["rate"], row["flag"], row["wording"], row["tags"], str(row["day"]), row["n"], row["more"]) == (5.0, True, None, ["a"], "2024-02-29", 3, {"k": "1"})
    assert (row["id"], row["source_quote"]) == (1, "q")  # protected; and what is no int changes nothing
    shown = review.document_rows(docs.drop("corrected_fields").join(decided.select(F.col("record_id").alias("id"), "corrected_fields"), "id").withColumns({"source_url": F.lit("u"), "raw_text": F.lit("t")}))
    told = json.loads(shown.first()["parsed_fields"])
    assert told == {**given, "kept": "5"}


def test_a_sample_is_logged_from_the_state_its_corrections_set(spark):
    samples = spark.createDataFrame([(7, "train", "x", "pending_review")], "id bigint, split string, authenticity_type string, final_review_status string")
    docs = spark.createDataFrame([], "id bigint, data_type string, final_review_status string")
    given = [{"final_review_status": "indexed"}, {"split": None}, {"final_review_status": None}]
    lines = spark.createDataFrame([(n, line(n, 7, c, "rejected", "evaluation_sample")) for n, c in enumerate(given, 1)], "line_no bigint, line string")
    matched = review.match_decisions(review.parse_decisions(lines), docs, samples)
    assert [r["from_status"] for r in review.decision_history(matched).orderBy("line_no").collect()] == ["indexed", "rejected", None]
    assert review.correct_samples(samples, review.merged(matched)).first()["split"] is None
