"""Tables that grow from run to run."""

import shutil
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from tessera.operators import index, ingest, parse, validate
from tessera.sources import tables
from tessera.streaming.arrivals import drain_files


def test_a_bucketed_store_is_not_shuffled(spark, tmp_path):
    name = f"store_{uuid.uuid4().hex}"
    rows = spark.range(2000).select("id", F.sha2((F.col("id") % 1500).cast("string"), 256).alias("sha256"), F.lit("x").alias("more"))
    tables.append_store(rows.where("id < 500"), name, 8, str(tmp_path / "store"))
    tables.append_store(rows.where("id between 500 and 999"), name, 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = ingest.insert_if_absent(rows.where("id >= 900"), spark.table(name), 8)
        plan = made._jdf.queryExecution().executedPlan().toString()
        got = {r["id"]: (r["document_id"], r["created"]) for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: (i % 1500, 1000 <= i < 1500) for i in range(900, 2000)}
    scan = plan[: plan.index("Bucketed: true")].splitlines()[-1]
    assert "ReadSchema: struct<id:bigint,sha256:string>" in plan and "more" not in scan
    # from the store's scan up to its join stands no exchange
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "Bucketed: true" in x)
    above = lines[at - 1 :: -1]
    joined = next(i for i, x in enumerate(above) if "Join" in x)
    assert not any("Exchange" in x for x in above[:joined])
    spark.sql(f"DROP TABLE {name}")


def test_counts_of_runs_are_those_of_all_documents(spark, tmp_path):
    path = str(tmp_path / "counts")
    docs = spark.range(300).select("id", F.sha2((F.col("id") % 200).cast("string"), 256).alias("sha256"), F.lit("text").alias("raw_text"))
    for run, bounds in enumerate(["id < 100", "id between 100 and 199", "id between 100 and 199", "id >= 200"]):
        tables.add_counts(docs.where(bounds), path, min(run, 2) if run < 3 else 3)
    tables.add_counts(docs.limit(0), path, 1)  # the first try of the third run counted them already
    full = {(r["sha256"], r["hash_count"]) for r in validate.with_hash_count(docs).collect()}
    assert {tuple(r) for r in tables.hash_counts(spark, path).collect()} == full
    new = validate.with_hash_count(docs.where("id >= 200"), tables.hash_counts(spark, path))
    assert {r["hash_count"] for r in new.collect()} == {2}
    tables.merge_runs(spark, path, f"{path}-2", 4)
    assert {tuple(r) for r in tables.hash_counts(spark, f"{path}-2").collect()} == full
    tables.add_counts(docs, f"{path}-2", 5)
    assert {(r["sha256"], r["hash_count"] // 2) for r in tables.hash_counts(spark, f"{path}-2").collect()} == full


def test_only_touched_folders_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).select(F.col("id").alias("document_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"), F.lit("old").alias("text"))
    tables.write_table(rows, path, "document_id", 8)
    stamps = lambda: {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    before = stamps()
    one = spark.createDataFrame([(7, 0, "new")], "document_id bigint, chunk_index int, text string")
    tables.replace_rows(one, one, path, "document_id", 8)
    after, part = stamps(), one.select(tables._part("document_id", 8)).first()[0]
    assert {p for p in before if after.get(p) != before[p]} == {p for p in before if p.parent.name == f"part={part}"}
    got = {(r["document_id"], r["chunk_index"], r["text"]) for r in tables.read_table(spark, path).collect()}
    assert got == {(i, c, "old") for i in range(100) if i != 7 for c in (0, 1)} | {(7, 0, "new")}
    gone = spark.range(100).select(F.col("id").alias("document_id")).where(tables._part("document_id", 8) == part)
    tables.replace_rows(gone, one.limit(0), path, "document_id", 8)  # the last rows of a folder go
    left = {r["document_id"] for r in tables.read_table(spark, path).collect()}
    assert left == set(range(100)) - {r[0] for r in gone.collect()} and not (Path(path) / f"part={part}").exists()
    tables.replace_rows(gone.limit(0), one, path, "document_id", 8)
    assert tables.read_table(spark, path).count() == 2 * len(left)


def test_states_are_written_back_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(i, f"{i}.txt" if i % 2 else "x.pdf", f"text {i}".encode(), "penalty", "pending", "collected", None, None) for i in range(40)]
    docs = spark.createDataFrame(rows, "id bigint, raw_file_path string, content binary, data_type string, parse_status string, final_review_status string, source_title string, raw_text string")
    docs = docs.withColumns({"metadata": F.create_map(F.lit("local_source"), F.lit("true")), "authenticity_type": F.lit("verified_public"), "knowledge_index_status": F.lit("not_indexed"), "indexed_at": F.lit(None).cast("timestamp")})
    tables.write_table(docs, path, "id", 8)
    run = lambda: parse.write_parsed(parse.parse_pending(tables.read_table(spark, path)), path, "2024-02-29 00:00:00", 8)
    assert sorted(r["record_id"] for r in run().collect()) == list(range(1, 40, 2)) and run().count() == 0
    got = {r["id"]: r for r in tables.read_table(spark, path).collect()}
    assert len(got) == 40 and all((r["raw_text"], r["parse_status"]) == ((f"text {i}", "parsed") if i % 2 else (None, "pending")) for i, r in got.items())
    assert set(got[1]["metadata"]) == {"local_source", "parsing"}
    seven = tables.read_table(spark, path).where("id = 7").withColumn("final_review_status", F.lit("approved"))
    tables.replace_rows(seven, seven, path, "id", 8)
    files = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    log = index.write_indexed(spark, path, "2024-02-29 00:00:00", parts=8).collect()
    assert [(r["record_id"], r["from_status"], r["to_status"]) for r in log] == [(7, "approved", "indexed")]
    left = {p for p in files if p.exists() and p.stat().st_mtime_ns == files[p]}
    assert {p.parent for p in files.keys() - left} == {Path(path) / f"part={spark.range(7, 8).select(tables._part('id', 8)).first()[0]}"}
    assert index.write_indexed(spark, path, "2025-01-01 00:00:00", parts=8).count() == 0
    assert tables.read_table(spark, path).where("knowledge_index_status = 'indexed'").count() == 1 and tables.read_table(spark, path).count() == 40


def test_stored_documents_are_parsed_in_their_folders(spark, tmp_path):
    """The same table and log as by ``write_parsed``, with nothing shuffled but the parts' numbers; other folders stay."""
    kinds = [("pending", "x.txt", b"a\r\nb"), ("pending", "x.html", b"<title>t &amp; u</title><p>p</p>"), ("pending", "x.txt", b"\xff"), ("pending", "x.pdf", b"%"), ("parsed", "x.txt", b"c"), (None, "x.txt", b"d"), ("pending", "x.txt", None)]
    rows = [(i, name, content, "penalty", state, "collected", None if i % 2 else "own", "old", None if i % 3 else {"k": "1"}) for i, (state, name, content) in enumerate(kinds * 6)]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "id bigint, raw_file_path string, content binary, data_type string, parse_status string, final_review_status string, source_title string, raw_text string, metadata map<string,string>")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    for path in (one, two):
        tables.write_table(docs, path, "id", 8)
    plain = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.collect())
    log = parse.write_parsed(parse.parse_pending(tables.read_table(spark, one)), one, "2024-02-29 00:00:00", 8)
    made = parse.parse_stored(spark, two, "2024-02-29 00:00:00")
    assert plain(made) == plain(log) and made.count() == 14
    assert plain(tables.stored_rows(spark, two)) == plain(tables.stored_rows(spark, one))
    seen = {p: p.stat().st_mtime_ns for p in Path(two).rglob("*.parquet")}
    assert parse.parse_stored(spark, two, "2024-03-01 00:00:00").count() == 0
    assert {p: p.stat().st_mtime_ns for p in Path(two).rglob("*.parquet")} == seen
    plan = parse._next_state(tables.stored_rows(spark, two))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_files_are_read_once(spark, tmp_path):
    source, store = tmp_path / "in" / "deep", str(tmp_path / "store")
    source.mkdir(parents=True)
    put = lambda name, text: (source / name).write_text(text)
    run = lambda: drain_files(spark, str(tmp_path / "in"), store, str(tmp_path / "cp"), max_bytes=20).awaitTermination()
    put("a.txt", "one")
    put("b.TXT", "one")
    put("c.md", "other suffix")
    put("d.html", "x" * 21)
    run()
    rows = spark.read.parquet(store).collect()
    assert [(r["title"], r["suffix"], bytes(r["content"])) for r in rows if r["error"] is None] == [("a", ".txt", b"one")]
    assert [r["title"] for r in rows if r["error"]] == ["d"]
    for name in ("a.txt", "b.TXT", "d.html"):
        (source / name).unlink()  # an old file that were opened again would fail the run
    put("e.txt", "one")
    put("f.txt", "two")
    run()
    run()
    rows = spark.read.parquet(store).collect()
    assert sorted((r["title"], r["batch"]) for r in rows) == [("a", 0), ("d", 0), ("f", 1)]
    shutil.rmtree(source)
