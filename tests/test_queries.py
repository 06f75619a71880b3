"""Every query with SQL against DuckDB on a small scale factor."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import queries as core
from tessera.plans import views

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    return sorted(repr([None if v is None else str(v) for _, v in sorted(zip(columns, r, strict=True))]) for r in values)


def compare(spark, name, query, sql):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = query(spark, SF)
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_core(spark, name):
    compare(spark, name, core.QUERIES[name], core.SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 189
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = core.QUERIES["q_list"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "ReadSchema" in line][0].split("ReadSchema")[1]
    assert "lang" not in scan and "n_chars" not in scan


@pytest.mark.parametrize("name", ["q_validate", "q_quote_scan", "q_record_corrections", "q_decision_history"])
def test_no_rows_meet_without_a_key(spark, name):
    plan = core.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_views_keep_all_rows_and_whole_texts(spark):
    view = lambda sql: views.view(spark, SF, sql)
    turns, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("conversations", "documents"))
    said = {(r["conv_id"], r["turn"]): r["text"] for r in turns.collect()}
    paragraphs = {(r["doc"], r["idx"]): r["text"] for r in view(views.PARAGRAPHS).collect()}
    assert paragraphs == {k: "" if k[1] % 5 == 3 else t for k, t in said.items()} and max(map(len, paragraphs.values())) > 40
    pages = {(r["doc"], r["page_number"] - 1): r["text"] for r in view(views.PAGES).collect()}
    assert pages.keys() == said.keys() and all(t in ("  ", said[k]) for k, t in pages.items())
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert {r["id"]: r["sample_text"] for r in view(views.SAMPLES).collect()} == texts
    assert {r["document_id"] for r in view(views.RECORDS).collect()} == texts.keys()
    assert {r["requires_ocr"] for r in core.QUERIES["q_ocr_flag"](spark, SF).collect()} == {True, False}
    assert view(views.RECORDS).where("data_type = 'other'").count() > 0
