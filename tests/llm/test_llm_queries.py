"""The training-data queries with SQL against DuckDB, and the pipeline's order."""

import random
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.select(*columns).fetchall())


def test_pipeline(spark):
    """Each stage against the operations it is made of, on what the one before kept."""
    from tessera.llm import decontaminate, near_dup, quality_rules, token_shards

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "token_output"]
    good = stage["quality_rules"](spark, docs, SF)
    assert ids(good) == ids(quality_rules.report(docs).where("kept")) and good.columns == docs.columns
    single = stage["ngram_jaccard_join"](spark, good, SF)
    assert ids(single) == sorted({r["class_id"] for r in near_dup.near_duplicates(good).collect()})
    clean = stage["benchmark_decontamination"](spark, single, SF)
    assert ids(clean) == ids(decontaminate.contamination(single, spark.read.parquet(f"{SF}/benchmark.parquet")).where("not contaminated"))
    mixed = stage["mixing"](spark, clean, SF)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(clean))
    made = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["slot"] for r in made) == list(range(len(made)))
    assert {i for r in made for i in r["doc_ids"]} == set(ids(mixed))
    assert token_shards.LENGTH * 2 == len(made[0]["tokens"])


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, key string, record string, _tessera_quality string, marks string, slot string"


def test_pipeline_on_awkward_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns, a benchmark with nulls; and an empty table."""
    rnd = random.Random(2)
    said = ["the", "of", "and", "is", "town", "people", "harbour", "story", "letters", *(f"place{i}" for i in range(90))]
    prose = ["\n".join(" ".join(rnd.choice(said) for _ in range(40)) for _ in range(4)) for _ in range(12)]
    texts = [*prose, prose[0], prose[0].upper(), "", None, " \n ", "x" * 50_000, " " * 1_000_000, " ".join(rnd.choice(said) for _ in range(30_000))]
    rest = ("s", "k", "r", "q", "m", "t")
    rows = [(i, t, "en", ["a", None, "b"][i % 3], 1, *rest) for i, t in enumerate(texts)] + [(None, prose[1], None, None, None, *rest), (None, None, None, None, None, *[None] * 6)]
    docs = spark.createDataFrame(rows + rows[:2], SCHEMA).repartition(3)
    for table in (docs, docs.limit(0)):
        kept = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SF)
            assert kept.columns == docs.columns, name
        made = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
        assert sorted(r["slot"] for r in made) == list(range(len(made)))
        assert bool(made) == bool(table.count())
    good = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    single = corpus_pipeline.STAGES[1][1](spark, good, SF)
    assert single.count() == len({r["text"].lower() for r in good.collect()})
