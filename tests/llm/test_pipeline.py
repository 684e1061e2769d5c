"""The stages one by one on planted rows, and the registered corpus queries next to their SQL."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from check import TABLES, rows_of
from loadshape.llm.oracle import ORACLES
from loadshape.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())


def test_queries_keep_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("op1_language_id", "op5_sharding", "op9_substring_dedup", "op10_simhash"):
        assert Counter(r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()) == Counter(
            r.doc_id for r in docs.select("doc_id").collect()
        )


def test_stages_on_planted_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    planted = spark.createDataFrame(
        [(900, None, "en", "s", 0), (901, "12 34 ...", None, "s", 0), (902, docs.first().text, "fr", "s", 0), (903, f"Well {passage} so", "en", "s", 0), (904, "", "en", None, 0)],
        docs.schema,
    )
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.unionByName(planted)
    named = stages["language"](spark, rows, SF)
    assert named.columns == docs.columns
    assert {r.doc_id for r in rows.collect()} - {r.doc_id for r in named.collect()} == {900, 901, 904}
    unique = stages["near_duplicates"](spark, named, SF)
    assert unique.columns == docs.columns and unique.where("doc_id = 902").count() == 0
    texts = Counter(r.text for r in unique.collect())
    assert max(texts.values()) == 1 and set(texts) <= {r.text for r in named.collect()}
    clean = stages["decontamination"](spark, unique, SF)
    assert clean.columns == docs.columns and clean.where("doc_id = 903").count() == 0
    assert clean.count() >= 0.9 * unique.count()


def test_run_and_empty_tables(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    counts = Counter((r.shard, r.slot) for r in rows.collect())
    assert max(counts.values()) == 1
    none = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
