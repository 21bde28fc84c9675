"""The pipeline against its stages, and the registration of its queries."""

import corpus_pipeline
import duckdb
import pytest

import __spark_entry__ as entry
from eventlab.llm.queries import ORACLES, QUERIES
from eventlab.sources.files import read_table

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(QUERIES) <= set(names) and set(ORACLES) <= set(entry.oracle_sql())


def test_pipeline_rows(spark):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    ids = {r["doc_id"] for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, SF), "test")
        if name != "tokens":
            assert docs.columns == columns
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids and now
        ids = now
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(
        map(tuple, corpus_pipeline.run(spark, SF).collect()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
