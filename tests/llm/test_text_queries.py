"""The registered text queries: against SQL where there is any, whole tables, and the pipeline."""

import compare
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from fleetlens.llm.catalog import ORACLES, TEXT_QUERIES
from fleetlens.llm.common import table


def test_all_are_registered():
    names = set(contract.queries())
    assert {n.split("_")[0] for n in TEXT_QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(TEXT_QUERIES) | {"pipeline"} <= names
    assert set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, small, name):
    assert compare.compare(TEXT_QUERIES[name](spark, small), compare.connect(small), ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(TEXT_QUERIES) - set(ORACLES)))
def test_one_row_per_document(spark, small, name):
    rows = TEXT_QUERIES[name](spark, small).select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in table(spark, small, "documents").select("doc_id").collect())


def test_pipeline(spark, small):
    docs = table(spark, small, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.schema.simpleString() == docs.schema.simpleString()
        seen[name] = {r.doc_id for r in out.select("doc_id").collect()}
        assert 0 < len(seen[name]) <= docs.count()
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert seen["decontamination"] <= seen["near dedup"] <= seen["line dedup"] <= seen["quality"]
    last = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in last.collect()} == seen["decontamination"]
