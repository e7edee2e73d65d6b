import os

import pytest

import corpus_pipeline
from lakelens.llm import registry
from lakelens.llm.common import stage
from tests.differential import by_spark, by_sql

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = stage(f(spark, docs, FOLDER), name)
        assert docs.columns == columns
        assert docs.count() >= 0.6 * before
    assert docs.select("doc_id").distinct().subtract(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id")).isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    assert by_spark(registry.QUERIES[name](spark, FOLDER)) == by_sql(registry.SQL[name], FOLDER)
