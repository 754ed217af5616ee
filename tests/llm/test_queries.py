"""The registered queries, where SQL can express them, and the pipeline."""

import pytest

from larder.llm.queries import ORACLES, QUERIES
from tests.oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, name, QUERIES[name], ORACLES[name], SMALL)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = p.staged(after, "test")
    packed = p.STAGES[-1][1](spark, docs, SMALL)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
