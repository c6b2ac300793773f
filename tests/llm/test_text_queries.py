"""Text queries against their SQL, and the pipeline's invariants, on the smallest tables."""

import pytest

import corpus_pipeline
from checks.compare import differences, duck
from trackflow.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), duck(SF_DIR), SQL[name]) == ""


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == ["doc_id", "source", "n_pieces", "pieces", "best_score"]
    assert out.join(docs, "doc_id", "left_anti").isEmpty()
    assert out.groupBy("doc_id").count().filter("count > 3").isEmpty()
