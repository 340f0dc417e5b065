"""The registered queries and the pipeline on the small given tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from parterre.llm import queries
from parterre.llm.common import table
from tests.oracle_check import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_all_are_registered():
    names = set(entry_point.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.partition("_")[0] for n in names if n.startswith("op")}
    assert "pipeline" in names and set(queries.ORACLE) <= names


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_matches_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLE[name]) is None


@pytest.mark.parametrize("name", ["op2_url_filters", "op4_toxicity", "op7_language_id", "op10_quality_rules"])
def test_one_row_each(spark, name):
    source = "pages" if name.startswith("op2") else "documents"
    key = "page_id" if name.startswith("op2") else "doc_id"
    found = queries.QUERIES[name](spark, FOLDER)
    assert found.select(key).exceptAll(table(spark, FOLDER, source).select(key)).isEmpty()
    assert found.count() == table(spark, FOLDER, source).count()


def test_pipeline(spark):
    docs = table(spark, FOLDER, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store(stage(spark, docs, FOLDER), f"test-{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "pii":
            assert docs.columns == corpus_pipeline.COLUMNS
            seen = docs.where(F.col("text").rlike("@mail[0-9].example.com"))
            assert seen.isEmpty()
    order = list(kept.values())
    assert all(later <= earlier for earlier, later in zip(order, order[1:])) and len(order) == 5
    assert order[2] == order[3] == order[4] and len(order[-1]) > 100


def test_pipeline_of_nothing(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store(stage(spark, docs, FOLDER), f"test-{name}")
    assert docs.count() == 0
