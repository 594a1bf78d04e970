"""Registered queries with SQL against DuckDB; the rest have rows for every document."""

import pytest
from compare import connect, difference

from segmart.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) is None


@pytest.mark.parametrize("name", ["op2_toxicity_chain", "op4_pii_feistel", "op8_line_quality", "op9_secret_scan"])
def test_one_row_for_each_document(spark, documents, name):
    found = QUERIES[name](spark, FOLDER)
    assert found.select("doc_id").exceptAll(documents.select("doc_id")).count() == 0
    assert found.count() == documents.count()
