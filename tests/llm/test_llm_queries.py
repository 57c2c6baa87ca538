"""The registered queries on the smallest test tables: SQL where there is some, else one row for each input row."""

import check
import pytest
import __spark_entry__ as entry_points

from gapscan.llm import oracles, queries

SF_DIR = "/root/testdata/sf0.001"
ROWS = {"op1_minhash": "documents", "op2_embeddings": "embeddings", "op3_suffix": "documents", "op4_pii": "documents", "op5_shards": "documents", "op7_toxicity": "documents", "op11_phrases": "documents"}


def test_all_are_registered():
    assert {*queries.QUERIES, "pipeline"} <= entry_points.queries().keys()
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", oracles.statements())
def test_query_equals_its_sql(spark, name):
    statement = oracles.statements()[name]
    assert check.compare(queries.QUERIES[name](spark, SF_DIR).toArrow(), check.database(SF_DIR).sql(statement).to_arrow_table()) == ""


@pytest.mark.parametrize("name", ROWS)
def test_query_has_a_row_for_each_input_row(spark, name):
    given = queries.table(spark, SF_DIR, ROWS[name])
    key = given.columns[0]
    assert sorted(r[0] for r in queries.QUERIES[name](spark, SF_DIR).select(key).collect()) == sorted(r[0] for r in given.select(key).collect())
