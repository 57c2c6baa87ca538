"""Every registered query against its oracle SQL, on the smallest test tables."""

import os
import subprocess
import sys

import pytest

import check
from gapscan.catalog import oracles
from gapscan.catalog import queries as catalog
import __spark_entry__ as entry_points
from gapscan.plans.reports import REPORTS

SF_DIR = "/root/testdata/sf0.001"
QUERIES, STATEMENTS = catalog.QUERIES, oracles.statements()


@pytest.fixture(scope="module")
def connection():
    return check.database(SF_DIR)


@pytest.fixture(scope="module")
def published(spark):
    table = catalog.published(spark, SF_DIR).persist()
    yield table
    table.unpersist()


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == STATEMENTS.keys()
    assert QUERIES.items() <= entry_points.queries().items() and STATEMENTS.items() <= entry_points.oracle_sql().items()


def test_entry_points_work_without_the_optional_queries():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry_points.__file__), check=True)
    assert done.stdout.split() == [str(len(QUERIES)), str(len(STATEMENTS))]


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, published, name):
    ours = REPORTS[name](published) if name in REPORTS else QUERIES[name](spark, SF_DIR)
    assert check.compare(ours.toArrow(), connection.sql(STATEMENTS[name]).to_arrow_table()) == ""


def test_entry(spark):
    table = entry_points.entry(spark)
    assert table.count() == 632
