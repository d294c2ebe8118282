"""Every registered query of the audits against its SQL."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from auditlake.plans.catalog import QUERIES
from oracle.statements import STATEMENTS

SF = os.environ.get("AUDITLAKE_SF", "/root/testdata/sf0.001")
NAMES = list(STATEMENTS)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, said = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, said


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["site_id", "pages", "avg_js_gated"]
    assert df.count() > 0
