"""Every registered query against its independent DuckDB statement."""

import pytest

import __spark_entry__ as entry
from mercato.reports import REPORTS
from oracle_compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {k: v for k, v in entry.queries().items() if k in REPORTS}
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in REPORTS}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert len([k for k in QUERIES if k.startswith("q")]) == 70  # 66 reports, Q1 has 5 parts


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF_DIR), con, ORACLE[name])
    assert ok, msg


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["product_category_name_english", "total_revenue"]
    assert 0 < len(rows) <= 10
