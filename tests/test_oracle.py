"""Every core query with SQL gives the rows that DuckDB gives."""

import importlib

import pytest

from tests.oracle import connection, rows_of_spark, rows_of_sql

MODULES = ("core_queries", "url_queries", "html_queries", "page_queries", "table_queries")
PAIRS = [(m, name) for m in MODULES for name in importlib.import_module(f"auditlake.plans.{m}").SQL]


@pytest.mark.parametrize(("module", "name"), PAIRS, ids=[n for _, n in PAIRS])
def test_query(spark, data, module, name):
    m = importlib.import_module(f"auditlake.plans.{module}")
    got, want = rows_of_spark(m.QUERIES[name](spark, data)), rows_of_sql(connection(data), m.SQL[name])
    assert got == want, ((got - want).most_common(3), (want - got).most_common(3))
