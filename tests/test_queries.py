"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import pytest
from conftest import DATA, duck, rows_of

import __spark_entry__
from gleanery.plans import registry

#: Streams start a state store each; the batch forms that they equal are below.
FEW = sorted(n for n in registry.ORACLE_SQL if not n.startswith(("s2", "s3")))


@pytest.mark.parametrize("name", FEW)
def test_query_equals_sql(spark, name):
    got = rows_of(registry.QUERIES[name](spark, DATA).toPandas())
    want = rows_of(duck(registry.ORACLE_SQL[name]))
    assert got[0] == want[0]
    assert [x.replace(".0,", ",").replace(".0]", "]") for x in got[1]] == [x.replace(".0,", ",").replace(".0]", "]") for x in want[1]]


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_sql_is_of_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
