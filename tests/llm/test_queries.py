"""Every query with SQL against DuckDB on the smallest supplied tables."""

import os

import duckdb
import pytest

from check import TABLES, TYPES, rows_of
from themeloom.llm.queries import QUERIES
from themeloom.llm.sql import ORACLE_SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are not there")
@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = duck.execute(ORACLE_SQL[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.dtypes) == sorted((c[0], TYPES[str(c[1])]) for c in result.description)
    names = [c[0] for c in result.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())
