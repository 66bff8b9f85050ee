"""Queries that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from lodeseek.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    df = queries.queries()[name](spark, SF)
    found = con.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(found.select(*[f'"{c}"' for c in df.columns]).fetchall(), key=key)
