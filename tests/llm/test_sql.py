"""Queries that SQL can express, against it, over the smallest tables."""

import duckdb
import pytest

from skyweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    mine = queries.queries()[name](spark, SF).toPandas()
    other = duck.sql(queries.oracle_sql()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    tidy = lambda df: df[columns].convert_dtypes().astype(str).sort_values(columns).reset_index(drop=True)
    assert tidy(mine).equals(tidy(other))
