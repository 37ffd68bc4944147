"""Every grid query against its SQL, over the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from skyweave import queries

SF = "/root/testdata/sf0.001"
BOTH = sorted(queries.SQL)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{SF}/lineitem.parquet')")
    return c


@pytest.mark.parametrize("name", BOTH)
def test_same_as_sql(spark, duck, name):
    mine = queries.QUERIES[name](spark, SF).toPandas()
    other = duck.sql(queries.SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    tidy = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert tidy(mine).equals(tidy(other))


def test_pivot_of_means_between_two_decimals(spark, tmp_path):
    """Means of 1.125 and 1.025 in months of 28 and 30 days."""
    at = str(tmp_path / "lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"""COPY (
        SELECT CAST(p AS BIGINT) AS l_partkey, CAST(d AS TIMESTAMP) AS l_shipdate,
               CAST(1 + CASE WHEN p = 12 AND d = DATE '1997-02-03' THEN 14 WHEN p = 12 AND d = DATE '1997-04-03' THEN 3 ELSE 0 END AS DOUBLE) AS l_quantity
        FROM (VALUES (6), (12), (13), (17), (18)) AS x(p), (SELECT CAST(unnest(generate_series(TIMESTAMP '1997-02-01', TIMESTAMP '1997-04-30', INTERVAL 1 DAY)) AS DATE) AS d))
        TO '{at}' (FORMAT parquet)""")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{at}')")
    mine = [tuple(r) for r in queries.QUERIES["cdt_pivot"](spark, str(tmp_path)).select("Name", "A", "B").collect()]
    assert mine[2:] == [("1997-02", "1.00", "1.12"), ("1997-03", "1.00", "1.00"), ("1997-04", "1.00", "1.02")]
    assert sorted(mine) == sorted(c.sql(f'SELECT "Name", "A", "B" FROM ({queries.SQL["cdt_pivot"]})').fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
