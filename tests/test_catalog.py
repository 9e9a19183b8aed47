"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from loamwork import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        p = f"{D}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def rows(columns, found):
    tidy = lambda x: round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(map(tidy, r)) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, D)
    columns = sorted(df.columns)
    sql = duck.sql(catalog.oracle_sql()[name])
    assert sorted(sql.columns) == columns
    assert rows(columns, df.select(*columns).collect()) == rows(columns, sql.select(*[f'"{c}"' for c in columns]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, D).count() > 0
