"""Every query against its SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from spanloom.plans.oracle import ORACLE
from spanloom.plans.queries import QUERIES, configured
from tests.conftest import SMALL

TABLES = ["orders", "lineitem", "events", "supplier"]
QUERIES = {name: configured(query) for name, query in QUERIES.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows(df, columns):
    return sorted(map(repr, df[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
