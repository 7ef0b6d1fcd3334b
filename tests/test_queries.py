"""Every registered query against its SQL on the given tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

TABLES = ["documents", "pages", "conversations", "embeddings", "labels"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    def plain(value):
        if value is None or value is pd.NA or value != value:
            return None
        value = value.item() if hasattr(value, "item") else value
        return int(value) if isinstance(value, float) and value.is_integer() else value

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, row)) for row in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    result = contract.queries()[name](spark, sf_dir)
    sql = contract.oracle_sql()[name]
    expected = duck.execute(sql).df()
    types = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    described = {r[0]: r[1] for r in duck.execute("DESCRIBE " + sql).fetchall()}
    assert {n: types.get(t, t) for n, t in result.dtypes} == described
    actual = rows_of(result.toPandas())
    assert actual
    assert actual == rows_of(expected)


def test_every_query_has_sql():
    from sheaf.plans.oracles import ORACLES
    from sheaf.plans.queries import QUERIES

    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert {"source", "volume", "md5"} <= set(contract.entry(spark).columns)
