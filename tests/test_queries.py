"""Every registered query against its SQL statement, row by row."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from gleaner.oracles import ORACLES
from gleaner.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, (list, tuple)):
        return str([_cell(v) for v in value])
    if value is None or value is pd.NA or value != value:
        return "NULL"
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return str(bool(value))
    return f"{float(value):.9g}" if isinstance(value, (int, float)) else str(value)


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in frame.itertuples(index=False))


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    got = contract.queries()[name](spark, sf_dir).toPandas()
    want = con.execute(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
