"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from check import compare
from nearfield.plans.oracle import SQL
from nearfield.plans.queries import QUERIES


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in sorted(Path(SF).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, db, name):
    outcome = compare(spark, db, name, SF)
    assert outcome.startswith("equal") and "types" not in outcome, outcome


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


def test_entry_offers_every_query():
    assert QUERIES.keys() <= entry.queries().keys()
    assert SQL.keys() <= entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["query_id", "rank", "id", "score", "label", "text"]
    assert result.count() > 0
