import duckdb
import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text) rows, beside columns whose names an operator might use itself."""

    def make(*rows):
        extra = "lang string, source string, n_chars bigint, node bigint, fp string, score double, tokens int"
        return spark.createDataFrame(
            [(i, t, "en", "src0", len(t or ""), 1, "x", 0.5, 1) for i, t in rows], "doc_id bigint, text string, " + extra
        )

    return make


@pytest.fixture(scope="session")
def small():
    """The smallest test tables in DuckDB, and their folder."""
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db, folder
