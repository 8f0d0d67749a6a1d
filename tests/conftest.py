import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = tmp_path_factory.mktemp("work")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("nearfield-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(work / "checkpoints"))
        .config("spark.sql.warehouse.dir", str(work / "warehouse"))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def vectors():
    """40 points of 8 dimensions: ties, opposites, a zero vector and two labels."""
    rng = np.random.default_rng(7)
    values = rng.normal(size=(40, 8)).round(3)
    values[5] = values[4]
    values[6] = values[4]
    values[7] = -values[4]
    values[8] = 0.0
    return values


@pytest.fixture(scope="session")
def points(spark, vectors):
    rows = [
        (i, v.tolist(), ("a" if i % 3 else "b") if i % 5 else None, f"text {i}")
        for i, v in enumerate(vectors)
    ]
    return spark.createDataFrame(rows, "id bigint, dense array<double>, label string, text string")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
