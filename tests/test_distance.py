import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import distance as d


def test_scores_match_numpy_and_are_symmetric(spark, vectors):
    rows = [(v.tolist(), w.tolist()) for v, w in zip(vectors, vectors[::-1], strict=True)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    columns = [d.score(F.col(x), F.col(y), n).alias(n + x) for n in d.DISTANCES for x, y in ("ab", "ba")]
    for (a, b), row in zip(rows, df.select(*columns).collect(), strict=True):
        a, b = np.array(a), np.array(b)
        length = np.linalg.norm(a) * np.linalg.norm(b)
        want = {"Cosine": a @ b / length if length else None, "Dot": a @ b, "Euclid": np.linalg.norm(a - b)}
        for name, value in want.items():
            assert row[name + "a"] == row[name + "b"]
            assert row[name + "a"] == (None if value is None else pytest.approx(value, abs=1e-6))


def test_sizes_differ_or_elements_miss(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0]), ([1.0, None], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r.x for r in df.select(d.dot(F.col("a"), F.col("b")).alias("x")).collect()] == [None, None]


def test_normalise(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "a array<double>")
    got = [r.x for r in df.select(d.l2_normalise(F.col("a")).alias("x")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_unknown_distance():
    with pytest.raises(ValueError, match="must be one of"):
        d.check_distance("Manhattan")
