import numpy as np
import pytest
from pyspark.sql import functions as F
from test_search import brute, found

from nearfield.operators import recommend


def unit(v):
    return v / np.linalg.norm(v)


def wanted(vectors, positive, negative):
    pos = np.mean([unit(vectors[i]) for i in positive], axis=0)
    return 2 * pos - np.mean([unit(vectors[i]) for i in negative], axis=0) if negative else pos


def test_positive_and_negative_examples(spark, points, vectors):
    requests = spark.createDataFrame(
        [(0, [1, 2, 3], [10, 11]), (1, [20], []), (2, [1, 2, 999], None)],
        "query_id bigint, positive_ids array<bigint>, negative_ids array<bigint>",
    )
    got = found(recommend.recommend(points, recommend.examples_of(requests), 6))
    for q, positive, negative in ((0, [1, 2, 3], [10, 11]), (1, [20], []), (2, [1, 2], [])):
        target = wanted(vectors, positive, negative)
        assert got[q] == brute(vectors, target, "Cosine", 6, lambda i: i not in positive + negative)


def test_options_and_condition(spark, points, vectors):
    requests = spark.createDataFrame([(0, [1, 2])], "query_id bigint, positive_ids array<bigint>")
    options = spark.createDataFrame([(0, "a", 0.1, 4)], "query_id bigint, label string, threshold double, k int")
    examples = recommend.examples_of(requests)
    got = found(recommend.recommend(points, examples, options=options, condition=F.col("id") > 12))
    labelled = {r.id: r.label for r in points.collect()}
    keep = lambda i: labelled[i] == "a" and i > 12
    assert got[0] == brute(vectors, wanted(vectors, [1, 2], []), "Cosine", 4, keep, 0.1)


def test_dot_uses_the_vectors_as_they_are(spark, points, vectors):
    requests = spark.createDataFrame([(0, [1, 2])], "query_id bigint, positive_ids array<bigint>")
    got = found(recommend.recommend(points, recommend.examples_of(requests), 5, "Dot"))
    assert got[0] == brute(vectors, (vectors[1] + vectors[2]) / 2, "Dot", 5, lambda i: i not in (1, 2))


def test_by_label_takes_the_first_five(spark, points, vectors):
    labelled = {r.id: r.label for r in points.collect()}
    heads = {x: [i for i in range(40) if labelled[i] == x][:5] for x in "ab"}
    requests = spark.createDataFrame([(0, "a", "b"), (1, "b", None)], "query_id bigint, positive_label string, negative_label string")
    given = recommend.label_examples(points, requests).collect()
    assert sorted(r.id for r in given if r.query_id == 0 and r.positive) == heads["a"]
    assert sorted(r.id for r in given if r.query_id == 0 and not r.positive) == heads["b"]
    got = found(recommend.recommend_by_label(points.filter("id <> 8"), requests, 7))
    heads = {x: [i for i in range(40) if labelled[i] == x and i != 8][:5] for x in "ab"}
    examples = heads["a"] + heads["b"]
    assert got[0] == brute(vectors, wanted(vectors, heads["a"], heads["b"]), "Cosine", 7, lambda i: i not in examples and i != 8)
    assert got[1] == brute(vectors, wanted(vectors, heads["b"], []), "Cosine", 7, lambda i: i not in heads["b"] and i != 8)


def test_examples_without_a_vector_do_not_count(spark):
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id bigint, dense array<double>")
    requests = spark.createDataFrame([(0, [1, 2]), (1, [2])], "query_id bigint, positive_ids array<bigint>")
    assert found(recommend.recommend(points, recommend.examples_of(requests))) == {0: [(3, 0.0)]}


def test_unknown_labels_have_reasons(spark, points):
    rows = [(0, "missing", "a"), (1, "a", "missing"), (2, "a", None), (3, None, "b"), (4, "missing", "missing")]
    requests = spark.createDataFrame(rows, "query_id bigint, positive_label string, negative_label string")
    reasons = {r.query_id: r.reason for r in recommend.label_reasons(points, requests).collect()}
    assert reasons == {
        0: "no points found with positive label: missing", 1: "no points found with negative label: missing", 2: None,
        3: "positive label is missing", 4: "no points found with positive label: missing",
    }
    # One request that cannot be answered does not keep others from their hits.
    assert found(recommend.recommend_by_label(points, requests)).keys() == {1, 2}
    assert [r.reason for r in recommend.label_reasons(points, requests.drop("negative_label")).filter("query_id = 2").collect()] == [None]


def test_a_popular_example(spark):
    """A point that every request names is hidden from each of them, without a list of requests at the point."""
    points = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(30)], "id bigint, dense array<double>")
    requests = spark.createDataFrame([(q, [0, q]) for q in range(1, 25)], "query_id bigint, positive_ids array<bigint>")
    hits = recommend.recommend(points, recommend.examples_of(requests), 4)
    got = found(hits)
    assert all(len(h) == 4 and not {0, q} & {i for i, _ in h} for q, h in got.items()) and len(got) == 24
    assert {r["rank"] for r in hits.collect()} == {1, 2, 3, 4}
