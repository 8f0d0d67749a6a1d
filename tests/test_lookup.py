from conftest import plan
from pyspark.sql import functions as F

from nearfield.functions import predicates as p
from nearfield.operators import analytics, lookup, report, validate


def test_ids(spark, points):
    assert sorted(r.id for r in lookup.by_ids(points, [3, 3, 5, 999]).collect()) == [3, 5]
    assert sorted(r.id for r in lookup.by_ids(points, list(range(30, 3000))).collect()) == list(range(30, 40))
    assert lookup.by_id(points, 7).first().text == "text 7"
    assert lookup.by_id(points, 77).first() is None
    assert lookup.by_ids(points, [1]).columns == ["id", "label", "text"]
    assert lookup.by_ids(points, [1], with_payload=False, with_vectors=True).columns == ["id", "dense"]


def test_pages_make_up_the_whole(points):
    seen, offset = [], None
    while page := lookup.scroll(points, offset, 7).collect():
        seen += [r.id for r in page]
        offset = seen[-1] + 1
    assert seen == list(range(40))
    paged = lookup.scroll_all(points.repartition(3), 7).collect()
    assert {r.id: r.page for r in paged} == {i: i // 7 for i in range(40)}
    some = lookup.scroll_all(points, 4, condition=F.col("label") == "b").collect()
    ids = sorted(r.id for r in some)
    assert {r.id: r.page for r in some} == {i: n // 4 for n, i in enumerate(ids)}


def test_numbers_of_large_and_uneven_keys(spark):
    keys = [2**60 + i for i in range(50)] + list(range(50)) + [-(10**17), -3]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(6)
    rows = {r.k: r.place for r in lookup.numbered(df, "k", start=5).collect()}
    assert rows == {k: 5 + i for i, k in enumerate(sorted(keys))}


def test_filter_trees(spark):
    rows = [(1, "a", {"n": "5"}), (2, None, {"n": "x"}), (3, "b", {}), (4, "a", {"n": "9"})]
    df = spark.createDataFrame(rows, "id bigint, label string, payload map<string,string>")
    label, n = p.field(df, "label"), p.number(p.field(df, "n"))
    ids = lambda c: sorted(r.id for r in df.filter(c).collect())
    assert ids(p.match(label, "a")) == [1, 4]
    assert ids(p.must_not(p.match(label, "a"))) == [2, 3]
    assert ids(p.must(p.match(label, "a"), p.in_range(n, gt=5))) == [4]
    assert ids(p.should(p.match_any(label, ["b"]), p.in_range(n, gte=5, lte=5))) == [1, 3]
    assert ids(p.must_not(p.should(p.match(label, "b"), p.in_range(n, lt=9)))) == [2, 4]
    assert ids(p.must()) == ids(p.should()) == [1, 2, 3, 4]


def test_point_checks(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (-1, [1.0, 2.0]), (None, [1.0, 2.0]), (1, []), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, dense array<double>")
    checked = validate.check_points(df, dim=2)
    assert validate.valid(checked).count() == 1
    assert [r.reason for r in checked.collect()][1:] == [
        "id is missing or negative", "id is missing or negative", "vector is missing or empty",
        "vector is missing or empty", "vector holds a non-number", "vector holds a non-number",
        "vector has another size",
    ]
    sparse = df.limit(1).select("id", "dense", F.expr("named_struct('indices', array(1, 2), 'values', array(1.0f))").alias("sparse"))
    assert validate.rejected(validate.check_points(sparse)).count() == 1


def test_query_checks(spark):
    rows = [(0, " a ", " Pos ", 0.5, None), (1, "  ", None, None, 5), (2, "a", "", 1.5, 5), (3, "a", None, 0.0, 0), (4, "a", None, 1.0, 1000), (5, "a", None, None, 1001)]
    df = spark.createDataFrame(rows, "query_id bigint, text string, label string, threshold double, k int")
    out = {r.query_id: r for r in validate.check_queries(df).collect()}
    assert [i for i, r in out.items() if r.reason is None] == [0, 4]
    assert (out[0].text, out[0].label, out[0].k) == ("a", "pos", 10)
    assert out[2].label is None


def test_statistics(spark):
    results = spark.createDataFrame(
        [(0, 1, 5, 0.9, "a", "x" * 250), (0, 2, 6, 0.5, "b", None), (0, 3, 7, 0.1, "a", "t")],
        "query_id bigint, rank int, id bigint, score double, label string, text string",
    )
    row = analytics.result_stats(results).first()
    assert (row.hits, row.average_score, row.top_score) == (3, 0.5, 0.9)
    labels = [(r.label, r.hits, round(r.percent, 1)) for r in analytics.result_labels(results).collect()]
    assert labels == [("a", 2, 66.7), ("b", 1, 33.3)]
    shown = report.result_report(results).orderBy("rank").collect()
    assert (len(shown[0].text_shown), shown[0].score_text, shown[1].text_shown) == (200, "0.9000", None)


def test_label_distribution(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("c",)], "label string")
    rows = [tuple(r) for r in analytics.label_distribution(df).collect()]
    assert rows == [("a", 2, 50.0), ("b", 1, 25.0), ("c", 1, 25.0)]
    assert analytics.label_distribution(df.filter("label = 'z'")).count() == 0


def test_unused_columns_are_not_read(spark):
    from conftest import SF

    points = spark.read.parquet(f"{SF}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("dense"), "label"
    )
    text = plan(lookup.by_ids(points, [1, 2]))
    assert "ReadSchema: struct<vec_id:bigint,label:int>" in text
    assert "In(vec_id, [1,2])" in text
