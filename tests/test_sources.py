import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from nearfield.schema import Scenario, check_collection_name
from nearfield.sources import parquet as src


def test_missing_file(spark):
    with pytest.raises(FileNotFoundError):
        src.read_source(spark, "/tmp/no/such/file.parquet")


def test_row_ids_follow_file_and_row_order(spark, tmp_path):
    for part, size in (("b", 300), ("a", 7), ("c", 50)):
        rows = spark.range(size).select(F.lit(part).alias("part"), F.col("id").alias("n"))
        rows.coalesce(1).write.parquet(str(tmp_path / part))
    paths = [str(tmp_path / p) for p in "bac"]
    rows = src.with_row_ids(spark.read.parquet(*paths), start_id=10).orderBy("id").collect()
    want = [(p, n) for p, size in (("a", 7), ("b", 300), ("c", 50)) for n in range(size)]
    assert [(r.id, r.part, r.n) for r in rows] == [(10 + i, p, n) for i, (p, n) in enumerate(want)]


def test_map_columns(spark):
    rows = spark.createDataFrame([("great", 5, True, None)], "review string, rating int, verified boolean, author string")
    scenario = Scenario("r", "review", "r", "rating", ("verified", "author", "absent"))
    assert scenario.columns == ["review", "rating", "verified", "author", "absent"]
    with pytest.warns(UserWarning, match="'absent' not found"):
        mapped = src.map_columns(rows, scenario)
    row = mapped.withColumn("payload", src.payload()).first()
    assert (row.text, row.label, row.metadata) == ("great", "5", {"verified": "true", "author": None})
    assert row.payload == {"text": "great", "label": "5", "verified": "true"}
    with pytest.raises(ValueError, match="Text column 'review' not found"):
        src.map_columns(rows.drop("review"), scenario)
    with pytest.raises(ValueError, match="Label column 'rating' not found"):
        src.map_columns(rows.drop("rating"), scenario)


def test_mapping_without_label_or_metadata(spark):
    rows = spark.createDataFrame([("x",)], "t string")
    row = src.map_columns(rows, Scenario("s", "t", "s")).withColumn("payload", src.payload()).first()
    assert (row.label, row.metadata, row.payload) == (None, {}, {"text": "x"})


def test_a_metadata_column_overrides_label(spark):
    rows = spark.createDataFrame([("x", "one", "two")], "t string, l string, label string")
    mapped = src.map_columns(rows, Scenario("s", "t", "s", "l", ("label",)))
    assert mapped.select(src.payload().alias("p")).first().p == {"text": "x", "label": "two"}


def test_validated_records(spark):
    rows = spark.createDataFrame(
        [("   ", "positive"), (None, "positive"), (" a b　", " Positive "), ("x", "0"), ("x", "  "), ("x", ""), ("x", None)],
        "text string, label string",
    )
    counts = Observation()
    out = [(r.text, r.label) for r in src.validated_records(rows, counts=counts).collect()]
    assert sorted(out, key=str) == sorted([("a b", "positive"), ("x", "negative"), ("x", ""), ("x", None)], key=str)
    assert counts.get == {"valid": 4, "invalid": 3}


def test_record_columns(spark):
    rows = spark.createDataFrame([("one", "a")], "sentence string, label string")
    assert src.validated_records(rows).first().text == "one"
    with pytest.raises(ValueError, match="neither 'text' nor 'sentence'"):
        src.validated_records(rows.drop("sentence"))
    with pytest.raises(ValueError, match="Label column"):
        src.validated_records(rows.drop("label"))


@pytest.mark.parametrize("name", ["a", "a_b-1", "_x", "7"])
def test_good_names(name):
    assert check_collection_name(name) == name


@pytest.mark.parametrize("name", ["", " ", "a b", "a.b", "__", "a`b"])
def test_bad_names(name):
    with pytest.raises(ValueError):
        check_collection_name(name)


def test_blank_text_column():
    with pytest.raises(ValueError):
        Scenario("s", " ", "s")
