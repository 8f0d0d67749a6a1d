import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from nearfield.plans.queries import QUERIES
from nearfield.streaming import ingest


def land(spark, folder, name, first, last, label):
    rows = spark.range(first, last).select("id", F.lit(label).alias("label"))
    rows.coalesce(1).write.parquet(str(folder / name))


def stream(spark, folder):
    return spark.readStream.schema("id bigint, label string").option("recursiveFileLookup", "true").parquet(str(folder))


def state(spark, path):
    return {r.id: r.label for r in ingest.read_streamed(spark, path).collect()}


def test_later_batches_replace_and_replays_change_nothing(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    land(spark, source, "one", 0, 50, "old")
    ingest.stream_points(stream(spark, source), out, str(tmp_path / "c")).awaitTermination()
    land(spark, source, "two", 40, 60, "new")
    ingest.stream_points(stream(spark, source), out, str(tmp_path / "c")).awaitTermination()
    want = {i: "new" if i >= 40 else "old" for i in range(60)}
    assert state(spark, out) == want
    ingest.stream_points(stream(spark, source), out, str(tmp_path / "c")).awaitTermination()
    assert state(spark, out) == want
    ingest.compact(spark, out, str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 60


def test_a_failed_batch_is_taken_up_again(spark, tmp_path, monkeypatch):
    source, out = tmp_path / "in", str(tmp_path / "out")
    land(spark, source, "one", 0, 10, "a")
    ingest.stream_points(stream(spark, source), out, str(tmp_path / "c"), "id").awaitTermination()
    land(spark, source, "two", 10, 25, "b")
    numbered = ingest.numbered
    monkeypatch.setattr(ingest, "numbered", lambda *a: 1 / 0)
    with pytest.raises(StreamingQueryException):
        ingest.stream_points(stream(spark, source), out, str(tmp_path / "c"), "id").awaitTermination()
    monkeypatch.setattr(ingest, "numbered", numbered)
    ingest.stream_points(stream(spark, source), out, str(tmp_path / "c"), "id").awaitTermination()
    assert state(spark, out) == {i: "a" if i < 10 else "b" for i in range(25)}


def test_numbers_go_on_and_a_replayed_batch_gets_the_same(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    rows = spark.range(100, 130).select("id", F.lit("x").alias("label"))
    rows.coalesce(1).write.parquet(str(source / "one"))
    points = stream(spark, source).withColumnRenamed("id", "key")
    ingest.stream_points(points, out, str(tmp_path / "c"), "key").awaitTermination()
    land(spark, source, "two", 5, 12, "y")
    ingest.stream_points(points, out, str(tmp_path / "c"), "key").awaitTermination()
    want = {i: 100 + i for i in range(30)} | {30 + i: 5 + i for i in range(7)}
    keys = lambda: {r.id: r.key for r in ingest.read_streamed(spark, out).collect()}
    assert keys() == want
    first = spark.read.parquet(f"{out}/batch_id=1")
    assert ingest._written(spark, out, 1) == 30
    assert {r.id for r in first.collect()} == set(range(30, 37))


@pytest.mark.parametrize("files", [0, 3])
def test_numbered_ingest_reads_a_table_that_is_a_file_or_a_folder(spark, tmp_path, files):
    row = "100 - id AS doc_id, 'x' AS text, 'en' AS lang, 's' AS source, id AS n_chars"
    docs = spark.range(60).selectExpr(*row.split(", ")).repartition(max(1, files))
    docs.write.parquet(str(tmp_path / ("documents.parquet" if files else "parts")))
    if not files:
        (part,) = (tmp_path / "parts").glob("part-*.parquet")
        (tmp_path / "documents.parquet").write_bytes(part.read_bytes())
    found = QUERIES["incremental_ingest_numbered"](spark, str(tmp_path)).collect()
    assert {r.id: (r.doc_id, r.n_chars) for r in found} == {i: (41 + i, 59 - i) for i in range(60)}
