from pathlib import Path

import pytest
from conftest import plan
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from nearfield.functions.encode import Bm25Encoder, HashingEncoder
from nearfield.operators import mutate, search
from nearfield.plans.ingest import ingest
from nearfield.schema import Scenario
from nearfield.sources import collection as c


def rows(spark, n=20):
    payload = F.create_map(
        F.lit("n"), F.col("id").cast("string"),
        F.lit("where"), F.format_string('{"lon": %d, "lat": 1.5}', "id"),
        F.lit("odd"), F.when(F.col("id") % 2 == 1, F.lit("x")).otherwise(F.col("id").cast("string")),
    )
    return spark.range(n).select(
        "id",
        F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("dense"),
        F.concat(F.lit("text "), "id").alias("text"),
        (F.col("id") % 3).cast("string").alias("label"),
        payload.alias("payload"),
    )


@pytest.mark.parametrize("external", [False, True])
def test_create_load_reopen(spark, external):
    name = f"made-{external}"
    c.create_collection(spark, name, 2, distance="Dot", shards=3, external=external)
    assert c.open_collection(spark, name).isEmpty()
    assert c.prepare_collection(spark, name, 2)
    c.add_points(spark, name, rows(spark))
    assert not c.prepare_collection(spark, name, 2)
    assert c.open_collection(spark, name).count() == 20
    given = c.collection_properties(spark, name)
    assert (given["dim"], given["distance"], given["shards"]) == ("2", "Dot", "3")
    with pytest.raises(AnalysisException):
        c.create_collection(spark, name, 2)
    changed = mutate.delete_where(c.open_collection(spark, name), F.col("label") == "0")
    c.replace_points(spark, name, changed)
    assert c.open_collection(spark, name).count() == 13
    assert c.collection_properties(spark, name) == given
    c.recreate_collection(spark, name, 2)
    assert c.open_collection(spark, name).isEmpty()


def test_points_of_one_shard_are_bucketed_by_id(spark):
    c.create_collection(spark, "bucketed", 2, shards=4)
    c.add_points(spark, "bucketed", rows(spark))
    text = plan(c.open_collection(spark, "bucketed").groupBy("id").count())
    assert "Exchange" not in text


def test_bad_arguments(spark):
    with pytest.raises(ValueError, match="must be one of"):
        c.create_collection(spark, "x", 2, distance="Manhattan")
    with pytest.raises(ValueError, match="positive"):
        c.create_collection(spark, "x", 0)
    with pytest.raises(ValueError, match="collection name"):
        c.create_collection(spark, "x;y", 2)


def test_vectors_of_another_size_are_refused(spark):
    c.create_collection(spark, "sized", 3)
    with pytest.raises(Exception, match="vector size must be 3, not 2"):
        c.add_points(spark, "sized", rows(spark))
    c.add_points(spark, "sized", rows(spark).drop("dense", "payload"))
    row = c.describe_collection(spark, "sized").first()
    assert (row.points, row.vectors, row.declared_size, row.distance) == (20, 0, 3, "Cosine")


def test_shard_key_prunes_partitions(spark):
    c.create_collection(spark, "sharded", 2, shard_key="label")
    c.add_points(spark, "sharded", rows(spark))
    shard = c.open_collection(spark, "sharded", shards=["1"])
    assert sorted(r.id for r in shard.collect()) == [1, 4, 7, 10, 13, 16, 19]
    assert "PartitionFilters: [" in plan(shard) and "PartitionFilters: []" not in plan(shard)
    with pytest.raises(ValueError, match="no shard key"):
        c.create_collection(spark, "plain", 2)
        c.open_collection(spark, "plain", shards=["1"])


def test_declared_fields(spark):
    c.create_collection(spark, "typed", 2)
    c.add_points(spark, "typed", rows(spark))
    for field, kind in (("n", "integer"), ("where", "geo"), ("odd", "float"), ("label", "keyword")):
        c.declare_field(spark, "typed", field, kind)
    assert c.list_fields(spark, "typed") == {"n": "integer", "where": "geo", "odd": "float", "label": "keyword"}
    points = c.open_collection(spark, "typed")
    three = points.filter("n = 3").first()
    assert (three.id, three.where.lon, three.where.lat, three.odd) == (3, 3.0, 1.5, None)
    assert points.filter("odd > 10").count() == 4
    assert "EqualTo(n,3)" in plan(points.filter("n = 3"))
    c.add_points(spark, "typed", rows(spark, 25).filter("id >= 20").withColumn("n", F.col("id")))
    assert c.open_collection(spark, "typed").filter("n >= 18").count() == 7
    c.drop_field(spark, "typed", "odd")
    c.drop_field(spark, "typed", "label")
    c.drop_field(spark, "typed", "never")
    assert c.list_fields(spark, "typed") == {"n": "integer", "where": "geo"}
    assert "odd" not in c.open_collection(spark, "typed").columns
    assert c.open_collection(spark, "typed").filter("label = '1'").count() == 8
    with pytest.raises(ValueError, match="must be one of"):
        c.declare_field(spark, "typed", "n", "text")


def test_ingest_job(spark, tmp_path):
    path = str(tmp_path / "source")
    source = spark.range(30).select(
        F.concat(F.lit("word "), F.col("id").cast("string")).alias("review"),
        F.when(F.col("id") % 2 == 0, F.lit("5")).alias("rating"),
        F.lit("p").alias("product_name"),
    )
    source.coalesce(1).write.parquet(path)
    scenario = Scenario("reviews", "review", "reviews", "rating", ("product_name",), enable_sparse=True)
    sparse = Bm25Encoder.fit(spark.read.parquet(path), "review")
    summary = ingest(spark, path, scenario, HashingEncoder(16), 16, sparse)
    assert (summary["processed"], summary["total"], summary["labelled"], summary["percent"]) == (30, 30, 15, 100.0)
    points = c.open_collection(spark, "reviews").orderBy("id").collect()
    assert [p.id for p in points] == list(range(30))
    assert points[4].payload == {"text": "word 4", "label": "5", "product_name": "p"}
    assert points[5].payload == {"text": "word 5", "product_name": "p"}
    assert len(points[0].dense) == 16 and len(points[0].sparse.indices) == 2
    assert ingest(spark, path, scenario, HashingEncoder(16), 16, sparse) is None


def test_a_broken_swap_loses_no_points(spark):
    c.create_collection(spark, "half_swapped", 2)
    c.add_points(spark, "half_swapped", spark.createDataFrame([(1, [0.0, 1.0])], "id bigint, dense array<float>"))
    spark.sql("ALTER TABLE half_swapped RENAME TO half_swapped__former")
    assert not c.prepare_collection(spark, "half_swapped", 2)
    assert c.open_collection(spark, "half_swapped").count() == 1
    with pytest.raises(ValueError, match="my-model"):
        c.add_points(spark, "half_swapped", spark.createDataFrame([(2, 1.0)], "id bigint, `my-model` double"))
    c.drop_collection(spark, "half_swapped") if hasattr(c, "drop_collection") else spark.sql("DROP TABLE half_swapped")


def test_search_keeps_to_the_collection(spark):
    name = "searched"
    c.create_collection(spark, name, 2, distance="Euclid", vector="my-model", external=True)
    c.add_points(spark, name, rows(spark).withColumnRenamed("dense", "my-model"))
    asked = spark.createDataFrame([(1, [3.2, 1.0])], "query_id bigint, dense array<float>")
    hits = search.search_collection(spark, name, asked, k=2).orderBy("rank").collect()
    # By cosine the farthest point would come first.
    assert [(h.id, h.text) for h in hits] == [(3, "text 3"), (4, "text 4")]
    with pytest.raises(ValueError, match="created for Euclid"):
        search.search_collection(spark, name, asked, distance="Cosine")


def test_payload_scan_skips_by_the_ids_of_hits(spark):
    c.create_collection(spark, "skipped", 2, distance="Dot")
    c.add_points(spark, "skipped", rows(spark))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, dense array<float>")
    hits = search.search_collection(spark, "skipped", asked, k=3)
    assert "GreaterThanOrEqual(id,17), LessThanOrEqual(id,19)" in plan(hits)
    assert {h.id for h in hits.collect()} == {17, 18, 19}


def test_ranges_cover_the_ids_and_part_at_wide_gaps():
    ids = [*range(0, 1000, 10), *range(50_000, 60_000, 100), 7, 7]
    found = search._id_ranges(ids)
    assert len(found) <= search.ID_RANGES and search._id_ranges([]) == []
    assert all(any(a <= i <= b for a, b in found) for i in ids)
    assert not any(a <= 30_000 <= b for a, b in found)


def test_a_former_version_leaves_no_files(spark):
    c.create_collection(spark, "kept-small", 2, external=True)
    c.add_points(spark, "kept-small", rows(spark))
    former = c._location(spark, "kept-small").removeprefix("file:")
    assert Path(former).exists()
    for _ in range(2):
        c.replace_points(spark, "kept-small", c.open_collection(spark, "kept-small"))
    assert not Path(former).exists()
    place = Path(c._location(spark, "kept-small").removeprefix("file:"))
    assert len(list(place.parent.iterdir())) == 1
    assert c.open_collection(spark, "kept-small").count() == 20


def test_a_column_is_declared_as_what_it_is(spark):
    c.create_collection(spark, "declared", 2, shard_key="it's")
    assert c.collection_properties(spark, "declared")["shard_key"] == "it's"
    with pytest.raises(ValueError, match="is string, not bigint"):
        c.declare_field(spark, "declared", "label", "integer")
