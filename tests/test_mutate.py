import pytest
from pyspark.sql import functions as F

from nearfield.operators import mutate

POINT = "id bigint, label string, payload map<string,string>"


def base(spark):
    rows = [(1, "a", {"label": "x"}), (2, None, {"k": "1", "m": "2"}), (3, "b", None)]
    return spark.createDataFrame(rows, POINT)


def rows(df):
    return sorted((r.id, r.label, r.payload) for r in df.collect())


def payloads(df):
    return {r.id: r.payload for r in df.collect()}


def test_upsert_replaces_inserts_and_is_idempotent(spark):
    new = spark.createDataFrame([(7, "p", {}, 1), (7, "q", {}, 2), (1, "z", {}, 1)], POINT + ", seq int")
    once = mutate.upsert(base(spark), new, "seq")
    assert [(i, label) for i, label, _ in rows(once)] == [(1, "z"), (2, None), (3, "b"), (7, "q")]
    assert rows(mutate.upsert(once, new, "seq")) == rows(once)
    ids = new.select("id")
    assert [r[0] for r in rows(mutate.delete_ids(once, ids))] == [2, 3]


def test_upsert_within_one_hot_id(spark):
    new = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") + 10).alias("id"),
        F.col("id").cast("string").alias("label"),
        F.create_map(F.lit("n"), F.col("id").cast("string")).alias("payload"),
        F.col("id").alias("seq"),
    )
    out = mutate.upsert(base(spark), new, "seq")
    assert out.count() == 2 + 1 + 2000
    assert out.filter("id = 1").first().label == "2997"


def test_delete_ids_ignores_unknown_ones(spark):
    ids = spark.createDataFrame([(1,), (999,)], "id bigint")
    assert [r[0] for r in rows(mutate.delete_ids(base(spark), ids))] == [2, 3]


def test_delete_where_keeps_rows_of_unknown_outcome(spark):
    assert [r[0] for r in rows(mutate.delete_where(base(spark), F.col("label") == "a"))] == [2, 3]


def test_set_payload_merges(spark):
    out = payloads(mutate.set_payload(base(spark), F.col("id") != 2, {"label": "y", "k": "z"}))
    assert out == {1: {"label": "y", "k": "z"}, 2: {"k": "1", "m": "2"}, 3: {"label": "y", "k": "z"}}
    assert payloads(mutate.set_payload_field(base(spark), 2, "k", "9"))[2] == {"k": "9", "m": "2"}


def test_batch_updates_fold_in_order(spark):
    updates = spark.createDataFrame(
        [(2, {"k": "5", "n": "6"}, 1), (2, {"k": "7"}, 2), (9, {"q": "1"}, 3)], "id bigint, payload map<string,string>, seq int"
    )
    out = payloads(mutate.set_payloads(base(spark), updates, "seq"))
    assert out == {1: {"label": "x"}, 2: {"k": "7", "n": "6", "m": "2"}, 3: None}


def test_delete_fields(spark):
    out = payloads(mutate.delete_fields(base(spark), F.col("id") == 2, ["k", "absent"]))
    assert out == {1: {"label": "x"}, 2: {"m": "2"}, 3: None}


def test_repeated_ids_without_an_order_are_refused(spark):
    twice = spark.createDataFrame([(1, "a", {}), (1, "b", {})], POINT)
    with pytest.raises(ValueError, match="repeated"):
        mutate.upsert(base(spark), twice)
    with pytest.raises(ValueError, match="repeated"):
        mutate.set_payloads(base(spark), twice.select("id", "payload"))
