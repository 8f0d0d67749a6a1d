import re

import numpy as np
import pytest
from conftest import plan
from pyspark.sql import functions as F

from nearfield.operators import neighbours
from nearfield.operators.search import dense_search
from nearfield.session import shared_dir
from nearfield.sources import changes
from nearfield.sources import collection as c
from nearfield.streaming import ingest


def made(spark, name, n=200, parts=8):
    c.recreate_collection(spark, name, 2, parts=parts, external=True)
    rows = spark.range(n).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("dense"), F.lit("old").alias("label"))
    c.add_points(spark, name, rows)
    return rows


def labels(spark, name):
    return {r.id: r.label for r in c.open_collection(spark, name).collect()}


def files(spark, name):
    return set(spark.table(f"`{name}`").inputFiles())


def change(spark, *rows):
    return spark.createDataFrame([(i, [float(i), 2.0], label) for i, label in rows], "id bigint, dense array<float>, label string")


def test_changes_are_read_before_and_after_they_are_merged(spark):
    made(spark, "chg")
    expected = {i: "old" for i in range(200)}
    assert changes.upsert_into(spark, "chg", change(spark, (3, "new"), (500, "new"))) == 1
    expected |= {3: "new", 500: "new"}
    assert labels(spark, "chg") == expected
    changes.apply_changes(spark, "chg", change(spark, (4, "newer"), (5, "newer")), spark.createDataFrame([(5,), (6,), (999,), (3,)], "id bigint"))
    expected |= {4: "newer", 5: "newer"}
    del expected[6], expected[3]
    assert labels(spark, "chg") == expected
    changes.compact(spark, "chg")
    assert labels(spark, "chg") == expected and not spark.catalog.tableExists("chg__changes")
    assert changes.compact(spark, "chg") == []
    # Later versions go on counting.
    assert changes.upsert_into(spark, "chg", change(spark, (6, "again"))) == 3
    assert labels(spark, "chg") == expected | {6: "again"}


def test_only_touched_parts_are_written(spark):
    made(spark, "few", n=2_000, parts=16)
    before = files(spark, "few")
    ids = spark.createDataFrame([(1,), (2,)], "id bigint")
    changes.delete_from(spark, "few", ids)
    touched = changes.compact(spark, "few")
    assert 1 <= len(touched) <= 2
    spark.catalog.refreshTable("few")
    left = {f for f in before & files(spark, "few")}
    assert len(before) - len(left) == len(touched)
    assert set(labels(spark, "few")) == set(range(2_000)) - {1, 2}


def test_a_part_that_loses_all_points(spark):
    made(spark, "gone", n=3, parts=50)
    changes.delete_from(spark, "gone", spark.range(2))
    changes.compact(spark, "gone")
    assert labels(spark, "gone") == {2: "old"}


def test_payloads(spark):
    made(spark, "pay", n=20)
    update = spark.createDataFrame([(1, {"a": "1"}), (2, {"b": "2"}), (77, {"c": "3"})], "id bigint, payload map<string,string>")
    changes.set_payloads_in(spark, "pay", update)
    changes.set_payloads_in(spark, "pay", spark.createDataFrame([(1, {"z": "9"})], update.schema))
    got = {r.id: r.payload for r in c.open_collection(spark, "pay").filter("payload IS NOT NULL").collect()}
    assert got == {1: {"a": "1", "z": "9"}, 2: {"b": "2"}}
    with pytest.raises(ValueError, match="repeated"):
        changes.set_payloads_in(spark, "pay", update.union(update))


@pytest.mark.parametrize("step", ["write", "version", "journal", "overwrite", "compacted", "drop"])
def test_whatever_breaks_off_is_made_good(spark, monkeypatch, step):
    """A stop at each step of a change and its compaction leaves the old or the new state, and the next try ends it."""
    name = f"crash_{step}"
    made(spark, name, n=50)
    changes.upsert_into(spark, name, change(spark, (1, "one")))
    old = {i: "old" for i in range(50)} | {1: "one"}
    new = old | {2: "two", 60: "two"}

    def stop(*_, **__):
        raise RuntimeError("stopped here")

    with monkeypatch.context() as m:
        if step in ("version", "compacted"):
            real = changes._set

            def set_but(spark, name, values):
                return stop() if {"version", "compacted"} & values.keys() & {step} else real(spark, name, values)

            m.setattr(changes, "_set", set_but)
        if step == "overwrite":
            m.setattr(changes, "_overwrite", stop)
        if step == "journal":
            m.setattr(changes, "journal_name", lambda n: stop() if len(seen := calls) > 1 else calls.append(n) or f"{n}__journal")
            calls = [name]
        if step == "write":
            m.setattr(changes, "as_points", stop)
        if step == "drop":
            real_overwrite = changes._overwrite

            def keep_journal(spark, name, version):
                journal = spark.table(f"`{name}__journal`").collect()
                assert journal
                real_overwrite(spark, name, version)
                raise RuntimeError("stopped here")

            m.setattr(changes, "_overwrite", keep_journal)
        with pytest.raises(RuntimeError, match="stopped here"):
            changes.upsert_into(spark, name, change(spark, (2, "two"), (60, "two")))
            changes.compact(spark, name)
    state = labels(spark, name)
    assert state in (old, new)
    changes.recover(spark, name)
    assert labels(spark, name) == state
    changes.upsert_into(spark, name, change(spark, (2, "two"), (60, "two")))
    changes.compact(spark, name)
    assert labels(spark, name) == new


def test_streams_into_a_collection(spark, tmp_path):
    made(spark, "flow", n=10)
    schema = "id bigint, dense array<float>, label string"

    def land(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(checkpoint="c"):
        points = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest.stream_into(points, "flow", str(tmp_path / checkpoint)).awaitTermination()

    land((1, [1.0, 1.0], "first"), (20, [1.0, 1.0], "first"), (21, [1.0], "short"), (None, [1.0, 2.0], "nameless"))
    run()
    land((1, [1.0, 1.0], "second"), (22, [1.0, 2.0], "a"), (22, [1.0, 2.0], "b"))
    run()
    expected = {i: "old" for i in range(10)} | {1: "second", 20: "first"}
    assert labels(spark, "flow") == expected
    assert ingest.stream_ledger(spark, "flow") == {"batch": 1, "total": 3, "rejected": 4}
    aside = sorted((r.batch_id, r.reason) for r in ingest.rejected_points(spark, "flow").collect())
    assert aside == [(0, "id is missing or negative"), (0, "vector has another size"), *[(1, "id is repeated within its batch")] * 2]
    changes.compact(spark, "flow")
    # A lost checkpoint runs the first batches again: the ledger knows them.
    run("other")
    assert labels(spark, "flow") == expected and ingest.stream_ledger(spark, "flow")["total"] == 3


# -- approximate search -----------------------------------------------------------


def clustered(spark, clusters=64, size=60, dim=32):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(clusters, dim))
    rows = [(k * size + i, (centres[k] + 0.05 * rng.normal(size=dim)).tolist(), "ab"[k % 2]) for k in range(clusters) for i in range(size)]
    return spark.createDataFrame(rows, "id bigint, dense array<float>, label string")


def test_recall_and_share_read_on_clustered_points(spark):
    points = clustered(spark)
    c.recreate_collection(spark, "cells", 32, code_bits=8, external=True)
    c.add_points(spark, "cells", points)
    held = c.open_collection(spark, "cells")
    queries = points.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "dense").cache()
    found = neighbours.approximate_search(held, queries, 8, 16).cache()
    totals = neighbours.recall(found, dense_search(points, queries)).agg(F.sum("hits").alias("h"), F.sum("wanted").alias("w")).first()
    assert totals.h / totals.w >= 0.9
    vectors = np.array([r.dense for r in queries.collect()])
    read = {code: n for code, n in held.groupBy("code").count().collect()}
    share = np.mean([sum(read.get(x, 0) for x in row) for row in neighbours.probed_codes(vectors, 8, 16).tolist()]) / points.count()
    assert share <= 0.1
    one, _ = neighbours.approximate_topk(held, queries.limit(1), 8, 16)
    assert re.search(r"PartitionFilters: \[.*code#", plan(one))
    # Only the files of probed cells are read.
    files = {f for f in held.filter(F.col("code").isin(neighbours.probed_codes(vectors[:1], 8, 16)[0].tolist())).inputFiles()}
    assert 0 < len(files) <= 16 < len(held.inputFiles())


def test_all_cells_give_the_exact_result(spark, points):
    queries = points.select(F.col("id").alias("query_id"), "dense", F.when(F.col("id") % 2 == 0, "a").alias("label"), (F.col("id") % 5 + 1).cast("int").alias("k"))
    key = lambda rows: sorted((r.query_id, r["rank"], r.id, r.score) for r in rows.collect())
    for distance in ("Cosine", "Euclid", "Dot"):
        whole = key(dense_search(points, queries, 5, distance))
        assert key(neighbours.approximate_search(points, queries, 3, 8, 5, distance)) == whole


def test_more_queries_than_are_shipped(spark):
    points = clustered(spark, 20, 30).withColumn("code", neighbours.hyperplane_code("dense", 5))
    queries = points.select(F.col("id").alias("query_id"), "dense")
    one, _ = neighbours.approximate_topk(points, queries, 5, 6, 3)
    many, _ = neighbours.approximate_topk(points, queries, 5, 6, 3, block=64)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(one) == rows(many) and len(rows(one)) == 1_800


def test_probes_cost_least():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(20, 8))
    shadows = vectors @ neighbours.directions(6, 8).T
    got = neighbours.probed_codes(vectors, 6, 10)
    flips = np.arange(64)
    cost = shadows**2 @ ((flips[:, None] >> np.arange(6)) & 1).T
    own = (shadows >= 0) @ (1 << np.arange(6))
    assert (got == (own[:, None] ^ np.argsort(cost, axis=1)[:, :10])).all()
    assert neighbours.code_bits(10) == 1 and neighbours.code_bits(10**9) == 15
