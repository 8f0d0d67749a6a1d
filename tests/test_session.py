import pytest
from conftest import plan
from pyspark.sql import functions as F

from nearfield.session import broadcast_if_small, row_bytes, shared_dir


class Bare:
    """A session that tells only some of its settings, as one on a cluster may."""

    def __init__(self, **settings):
        self.settings = settings
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key.replace(".", "_"), default)


def test_only_a_session_known_to_be_local_may_do_without_a_shared_folder():
    assert shared_dir(Bare(spark_checkpoint_dir="/shared/"), "x").startswith("/shared/nearfield/x/")
    assert "/nearfield/x/" in shared_dir(Bare(spark_master="local[4]"), "x")
    for session in (Bare(), Bare(spark_master="spark://host:7077")):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session, "x")


def test_a_side_is_broadcast_only_within_rows_and_bytes(spark):
    rows = spark.range(100).select("id", F.repeat(F.lit("x"), 1_000).alias("text"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    other = spark.range(1_000)

    def joined(**bounds):
        return plan(other.hint("shuffle_hash").join(broadcast_if_small(rows, **bounds), "id"))

    assert "BroadcastHashJoin" in joined()
    assert "BroadcastHashJoin" not in joined(max_rows=99)
    assert "BroadcastHashJoin" not in joined(max_bytes=100_000)
    assert "BroadcastHashJoin" in joined(max_rows=100, max_bytes=200_000)


def test_bytes_of_nested_and_missing_values(spark):
    schema = "a string, b array<string>, m map<string,string>, s struct<x: bigint, y: string>, v array<float>"
    frame = spark.createDataFrame([("ab", ["c", "def"], {"k": "vv"}, (1, "z"), [1.0, 2.0]), (None, None, None, None, None)], schema)
    full, empty = (r[0] for r in frame.select(row_bytes(frame)).collect())
    assert full == 16 + 2 + 4 + 3 + 8 + 1 + 16 and empty == 16 + 8
