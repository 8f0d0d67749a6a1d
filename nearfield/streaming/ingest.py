"""Incremental ingest: a stream of points upserted batch after batch.

Each micro-batch is written to a folder named by its batch id. A batch that runs again
after a failure overwrites its own folder, so nothing is doubled. Readers see, per id,
the row of the latest batch; ``compact`` writes that view as a table of its own.

``stream_into`` takes a stream into a collection laid out in parts: each batch is one version
of its changes, and the step that makes the version count also notes the batch in the
stream's ledger, so a batch that runs again is known and left out.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators.lookup import numbered
from nearfield.operators.mutate import latest
from nearfield.operators.validate import check_points, rejected, valid
from nearfield.session import stored
from nearfield.sources.changes import apply_changes, recover
from nearfield.sources.collection import collection_properties, overwrite_partitions, side_table


def _written(spark: SparkSession, path: str, before: int) -> int:
    """Rows of the batches before this one, from the footers."""
    try:
        batches = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return 0
        raise
    return batches.filter(F.col("batch_id") < before).count()


def stream_points(
    points: DataFrame, path: str, checkpoint: str, number_by: str | None = None
) -> StreamingQuery:
    """Starts the ingest of what the source holds now, and of what came since last time.

    Points bring their own ``id``, or get consecutive ones in the order of the unique
    column ``number_by``, going on where the batches before left off. An error stops
    the stream; started again, it takes up at the failed batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if number_by is not None:
            start = _written(batch.sparkSession, path, batch_id)
            batch = numbered(batch, number_by, start, "id")
            batch = batch.withColumn("id", F.col("id").cast("bigint"))
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        points.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_streamed(spark: SparkSession, path: str) -> DataFrame:
    """Per id the row of the latest batch."""
    return latest(spark.read.parquet(path), "batch_id")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Writes the present state to a folder of its own."""
    read_streamed(spark, path).write.parquet(target)


def stream_ledger(spark: SparkSession, name: str, stream: str = "stream") -> dict[str, int]:
    """The stream's last applied batch (-1: none), and how many points it brought and lost so far."""
    given = collection_properties(spark, name)
    facts = {"batch": -1, "total": 0, "rejected": 0}
    return {k: int(given.get(f"stream.{stream}.{k}", v)) for k, v in facts.items()}


def rejected_points(spark: SparkSession, name: str, stream: str = "stream") -> DataFrame | None:
    """What the stream's applied batches could not bring in: batch_id, reason, id and vector size."""
    path = side_table(spark, name, "rejected")
    if path is None:
        return None
    known = stream_ledger(spark, name, stream)["batch"]
    return spark.table(path).filter((F.col("stream") == stream) & (F.col("batch_id") <= known))


def stream_into(points: DataFrame, name: str, checkpoint: str, stream: str = "stream") -> StreamingQuery:
    """Starts the upsert of what the source holds now, and of what came since, into collection ``name``.

    A point without an id or of another size than the collection's, and ids repeated within a
    batch, are set aside with their reason (``rejected_points``); all others replace the
    points of their ids. The ledger's total grows by the batch's valid points.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        given = recover(spark, name)
        ledger = stream_ledger(spark, name, stream)
        if batch_id <= ledger["batch"]:
            return
        vector = given.get("vector", "dense")
        checked = check_points(batch.withColumnRenamed(vector, "dense"), int(given["dim"]))
        # The batch is computed once; what follows reads it several times.
        checked = stored(checked)
        often = checked.filter("reason IS NULL").groupBy("id").count().filter("count > 1").select("id", F.lit(True).alias("often"))
        twice = F.when(F.col("often"), F.lit("id is repeated within its batch"))
        checked = stored(checked.join(often, "id", "left").withColumn("reason", F.coalesce("reason", twice)).drop("often"))
        bad = rejected(checked).select(
            F.col("id").cast("bigint").alias("id"), F.size("dense").alias("size"), "reason",
            F.lit(stream).alias("stream"), F.lit(batch_id).cast("bigint").alias("batch_id"),
        )
        table = side_table(spark, name, "rejected", like=bad, partition_by=["stream", "batch_id"])
        overwrite_partitions(bad, table)
        counts = checked.agg(F.count("reason").alias("bad"), F.count("*").alias("all")).first()
        good = valid(checked).withColumnRenamed("dense", vector)
        facts = {
            f"stream.{stream}.batch": batch_id,
            f"stream.{stream}.total": ledger["total"] + counts["all"] - counts["bad"],
            f"stream.{stream}.rejected": ledger["rejected"] + counts["bad"],
        }
        apply_changes(spark, name, upserts=good, **facts)

    return (
        points.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
