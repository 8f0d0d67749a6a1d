"""Changes of points in a saved collection, without writing all of it anew.

For collections laid out in parts by id. Each change is a numbered version in a table of
its own beside the collection, and counts once the collection's ``version`` property
names it; readers merge what is newer than ``compacted``. ``compact`` writes the touched
parts, merged, to a journal table, overwrites only these parts from it and then moves
``compacted`` on. Whatever breaks off in between is repeated or dropped by the next
``recover``: the journal is complete once it exists, and overwriting from it twice does no harm.
One writer at a time may change a collection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.mutate import check_single, merged
from nearfield.session import broadcast_if_small, shared_dir, stored
from nearfield.sources.collection import (
    _literal,
    _PREFIX,
    _quoted,
    as_points,
    changes_name,
    collection_properties,
    journal_name,
    merge_changes,
    overwrite_partitions,
    part_of,
    pending_changes,
)


def _set(spark: SparkSession, name: str, values: dict[str, object]) -> None:
    """Sets properties of the collection, all in one step."""
    pairs = ", ".join(f"{_literal(_PREFIX + k)} = {_literal(str(v))}" for k, v in values.items())
    spark.sql(f"ALTER TABLE {_quoted(name)} SET TBLPROPERTIES ({pairs})")


def _parts(given: dict[str, str], name: str) -> int:
    if "parts" not in given:
        raise ValueError(f"collection {name!r} is not laid out in parts; create it with ``parts``")
    return int(given["parts"])


def recover(spark: SparkSession, name: str) -> dict[str, str]:
    """Ends a compaction that broke off, and returns the collection's properties."""
    given = collection_properties(spark, name)
    if int(given.get("compacting", 0)) > int(given.get("compacted", 0)):
        if spark.catalog.tableExists(_quoted(journal_name(name))):
            _overwrite(spark, name, int(given["compacting"]))
        else:
            _set(spark, name, {"compacting": 0})
        given = collection_properties(spark, name)
    return given


def apply_changes(
    spark: SparkSession, name: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None, **facts: object
) -> int:
    """Adds a version: points that replace those of their ids or are new, and ids to remove.

    An id in both is replaced. Ids repeated within ``upserts`` are an error, ids to remove
    that are no points do nothing. ``facts`` become properties in the same step that
    makes the version count. Returns its number.
    """
    given = recover(spark, name)
    _parts(given, name)
    version = int(given.get("version", 0)) + 1
    none = spark.table(_quoted(name)).drop("part").limit(0)
    new = none if upserts is None else as_points(spark, name, upserts, given)
    if upserts is not None:
        check_single(new)
    rows = new.withColumn("deleted", F.lit(False))
    if deletes is not None:
        gone = deletes.select(F.col("id").cast("bigint").alias("id")).distinct()
        if upserts is not None:
            gone = gone.join(broadcast_if_small(new.select("id")), "id", "left_anti")
        rows = rows.unionByName(gone.withColumn("deleted", F.lit(True)), allowMissingColumns=True)
    rows = rows.filter("id IS NOT NULL").withColumn("version", F.lit(version).cast("bigint"))
    table = _quoted(changes_name(name))
    if spark.catalog.tableExists(table):
        # A version of this number that is there already broke off before it counted.
        overwrite_partitions(rows, table)
    else:
        writer = rows.write.format("parquet").partitionBy("version")
        if given.get("external") == "true":
            writer = writer.option("path", shared_dir(spark, "collections", changes_name(name)))
        writer.saveAsTable(table)
    _set(spark, name, {"version": version, **facts})
    return version


def upsert_into(spark: SparkSession, name: str, points: DataFrame) -> int:
    return apply_changes(spark, name, upserts=points)


def delete_from(spark: SparkSession, name: str, ids: DataFrame) -> int:
    return apply_changes(spark, name, deletes=ids)


def points_of_ids(spark: SparkSession, name: str, ids: DataFrame) -> DataFrame:
    """The collection's points of these ids; only the parts they lie in are read."""
    given = recover(spark, name)
    count = _parts(given, name)
    wanted = stored(ids.select(F.col("id").cast("bigint").alias("id")).distinct())
    # At most one number for each part.
    touched = [r.part for r in wanted.select(part_of("id", count).alias("part")).distinct().collect()]
    held = spark.table(_quoted(name)).filter(F.col("part").isin(touched) & F.col("id").isNotNull()).drop("part")
    small = broadcast_if_small(wanted)
    pending = pending_changes(spark, name, given)
    if pending is not None:
        pending = pending.join(small, "id", "left_semi")
    return merge_changes(held.join(small, "id", "left_semi"), pending)


def set_payloads_in(spark: SparkSession, name: str, updates: DataFrame) -> int:
    """Merges a table of (id, payload) into the points of those ids; unknown ids do nothing."""
    check_single(updates)
    updates = stored(updates.select(F.col("id").cast("bigint").alias("id"), F.col("payload").alias("new_payload")))
    found = points_of_ids(spark, name, updates).join(broadcast_if_small(updates), "id")
    changed = found.withColumn("payload", merged(F.col("payload"), F.col("new_payload"))).drop("new_payload")
    return apply_changes(spark, name, upserts=stored(changed))


def compact(spark: SparkSession, name: str) -> list[int]:
    """Brings pending changes into the table; only the parts they lie in are written. Returns these."""
    given = recover(spark, name)
    count, version = _parts(given, name), int(given.get("version", 0))
    pending = pending_changes(spark, name, given)
    if pending is None:
        return []
    touched = sorted(r.part for r in pending.select(part_of("id", count).alias("part")).distinct().collect())
    columns = spark.table(_quoted(name)).columns
    held = spark.table(_quoted(name)).filter(F.col("part").isin(touched) & F.col("id").isNotNull())
    merged_rows = merge_changes(held.drop("part"), pending).withColumn("part", part_of("id", count))
    # A part that lost all its points keeps a row without id, so that it is overwritten too.
    marks = spark.createDataFrame([(p,) for p in touched], "part int")
    rows = merged_rows.unionByName(marks, allowMissingColumns=True).select(*columns).repartitionById(count, F.col("part"))
    journal = _quoted(journal_name(name))
    spark.sql(f"DROP TABLE IF EXISTS {journal}")
    _set(spark, name, {"compacting": version})
    writer = rows.write.format("parquet").partitionBy("part")
    if given.get("external") == "true":
        writer = writer.option("path", shared_dir(spark, "collections", journal_name(name)))
    writer.saveAsTable(journal)
    _overwrite(spark, name, version)
    return touched


def _overwrite(spark: SparkSession, name: str, version: int) -> None:
    """Puts the journal's parts in place of the table's, and lets the changes in them go."""
    journal, table = _quoted(journal_name(name)), _quoted(name)
    count = int(collection_properties(spark, name)["parts"])
    overwrite_partitions(spark.table(journal).repartitionById(count, F.col("part")), table)
    _set(spark, name, {"compacted": version})
    spark.sql(f"DROP TABLE {journal}")
    given = collection_properties(spark, name)
    if int(given.get("version", 0)) == version:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(changes_name(name))}")
