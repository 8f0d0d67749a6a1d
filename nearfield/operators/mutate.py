"""Upserts, deletes and payload changes, as new versions of a points table.

A small change (its rows are counted) is broadcast, so that the points stay where they
are; a large one meets them by id, without a shuffle where the table is bucketed by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.predicates import must_not
from nearfield.session import broadcast_if_small


def latest(points: DataFrame, order_by: str) -> DataFrame:
    """Per id the row of highest ``order_by``; combined before the shuffle."""
    others = [c for c in points.columns if c not in ("id", order_by)]
    kept = F.max_by(F.struct(*others), F.col(order_by)).alias("kept")
    return points.groupBy("id").agg(kept).select("id", "kept.*")


def check_single(changes: DataFrame) -> None:
    repeated = changes.groupBy("id").count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"id {repeated[0].id} is repeated; name the column that orders its changes")


def upsert(points: DataFrame, new: DataFrame, order_by: str | None = None) -> DataFrame:
    """All points, those in ``new`` replacing the ones of the same id.

    An id repeated within ``new`` needs ``order_by``: the last write wins; without, it is
    an error.
    """
    if order_by is not None:
        new = latest(new, order_by)
    else:
        check_single(new)
    return delete_ids(points, new).unionByName(new)


def delete_ids(points: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the points listed in ``ids``; ids that are no points do nothing."""
    return points.join(broadcast_if_small(ids.select("id")), "id", "left_anti")


def delete_where(points: DataFrame, condition: Column) -> DataFrame:
    """Without the points that match; a point for which it is unknown stays."""
    return points.filter(must_not(condition))


def merged(old: Column, new: Column) -> Column:
    """Payload with the keys of ``new`` set and all others kept."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    both = F.when(old.isNull(), new).otherwise(F.map_concat(kept, new))
    return F.when(new.isNull(), old).otherwise(both)


def set_payload(points: DataFrame, condition: Column, fields: dict[str, str]) -> DataFrame:
    """Sets the given keys on the points that match."""
    new = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
    changed = F.when(condition, merged(F.col("payload"), new)).otherwise(F.col("payload"))
    return points.withColumn("payload", changed)


def set_payload_field(points: DataFrame, point_id: int, name: str, value: str) -> DataFrame:
    return set_payload(points, F.col("id") == point_id, {name: value})


def set_payloads(points: DataFrame, updates: DataFrame, order_by: str | None = None) -> DataFrame:
    """Merges a table of (id, payload) into the points, in one join.

    For an id repeated in ``updates`` the payloads are folded in ``order_by`` order:
    per key the last value wins. Without an order, a repeated id is an error.
    """
    if order_by is None:
        check_single(updates)
    else:
        entries = updates.select("id", order_by, F.explode("payload").alias("key", "value"))
        last = entries.groupBy("id", "key").agg(F.max_by("value", order_by).alias("value"))
        folded = F.map_from_entries(F.collect_list(F.struct("key", "value")))
        updates = last.groupBy("id").agg(folded.alias("payload"))
    new = updates.select("id", F.col("payload").alias("new_payload"))
    return (
        points.join(broadcast_if_small(new), "id", "left")
        .withColumn("payload", merged(F.col("payload"), F.col("new_payload")))
        .drop("new_payload")
        .select(*points.columns)
    )


def delete_fields(points: DataFrame, condition: Column, names: list[str]) -> DataFrame:
    """Removes payload keys from the points that match."""
    left = F.map_filter("payload", lambda k, _: ~k.isin(names))
    return points.withColumn("payload", F.when(condition, left).otherwise(F.col("payload")))
