"""Points by id, in pages, and with chosen parts."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.schema import SCROLL_PAGE
from nearfield.session import broadcast_if_small

VECTORS = ("dense", "sparse")

# Longer id lists become a table that is joined.
MAX_IN_LIST = 1000


def chosen_parts(points: DataFrame, with_payload: bool = True, with_vectors: bool = False) -> DataFrame:
    """Leaves out vectors or payload, so that the scan does not read them."""
    vectors = [c for c in points.columns if c in VECTORS]
    payload = [c for c in points.columns if c not in (*VECTORS, "id")]
    return points.select("id", *(payload if with_payload else []), *(vectors if with_vectors else []))


def by_ids(
    points: DataFrame, ids: DataFrame | list[int], with_payload: bool = True, with_vectors: bool = False
) -> DataFrame:
    """The points of these ids, each once; ids that are no points are absent."""
    parts = chosen_parts(points, with_payload, with_vectors)
    if isinstance(ids, list):
        if len(ids) <= MAX_IN_LIST:
            return parts.filter(F.col("id").isin(ids))
        ids = points.sparkSession.createDataFrame([(i,) for i in ids], "id bigint")
    return parts.join(broadcast_if_small(ids.select("id")), "id", "left_semi")


def by_id(points: DataFrame, point_id: int) -> DataFrame:
    return by_ids(points, [point_id])


def scroll(
    points: DataFrame,
    offset: int | None = None,
    page_size: int = SCROLL_PAGE,
    condition: Column | None = None,
    with_payload: bool = True,
    with_vectors: bool = False,
) -> DataFrame:
    """One page in id order, from id ``offset`` on. The next page starts after its last id."""
    if condition is not None:
        points = points.filter(condition)
    if offset is not None:
        points = points.filter(F.col("id") >= offset)
    return chosen_parts(points, with_payload, with_vectors).orderBy("id").limit(page_size)


def numbered(df: DataFrame, by: str, start: int = 0, name: str = "place") -> DataFrame:
    """Adds consecutive numbers in the order of a unique number column.

    The column's range is cut at its quantiles; rows are numbered within each part, and
    the parts' sizes, a handful of rows, are added up. No task sees the whole table.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / parts for i in range(1, parts)]
    cuts = sorted(set(df.approxQuantile(by, steps, 0.25 / parts))) if steps else []
    splits = [float("-inf"), *cuts, float("inf")]
    number = F.col(by).cast("double").alias("_number")
    cut = Bucketizer(splits=splits, inputCol="_number", outputCol="_part")
    parted = cut.transform(df.select("*", number)).drop("_number")
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    # As many rows as there are parts.
    return (
        parted.withColumn("_within", within)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_within") + F.lit(start))
        .drop("_part", "_offset", "_within")
    )


def scroll_all(
    points: DataFrame,
    page_size: int = SCROLL_PAGE,
    condition: Column | None = None,
    with_payload: bool = True,
    with_vectors: bool = False,
) -> DataFrame:
    """Every point with the number of its page, counted from zero, in id order."""
    if condition is not None:
        points = points.filter(condition)
    placed = numbered(chosen_parts(points, with_payload, with_vectors), "id")
    page = F.floor(F.col("place") / F.lit(page_size)).cast("bigint")
    return placed.withColumn("page", page).drop("place")
