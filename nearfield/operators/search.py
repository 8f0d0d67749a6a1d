"""Dense, sparse and hybrid search, each for a whole table of queries at once."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.topk import Branch, partial_hits, rank_hits, topk
from nearfield.schema import DEFAULT_LIMIT, OVER_FETCH, UNKNOWN_LABEL
from nearfield.sources.collection import collection_properties, open_collection

# Rank fusion adds 1 / (constant + rank), ranks counted from zero.
FUSION_CONSTANT = 2

# Hits are broadcast to the points only when they are at most this many.
MAX_BROADCAST_HITS = 1_000_000

# So few hits are fetched, and their ids become ranges that the payload scan can skip by.
MAX_FETCHED_HITS = 10_000
ID_RANGES = 128


def _id_ranges(ids: list[int]) -> list[tuple[int, int]]:
    """Ranges that cover the ids, parted at the widest gaps."""
    ids = sorted(set(ids))
    apart = [i for i in range(1, len(ids)) if ids[i] - ids[i - 1] > 1]
    gaps = sorted(apart, key=lambda i: ids[i - 1] - ids[i])[: ID_RANGES - 1]
    cuts = [0, *sorted(gaps), len(ids)]
    return [(ids[a], ids[b - 1]) for a, b in zip(cuts, cuts[1:]) if a < b]


def _near(payload: DataFrame, ids: list[int]) -> DataFrame:
    """The rows in the ids' ranges: the scan skips files, row groups and pages of others."""
    within = [F.col("id").between(a, b) for a, b in _id_ranges(ids)]
    return payload.filter(reduce(or_, within, F.lit(False)))


def shape_hits(
    hits: DataFrame, points: DataFrame, most: int | None, payload: DataFrame | None = None, by_id: bool = False
) -> DataFrame:
    """Adds label and text to ranked hits.

    Few hits (by the number of queries) are broadcast to the points; more meet them by id.
    Points that lie in files ``by_id``: at most 10,000 hits are found first, so that the
    payload scan can skip what lies outside their ids. A missing label reads ``unknown``;
    text stays null where the points have none.
    """
    points = points if payload is None else payload
    if by_id and most is not None and most <= MAX_FETCHED_HITS and "text" in points.columns:
        found = hits.toArrow()
        hits = F.broadcast(hits.sparkSession.createDataFrame(found))
        points = _near(points, found.column("id").to_pylist())
    elif most is not None and most <= MAX_BROADCAST_HITS:
        hits = F.broadcast(hits)
    label = F.col("label").cast("string") if "label" in points.columns else F.lit(None).cast("string")
    text = F.col("text") if "text" in points.columns else F.lit(None).cast("string")
    shown = points.select(F.col("id").cast("bigint").alias("id"), label.alias("label"), text.alias("text"))
    return shown.join(hits, "id").select(
        "query_id",
        "rank",
        "id",
        "score",
        F.coalesce("label", F.lit(UNKNOWN_LABEL)).alias("label"),
        "text",
    )


def _chosen(points: DataFrame, condition: Column | None) -> DataFrame:
    return points if condition is None else points.filter(condition)


def dense_search(
    points: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_LIMIT,
    distance: str = "Cosine",
    condition: Column | None = None,
    using: str = "dense",
    payload: DataFrame | None = None,
    by_id: bool = False,
) -> DataFrame:
    """The k nearest points of every query.

    ``queries``: query_id, the vector column, and optionally label (exact match),
    threshold (a lower bound, for Euclid an upper bound) and k, per query.
    ``condition`` restricts the points for all queries, e.g. to one shard key.
    ``payload`` may name another table to read the hits' label and text from; ``by_id``
    says that it lies in files by id.
    """
    points = _chosen(points, condition)
    hits, most = topk(points, queries, Branch(using, distance), k)
    return shape_hits(hits, points, most, payload, by_id)


def sparse_search(
    points: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_LIMIT,
    condition: Column | None = None,
    using: str = "sparse",
    payload: DataFrame | None = None,
) -> DataFrame:
    """The k points of largest inner product; points sharing no index are no hits."""
    points = _chosen(points, condition)
    hits, most = topk(points, queries, Branch(using, "Dot"), k)
    return shape_hits(hits, points, most, payload)


def hybrid_search(
    points: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_LIMIT,
    distance: str = "Cosine",
    condition: Column | None = None,
    constant: float = FUSION_CONSTANT,
    dense: str = "dense",
    sparse: str = "sparse",
    payload: DataFrame | None = None,
) -> DataFrame:
    """Dense and sparse ranking, each 2k deep, fused by reciprocal rank.

    Both rankings come from one pass over the points. Filters apply to both before
    they are cut; a score threshold does not apply to fused scores.
    """
    points = _chosen(points, condition)
    branches = [Branch(dense, distance, OVER_FETCH), Branch(sparse, "Dot", OVER_FETCH)]
    hits, deepest, shipped = partial_hits(points, queries.drop("threshold"), branches, k)
    each = rank_hits(hits, deepest * OVER_FETCH, ("query_id", "source"))
    fused = (
        each.filter(F.col("rank") <= F.col("k") * OVER_FETCH)
        .groupBy("query_id", "k", "id")
        .agg(F.round(F.sum(1 / (F.lit(float(constant)) + F.col("rank") - 1)), 6).alias("gain"))
    )
    best = rank_hits(fused, deepest).filter(F.col("rank") <= F.col("k"))
    best = best.withColumnRenamed("gain", "score")
    most = None if shipped is None else shipped * deepest
    return shape_hits(best.select("query_id", "rank", "id", "score"), points, most, payload)


def search_collection(
    spark: SparkSession,
    name: str,
    queries: DataFrame,
    k: int = DEFAULT_LIMIT,
    distance: str | None = None,
    condition: Column | None = None,
    shards: list | None = None,
) -> DataFrame:
    """Dense search of a saved collection, by the distance and vector it was created with.

    The queries' vectors are in a column of the collection's vector name, or in ``dense``.
    A ``distance`` other than the collection's is an error.
    """
    given = collection_properties(spark, name)
    vector = given.get("vector", "dense")
    if distance not in (None, given["distance"]):
        raise ValueError(f"collection {name!r} was created for {given['distance']}, not {distance}")
    if vector not in queries.columns:
        queries = queries.withColumnRenamed("dense", vector)
    points = open_collection(spark, name, shards)
    # Buckets hold their points in the order of id.
    by_id = not ({"shard_key", "parts", "code_bits"} & given.keys() or any(k.startswith("field.") for k in given))
    return dense_search(points, queries, k, given["distance"], condition, using=vector, by_id=by_id)
