"""Statistics of collections and of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.distance import norm
from nearfield.functions.text import percent


def label_distribution(points: DataFrame) -> DataFrame:
    """(label, points, percent) of the labelled points, the largest label first."""
    labels = points.select(F.col("label").cast("string").alias("label")).filter("label is not null")
    counts = labels.groupBy("label").agg(F.count("*").alias("points"))
    total = counts.agg(F.sum("points")).scalar()
    share = F.round(percent(F.col("points"), total), 6).alias("percent")
    return counts.select("label", "points", share).orderBy(F.desc("points"), "label")


def row_count(rows: DataFrame, name: str = "rows") -> DataFrame:
    return rows.agg(F.count("*").alias(name))


def collection_stats(points: DataFrame) -> DataFrame:
    """One row: points, vectors, labelled points, vector sizes and mean length."""
    return points.agg(
        F.count("*").alias("points"),
        F.count("dense").alias("vectors"),
        F.count("label").alias("labelled"),
        F.min(F.size("dense")).alias("min_size"),
        F.max(F.size("dense")).alias("max_size"),
        F.round(F.avg(norm(F.col("dense"))), 6).alias("mean_norm"),
    )


def result_stats(results: DataFrame) -> DataFrame:
    """Per query: number of hits, average score and top score."""
    return results.groupBy("query_id").agg(
        F.count("*").alias("hits"),
        F.round(F.avg("score"), 9).alias("average_score"),
        F.max_by("score", -F.col("rank")).alias("top_score"),
    )


def result_labels(results: DataFrame) -> DataFrame:
    """Per query and label: number of hits and their share in percent.

    Ordered by label name; sort by ``hits`` for the most frequent first.
    """
    counts = results.groupBy("query_id", "label").agg(F.count("*").alias("hits"))
    whole = F.sum("hits").over(Window.partitionBy("query_id"))
    share = F.round(percent(F.col("hits"), whole), 6).alias("percent")
    return counts.select("query_id", "label", "hits", share).orderBy("query_id", "label")


def search_gaps(points: DataFrame, size: int, using: str = "dense") -> DataFrame:
    """(reason, points): points that no query with vectors of ``size`` can find, counted by the first reason."""
    vector = F.col(using)
    reason = (
        F.when(F.col("id").isNull(), "id is missing")
        .when(vector.isNull(), "vector is missing")
        .when(F.size(vector) != size, "vector has another size")
    )
    return points.select(reason.alias("reason")).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("points"))
