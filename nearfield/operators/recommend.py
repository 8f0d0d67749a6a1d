"""Recommendation from positive and negative example points."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.distance import l2_normalise
from nearfield.operators.search import shape_hits
from nearfield.operators.topk import Branch, topk
from nearfield.schema import DEFAULT_LIMIT, LABEL_EXAMPLES
from nearfield.session import broadcast_if_small, stored


def examples_of(requests: DataFrame) -> DataFrame:
    """(query_id, id, positive) from requests with positive_ids and negative_ids."""
    given = [("positive_ids", True), ("negative_ids", False)]
    parts = [
        requests.select("query_id", F.explode(name).alias("id"), F.lit(positive).alias("positive"))
        for name, positive in given
        if name in requests.columns
    ]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def example_vectors(
    points: DataFrame, examples: DataFrame, distance: str = "Cosine", using: str = "dense"
) -> DataFrame:
    """(query_id, vector): mean of the positives, plus its lead over the negatives' mean.

    Under cosine the examples count as unit vectors. Ids that are no points, or points
    without a vector, do not count; a request without any positive point has no vector.
    """
    vector = l2_normalise(F.col(using)) if distance == "Cosine" else F.col(using)
    chosen = points.filter(F.col(using).isNotNull()).join(examples, "id")
    chosen = chosen.select("query_id", "positive", vector.alias("v"))
    mean = vector_to_array(Summarizer.mean(array_to_vector("v")))
    sides = chosen.groupBy("query_id", "positive").agg(mean.alias("mean"))
    both = sides.groupBy("query_id").agg(
        F.any_value(F.when(F.col("positive"), F.col("mean")), True).alias("pos"),
        F.any_value(F.when(~F.col("positive"), F.col("mean")), True).alias("neg"),
    )
    moved = F.zip_with("pos", "neg", lambda p, n: p + (p - n))
    return both.filter("pos is not null").select(
        "query_id", F.when(F.col("neg").isNull(), F.col("pos")).otherwise(moved).alias(using)
    )


def recommend(
    points: DataFrame,
    examples: DataFrame,
    k: int = DEFAULT_LIMIT,
    distance: str = "Cosine",
    options: DataFrame | None = None,
    condition: Column | None = None,
    using: str = "dense",
) -> DataFrame:
    """The k points nearest to each request's example vector, without its examples.

    ``examples`` has one row (query_id, id, positive) per example, so a request may
    name any number of them; few enough are broadcast, so that the points stay where
    they are. ``options`` may hold label, threshold and k per query_id;
    ``condition`` restricts the results, not the examples.
    """
    examples = stored(examples.distinct())
    queries = example_vectors(points, broadcast_if_small(examples), distance, using)
    if options is not None:
        queries = queries.join(options, "query_id", "left")
    # So many hits more are asked for as a request's own examples may take up.
    own = examples.groupBy("query_id").agg(F.count("*").alias("own"))
    wanted = F.coalesce(F.col("k"), F.lit(k)) if "k" in queries.columns else F.lit(k)
    asked = stored(queries.withColumn("wanted", wanted).join(own, "query_id").withColumn("k", F.col("wanted") + F.col("own")))
    candidates = points if condition is None else points.filter(condition)
    hits, most = topk(candidates, asked.drop("wanted", "own"), Branch(using, distance), k)
    shown = examples.select("query_id", "id")
    order = Window.partitionBy("query_id").orderBy("rank")
    left = (
        hits.join(broadcast_if_small(shown), ["query_id", "id"], "left_anti")
        .withColumn("rank", F.row_number().over(order))
        .join(asked.select("query_id", "wanted"), "query_id")
        .filter(F.col("rank") <= F.col("wanted"))
        .select("query_id", "rank", "id", "score")
    )
    return shape_hits(left, candidates, most)


def label_examples(points: DataFrame, requests: DataFrame, count: int = LABEL_EXAMPLES) -> DataFrame:
    """(query_id, id, positive): the first points, by id, of the labels asked for.

    ``requests`` has query_id, positive_label and optionally negative_label.
    """
    sides = [("positive_label", True), ("negative_label", False)]
    sides = [(name, positive) for name, positive in sides if name in requests.columns]
    names = F.explode(F.array(*[F.col(name).cast("string") for name, _ in sides])).alias("label")
    asked = requests.select(names).distinct()
    first = Window.partitionBy("label").orderBy("id")
    heads = (
        points.filter("label is not null")
        .select("id", F.col("label").cast("string").alias("label"))
        .join(broadcast_if_small(asked), "label", "left_semi")
        .withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= count)
        .drop("place")
    )
    parts = [
        requests.select("query_id", F.col(name).cast("string").alias("label"))
        .join(heads, "label")
        .select("query_id", "id", F.lit(positive).alias("positive"))
        for name, positive in sides
    ]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def recommend_by_label(
    points: DataFrame,
    requests: DataFrame,
    k: int = DEFAULT_LIMIT,
    distance: str = "Cosine",
    condition: Column | None = None,
    using: str = "dense",
) -> DataFrame:
    """``recommend`` with the first points of each label as examples.

    A request whose positive label no point carries has no hits; ``label_reasons`` says so.
    """
    return recommend(points, label_examples(points, requests), k, distance, None, condition, using)


def label_reasons(points: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` with ``reason``: why one cannot be answered, null where it can."""
    sides = [c for c in ("positive_label", "negative_label") if c in requests.columns]
    asked = requests.select(F.explode(F.array(*(F.col(c).cast("string") for c in sides))).alias("label")).distinct()
    carried = points.select(F.col("label").cast("string").alias("label"))
    known = carried.join(broadcast_if_small(asked), "label", "left_semi").distinct().withColumn("known", F.lit(True))
    known = stored(known)
    reason = F.lit(None).cast("string")
    out = requests
    for side in reversed(sides):
        kind = side.split("_")[0]
        found = known.select(F.col("label").alias(f"known_{side}"))
        label = F.col(side).cast("string")
        out = out.join(broadcast_if_small(found), label == F.col(f"known_{side}"), "left")
        unknown = F.concat(F.lit(f"no points found with {kind} label: "), label)
        absent = F.col(f"known_{side}").isNull()
        if side == "positive_label":
            reason = F.when(F.col(side).isNull(), f"{kind} label is missing").when(absent, unknown).otherwise(reason)
        else:
            reason = F.when(absent & F.col(side).isNotNull(), unknown).otherwise(reason)
    return out.withColumn("reason", reason).select(*requests.columns, "reason")
