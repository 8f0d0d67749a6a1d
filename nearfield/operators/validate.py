"""Checks of points and queries: every row gets the reason it fails, or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.text import strip
from nearfield.schema import DEFAULT_LIMIT, MAX_LIMIT


def _first_reason(checks: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(failed, F.lit(reason)) for failed, reason in checks])


def check_points(points: DataFrame, dim: int | None = None) -> DataFrame:
    """Adds ``reason``; with ``dim``, vectors of another size fail too."""
    vector = F.col("dense")
    checks = [
        (F.col("id").isNull() | (F.col("id") < 0), "id is missing or negative"),
        (vector.isNull() | (F.size(vector) == 0), "vector is missing or empty"),
        (F.exists(vector, lambda x: x.isNull() | F.isnan(x)), "vector holds a non-number"),
    ]
    if dim is not None:
        checks.append((F.size(vector) != dim, "vector has another size"))
    if "sparse" in points.columns:
        uneven = F.size("sparse.indices") != F.size("sparse.values")
        checks.append((uneven, "sparse indices and values differ in number"))
    return points.withColumn("reason", _first_reason(checks))


def check_queries(queries: DataFrame) -> DataFrame:
    """Adds ``reason``, strips the text, lower-cases the label and fills in the limit.

    ``queries``: query_id, text, and optionally label, threshold (0 to 1) and k (1 to 1000).
    """
    given = queries.columns
    text = strip(F.col("text"))
    checks = [(text.isNull() | (text == ""), "query text is blank")]
    out = queries.withColumn("text", text)
    if "threshold" in given:
        out_of_range = ~F.col("threshold").between(0.0, 1.0)
        checks.append((out_of_range, "threshold is not between 0 and 1"))
    if "k" in given:
        depth = F.coalesce(F.col("k"), F.lit(DEFAULT_LIMIT))
        checks.append((~depth.between(1, MAX_LIMIT), f"limit is not between 1 and {MAX_LIMIT}"))
        out = out.withColumn("k", depth)
    if "label" in given:
        label = strip(F.lower("label"))
        out = out.withColumn("label", F.when(F.col("label") != "", label))
    return out.withColumn("reason", _first_reason(checks))


def valid(checked: DataFrame) -> DataFrame:
    return checked.filter("reason is null").drop("reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter("reason is not null")
