"""The whole way from a Parquet source to a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.encode import Encoder
from nearfield.schema import Scenario
from nearfield.sources.collection import add_points, prepare_collection
from nearfield.sources.parquet import map_columns, payload, read_source, spread, with_row_ids


def points_of(
    source: DataFrame, scenario: Scenario, dense: Encoder, sparse: Encoder | None = None
) -> DataFrame:
    """Points of a file source: ids in file order, mapped columns, vectors, payload."""
    mapped = map_columns(spread(with_row_ids(source)), scenario, keep=["id"])
    encoded = dense.transform(mapped, "text", "dense")
    parts = ["id", "dense"]
    if sparse is not None:
        encoded = sparse.transform(encoded, "text", "sparse")
        parts.append("sparse")
    return encoded.select(*parts, "text", "label", payload().alias("payload"))


def ingest(
    spark: SparkSession,
    path: str,
    scenario: Scenario,
    dense: Encoder,
    dim: int,
    sparse: Encoder | None = None,
    **options,
) -> dict | None:
    """Loads a source into the scenario's collection and returns a summary.

    A collection that already has points is left alone (None), unless the scenario
    says to recreate it. The summary's counts are taken while the points are written.
    """
    source = read_source(spark, path)
    name = scenario.collection_name
    options = {"sparse": sparse is not None, **options}
    if not prepare_collection(spark, name, dim, recreate=scenario.recreate, **options):
        return None
    counts = Observation()
    points = points_of(source, scenario, dense, sparse).observe(
        counts, F.count("*").alias("processed"), F.count("label").alias("labelled")
    )
    add_points(spark, name, points)
    total = source.count()
    processed = counts.get["processed"]
    return {
        "dataset": scenario.name,
        "collection": name,
        "processed": processed,
        "total": total,
        "percent": 100.0 * processed / total if total else 0.0,
        "labelled": counts.get["labelled"],
        "dim": dim,
        "sparse": sparse is not None,
        "columns": scenario.columns,
    }
