"""The test tables as collections of points and as query tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.encode import HashingEncoder, bm25_weights, word_counts
from nearfield.schema import Scenario
from nearfield.session import stored
from nearfield.sources.parquet import read_source, spread

# Requests the queries make; the SQL beside them states the same.
DOCUMENTS = Scenario(
    name="documents",
    text_column="text",
    collection_name="documents",
    label_column="lang",
    metadata_columns=("source", "n_chars"),
    enable_sparse=True,
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_source(spark, f"{sf}/{name}.parquet")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Points without text: id, dense, label."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("dense"),
        F.col("label").cast("string").alias("label"),
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Texts: id, text, label (the language), source, n_chars."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"), "source", "n_chars"
    )


def payload_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points with a payload and, for some, a quality label: id, label, payload."""
    quality = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("label")
    )
    fields = F.create_map(
        F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"),
        F.lit("n_chars"), F.col("n_chars").cast("string"),
    )
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), fields.alias("payload"))
    return rows.join(quality, "id", "left").select("id", "label", "payload")


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """One query per label: the mean vector of its points."""
    mean = vector_to_array(Summarizer.mean(array_to_vector("dense")))
    return (
        embeddings(spark, sf)
        .groupBy("label")
        .agg(mean.alias("dense"))
        .select(F.col("label").cast("bigint").alias("query_id"), "dense")
    )


def text_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def dense_documents(spark: SparkSession, sf: str) -> DataFrame:
    return HashingEncoder().transform(spread(documents(spark, sf)), "text")


def encoded_documents(spark: SparkSession, sf: str, dense: bool = True) -> DataFrame:
    """The documents' vectors, written once: id, label, sparse, dense.

    Search reads them twice, for word counts and for scores.
    """
    texts = spread(documents(spark, sf))
    counted = texts.withColumn("sparse", word_counts(F.col("text")))
    if dense:
        counted = HashingEncoder().transform(counted, "text")
    return bm25_weights(stored(counted.drop("text", "source", "n_chars")))


def dense_queries(spark: SparkSession, sf: str) -> DataFrame:
    return HashingEncoder().transform(text_queries(spark, sf), "text")
