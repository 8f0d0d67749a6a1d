"""Parquet sources: column mapping, record checks, payloads and consecutive ids."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions.text import normalise_label, strip
from nearfield.operators.mutate import merged
from nearfield.schema import Scenario

# Fixed value: the column tried when the asked text column is missing.
FALLBACK_TEXT = "sentence"


def read_source(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Parquet file not found: {path}") from error
        raise


def spread(df: DataFrame) -> DataFrame:
    """Shares a source that fits one split out over all cores, for encoding.

    A larger source is read in splits anyway, and its text is never shuffled.
    """
    spark = df.sparkSession
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= split else df


def with_row_ids(df: DataFrame, start_id: int = 0) -> DataFrame:
    """Adds ``id``: consecutive in file order (files by name), with no global sort.

    ``df`` comes straight from a file source. The numbers rest on the rows' places in
    their files, so a task that runs again gives the same ids.
    """
    file = F.xxhash64(F.col("_metadata.file_path")).alias("file")
    sizes = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))
    # One row of two numbers per file: no more than the driver lists when it plans the scan,
    # so it is broadcast however many rows there are.
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.xxhash64("path").alias("file"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
    )
    placed = df.select("*", file, F.col("_metadata.row_index").alias("place"))
    number = F.col("offset") + F.col("place") + F.lit(start_id)
    return (
        placed.join(F.broadcast(offsets), "file")
        .withColumn("id", number.cast("bigint"))
        .select("id", *df.columns)
    )


def map_columns(df: DataFrame, scenario: Scenario, keep: list[str] | None = None) -> DataFrame:
    """(text, label, metadata) as the scenario says, all as strings; nulls stay null.

    A missing text or label column is an error, a missing metadata column is skipped.
    ``keep`` passes other columns through, e.g. an id.
    """
    for role, name in (("Text", scenario.text_column), ("Label", scenario.label_column)):
        if name and name not in df.columns:
            raise ValueError(f"{role} column '{name}' not found in source")
    found = []
    for name in scenario.metadata_columns:
        if name in df.columns:
            found.append(name)
        else:
            warnings.warn(f"Metadata column '{name}' not found, skipping", stacklevel=2)
    pairs = [x for name in found for x in (F.lit(name), F.col(f"`{name}`").cast("string"))]
    metadata = F.create_map(*pairs).cast("map<string,string>")
    label = F.col(f"`{scenario.label_column}`") if scenario.label_column else F.lit(None)
    return df.select(
        *(keep or []),
        F.col(f"`{scenario.text_column}`").cast("string").alias("text"),
        label.cast("string").alias("label"),
        metadata.alias("metadata"),
    )


def payload() -> Column:
    """Payload of mapped columns: text, label and metadata, without null values."""
    own = F.create_map(F.lit("text"), F.col("text"), F.lit("label"), F.col("label"))
    return F.map_filter(merged(own, F.col("metadata")), lambda _, v: v.isNotNull())


def checked_records(df: DataFrame, text_field: str = "text", label_field: str = "label") -> DataFrame:
    """Adds stripped ``text``, normalised ``label`` and ``valid`` to every row.

    Blank text makes a record invalid, and so does an empty label; a label of blanks
    counts as given. Without the asked text column, ``sentence`` is read.
    """
    text = text_field if text_field in df.columns else FALLBACK_TEXT
    if text not in df.columns:
        raise ValueError(f"neither '{text_field}' nor '{FALLBACK_TEXT}' found in {df.columns}")
    if label_field not in df.columns:
        raise ValueError(f"Label column '{label_field}' not found")
    raw = F.col(label_field).cast("string")
    stripped = strip(F.col(text).cast("string"))
    given = F.coalesce(stripped != "", F.lit(False)) & F.coalesce(raw != "", F.lit(True))
    others = [c for c in df.columns if c not in ("text", "label", text, label_field)]
    return df.select(
        *others, stripped.alias("text"), normalise_label(raw).alias("label"), given.alias("valid")
    )


def validated_records(
    df: DataFrame,
    text_field: str = "text",
    label_field: str = "label",
    counts: Observation | None = None,
) -> DataFrame:
    """The valid records. ``counts`` learns valid and invalid while they are read."""
    checked = checked_records(df, text_field, label_field)
    if counts is not None:
        checked = checked.observe(
            counts,
            F.count_if("valid").alias("valid"),
            F.count_if(~F.col("valid")).alias("invalid"),
        )
    return checked.filter("valid").drop("valid")
