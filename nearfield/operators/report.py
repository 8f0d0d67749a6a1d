"""Result tables made ready for reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.text import preview, score_text, truncate

# Fixed value: characters of text shown in a report.
REPORT_TEXT = 200


def result_report(results: DataFrame) -> DataFrame:
    """(query_id, rank, score_text, label, text_shown, preview)."""
    return results.select(
        "query_id",
        "rank",
        score_text(F.col("score")).alias("score_text"),
        "label",
        truncate(F.col("text"), REPORT_TEXT).alias("text_shown"),
        preview(F.col("text")).alias("preview"),
    )
