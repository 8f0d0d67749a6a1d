"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import (
    chat, decontaminate, fingerprint, html_text, lm_scoring, mixing, quality, repair, simhash, spelling, substrings, toxicity, warc,
)
from nearfield.llm.common import table
from nearfield.llm.oracle import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

__all__ = ["QUERIES", "SQL"]

# The mixture of op2 and of the pipeline: the SQL beside it states the same.
LEVELS = ("domain", "lang", "source")
WEIGHTS = {
    "domain": {"web": 4, "books": 3, "forums": 2, "news": 1},
    "lang": {"en": 6, "fr": 2, "de": 2, "es": 1},
    "source": {},
}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash_near_dedup(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


def with_domain(docs: DataFrame) -> DataFrame:
    """Five sources each, by their number, make a domain; others are domain ``other``.

    A column named domain is replaced.
    """
    group = F.expr("try_cast(regexp_extract(source, '^src([0-9]+)$', 1) as int) div 5")
    names = F.array(*(F.lit(d) for d in WEIGHTS["domain"]))
    return docs.withColumn("domain", F.coalesce(F.get(names, group.cast("int")), F.lit("other")))


def mixture(docs: DataFrame) -> DataFrame:
    return mixing.mix(with_domain(docs), LEVELS, WEIGHTS)


@query
def op2_mixing_sources(spark, sf):
    return mixture(table(spark, sf, "documents")).select("doc_id", *LEVELS, "epochs")


@query
def op3_chat_formatting(spark, sf):
    return chat.format_chats(table(spark, sf, "conversations"))


@query
def op4_substring_dedup(spark, sf):
    return substrings.removed_words(table(spark, sf, "documents"))


@query
def op5_decontamination(spark, sf):
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op6_quality_classifier(spark, sf):
    return quality.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op7_html_extraction(spark, sf):
    return html_text.page_texts(table(spark, sf, "pages"))


@query
def op8_warc(spark, sf):
    normal = warc.normalise(warc.write_archives(table(spark, sf, "pages")))
    records = warc.read_records(normal, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_document_fingerprints(spark, sf):
    return fingerprint.edit_likeness(table(spark, sf, "documents"))


@query
def op10_toxicity(spark, sf):
    return toxicity.toxicity_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op11_lm_scoring(spark, sf):
    return lm_scoring.scores(table(spark, sf, "documents"))


@query
def op12_spelling_variants(spark, sf):
    return spelling.spelling_variants(table(spark, sf, "documents"))


@query
def op13_conversation_repair(spark, sf):
    return repair.repair_report(table(spark, sf, "conversations"))
