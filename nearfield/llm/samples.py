"""Bounded samples of labelled documents, from which classifiers learn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import held_out

# Bounds of what a classifier learns from, for each label.
SAMPLE_ROWS = 4_000
SAMPLE_BYTES = 12_000_000


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, rows: int = SAMPLE_ROWS, octets: int = SAMPLE_BYTES
) -> tuple[list[tuple[int, bytes, int]], dict[int, int]]:
    """(doc_id, whole text, label) of a bounded sample, and how many labels of each kind there are.

    For each label, 0 and 1, it takes the rows with the least hash of doc_id, at most ``rows``,
    and of these each that fits into ``octets`` bytes with those taken before. Rows of the held-out fold, rows without an
    id, a text or a label of 0 or 1, and labels of unknown documents take no part.
    """
    usable = F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & ~held_out("doc_id")
    known = labels.where(usable).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    counts = {int(r.y): r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.union(part)
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").isNotNull())
    # The sample has at most 2 * ``rows`` rows of two numbers.
    found = narrow.join(F.broadcast(chosen), "doc_id")
    sizes = found.groupBy("doc_id", "y").agg(F.max(F.octet_length("text")).alias("size"), F.xxhash64("doc_id").alias("at"))
    taken, total = [], {0: 0, 1: 0}
    for r in sorted(sizes.collect(), key=lambda r: (r.at, r.doc_id)):
        # A text that does not fit is left out; those after it may fit.
        if total[r.y] + r.size <= octets:
            total[r.y] += r.size
            taken.append((r.doc_id, r.y))
    # A document that has several rows counts once, with the greatest of its texts.
    kept = F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id bigint, y int"))
    texts = narrow.join(kept, "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))
    got = texts.select("doc_id", F.encode("text", "UTF-8").alias("text"), "y").collect()
    sample = sorted((int(r.doc_id), bytes(r.text), int(r.y)) for r in got)
    return sample, {0: counts.get(0, 0), 1: counts.get(1, 0)}
