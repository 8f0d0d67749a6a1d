"""Document fingerprints: the k least hashes of a text's word shingles (bottom-k sketch).

Sketches are sorted arrays of 64-bit hashes, made, merged and compared with SQL functions
alone. Of two sketches, the k least hashes of their union sample the union of the shingles;
the share of them that both have estimates the resemblance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import fresh, stored

SHINGLE_WORDS = 5
SKETCH_SIZE = 64
# Blanks between words: space and \t \n \v \f \r.
BLANKS = r"[ \t-\r]+"


def with_sketch(
    df: DataFrame, text_col: str, out_col: str, k: int = SKETCH_SIZE, size: int = SHINGLE_WORDS
) -> DataFrame:
    """``df`` with the sketch of ``text_col``: at most ``k`` hashes, ascending; null texts are empty.

    Shingles are runs of ``size`` words; a text of fewer words is one shingle, one of none has
    an empty sketch. Equal texts have equal sketches.
    """
    words = fresh(df, "words")
    # A column of its own: inside the lambda the split would be made anew for each word.
    split = df.withColumn(words, F.array_remove(F.split(F.coalesce(text_col, F.lit("")), BLANKS), ""))
    w, n = F.col(words), F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(size))))
    hashes = F.when(n >= size, runs).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
    least = F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)
    kept = [c for c in df.columns if c != out_col]
    return split.select(*kept, least.alias(out_col))


def fingerprint(sketch: Column) -> Column:
    """The sketch as a string: 16 hex digits for each hash; of no hashes, the empty string."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def distinct_shingles(sketch: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(sketch, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated share of the shingles of either text that both have; of two empty ones 1.0."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has, at most 1; of an empty ``a`` 1.0."""
    near, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), near * (n + m) / (1 + near) / n))


def merged(parts: DataFrame, key: str, sketch_col: str = "sketch", k: int = SKETCH_SIZE) -> DataFrame:
    """key, sketch of all parts of a key together: the sketch of the union of their shingles.

    Each task passes on its k least hashes of a key only, so a key may hold any share of the
    parts. A null key is a key; keys whose sketches are all empty or null have an empty one.
    """
    hashes = parts.select(F.col(key).alias("key"), F.explode_outer(sketch_col).alias("h")).distinct()
    order = Window.partitionBy("key").orderBy(F.col("h").asc_nulls_last())
    least = hashes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return least.groupBy("key").agg(F.sort_array(F.collect_list("h")).alias("sketch")).withColumnRenamed("key", key)


def previous_ids(ids: DataFrame) -> DataFrame:
    """doc_id, prev_id, prev_n for distinct (doc_id, n): the next greater id, of the greatest the least.

    Ids are dealt into ranges; each range is ordered by itself, and one row for each range
    joins it to the one before. A null id counts as the least.
    """
    n_ranges = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    down = F.col("doc_id").desc_nulls_last()
    dealt = stored(ids.repartitionByRange(n_ranges, down).withColumn("range", F.spark_partition_id()))
    ends = dealt.groupBy("range").agg(
        F.min_by(F.struct("doc_id", "n"), F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("least")
    )
    # One row for each range, not for each id.
    order = Window.orderBy("range")
    last = F.last("least").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = ends.select("range", F.coalesce(F.lag("least").over(order), last).alias("before"))
    within = Window.partitionBy("range").orderBy(down)
    row = F.lag(F.struct("doc_id", "n")).over(within)
    found = dealt.withColumn("row", row).join(F.broadcast(before), "range").withColumn("row", F.coalesce("row", "before"))
    return found.select("doc_id", F.col("row.doc_id").alias("prev_id"), F.col("row.n").alias("prev_n"))


def edit_likeness(docs: DataFrame, k: int = SKETCH_SIZE, size: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of each text and its edited text, and how alike they and the next text's are.

    The next document is the one of the next lower doc_id, of the least the one of the
    greatest; the edited text is the text with its last half replaced by as many first
    characters of the next text, or all it has. Null texts are empty; a null doc_id counts
    as the least; rows that repeat a doc_id are one document with the greatest of their texts.
    Columns other than doc_id and text are never read. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = stored(texts.select("doc_id", F.char_length("text").cast("bigint").alias("n")))
    if ids.groupBy("doc_id").count().where("count > 1").limit(1).count():
        texts = texts.groupBy("doc_id").agg(F.max("text").alias("text"))
        ids = stored(texts.select("doc_id", F.char_length("text").cast("bigint").alias("n")))
    before = previous_ids(ids)
    made = with_sketch(texts, "text", "sketch", k, size)
    links = before.select(
        F.col("doc_id").alias("its_id"), "prev_id", F.floor(F.col("prev_n") / 2).cast("int").alias("half")
    )
    # Both uses of ``made`` read one shuffle of the texts by doc_id.
    following = made.join(links, F.col("doc_id").eqNullSafe(F.col("its_id"))).select(
        "prev_id", F.expr("left(text, half)").alias("tail"), F.col("sketch").alias("next_sketch")
    )
    joined = made.join(following, F.col("doc_id").eqNullSafe(F.col("prev_id"))).withColumn(
        "n_chars", F.char_length("text").cast("bigint")
    )
    edited = joined.select(
        "doc_id", "n_chars", "sketch", "next_sketch",
        F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), "tail").alias("edited"),
    )
    hashed = edited.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    both = with_sketch(hashed, "edited", "edited_sketch", k, size)
    return both.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
    )

