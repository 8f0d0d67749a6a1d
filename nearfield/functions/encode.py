"""Encoders: text columns to dense and sparse vector columns.

Every encoder works row by row on Arrow batches, so encoding never shuffles the text.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from hashlib import md5
from types import ModuleType
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.text import bare_text, clean_text, word_count
from nearfield.schema import SPARSE_TYPE
from nearfield.session import MAX_BROADCAST_ROWS, give_back

# BM25 saturation and length weight.
BM25_K1 = 1.2
BM25_B = 0.75

# What is split into words and weighed at a time: so many rows and bytes of text.
HELD_ROWS = 512
HELD_BYTES = 2 << 20
LOW_31_BITS = 0x7FFFFFFF

# What one call of a user's model gets at most.
MODEL_ROWS = 256
MODEL_BYTES = 4 << 20


class Encoder(Protocol):
    def transform(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame: ...


def _word_codes(words: pa.StringArray) -> np.ndarray:
    """The first 36 bits of each word's md5.

    They are taken from Arrow's bytes and not remembered: making Python strings of the words
    and looking them up takes longer than hashing them, and a memory of words grows with the input.
    """
    if not len(words):
        return np.empty(0, np.int64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].tolist()
    octets = memoryview(data or b"")
    digests = b"".join([md5(octets[a:b]).digest() for a, b in zip(ends, ends[1:])])
    return (np.frombuffer(digests, ">u8")[::2] >> np.uint64(28)).astype(np.int64)


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, so many rows and bytes at a time, but at least one."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        fit = int(np.searchsorted(ends, before + HELD_BYTES, "right"))
        stop = min(start + HELD_ROWS, max(start + 1, fit))
        yield texts.slice(start, stop - start)
        start = stop


def _batch_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row number, word code) of every word in a few texts without punctuation.

    Arrow splits the texts and numbers their distinct words; only those are hashed.
    """
    split = pc.utf8_split_whitespace(texts.cast(pa.string()).fill_null(""))
    rows = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    words = pc.dictionary_encode(split.flatten())
    places = words.indices.to_numpy(zero_copy_only=False)
    blank = words.dictionary.index("").as_py()
    if blank >= 0:
        # Blanks at an end leave an empty word there.
        kept = places != blank
        rows, places = rows[kept], places[kept]
    return rows, _word_codes(words.dictionary)[places]


def _list_array(values: np.ndarray, sizes: np.ndarray | list[int], dtype: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=dtype))


class HashingEncoder:
    """Dense default: signed hashed bag of words, of unit length by default.

    It stands in where no pretrained model is at hand; ``ModelEncoder`` takes its place.
    """

    def __init__(self, dim: int = 64, normalise: bool = True) -> None:
        self.dim = dim
        self.normalise = normalise

    def column(self, text: Column) -> Column:
        dim, normalise = self.dim, self.normalise

        @F.arrow_udf("array<float>")
        def encode(batch: pa.Array) -> pa.Array:
            made = [np.empty((0, dim), np.float32)]
            for piece in _pieces(batch):
                rows, codes = _batch_codes(piece)
                sign = np.where(codes & 15 < 8, 1.0, -1.0)
                cells = rows * dim + (codes >> 4) % dim
                counts = np.bincount(cells, weights=sign, minlength=len(piece) * dim)
                vectors = counts.reshape(len(piece), dim)
                if normalise:
                    length = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
                    vectors = vectors / np.where(length > 0, length, 1)
                made.append(vectors.astype(np.float32))
            give_back()
            return _list_array(np.concatenate(made).ravel(), [dim] * len(batch), pa.float32())

        return encode(bare_text(text))

    def transform(self, df: DataFrame, text_col: str, out_col: str = "dense") -> DataFrame:
        return df.withColumn(out_col, self.column(F.col(text_col)))


def _loaded(key: str, load: Callable[[], Callable]) -> Callable:
    """The model of that key, loaded by the first task of a worker process.

    Spark keeps worker processes between tasks, but unpickles functions for each; a
    module is what tasks of one process share. The last model only is kept.
    """
    held = sys.modules.setdefault("_nearfield_model", ModuleType("_nearfield_model"))
    if getattr(held, "key", None) != key:
        held.model, held.key = load(), key
    return held.model


def _calls(texts: pa.Array, rows: int, octets: int) -> Iterator[list[str]]:
    """The texts in order, for calls of a model: so many rows and bytes each, but at least one text."""
    part: list[str] = []
    size = 0
    for text in texts:
        value = text.as_py() or ""
        length = len(value.encode("utf-8", "surrogatepass"))
        if part and (len(part) >= rows or size + length > octets):
            yield part
            part, size = [], 0
        part.append(value)
        size += length
    if part:
        yield part


class ModelEncoder:
    """Dense vectors from a user's model.

    ``load`` runs once per worker process and returns a function from a list of texts to
    a matrix with one row per text. A call gets at most ``batch_rows`` texts of at most
    ``batch_bytes`` together, but at least one. ``out_col`` is by custom the model's name.
    """

    def __init__(
        self, load: Callable[[], Callable], normalise: bool = True, batch_rows: int = MODEL_ROWS, batch_bytes: int = MODEL_BYTES
    ) -> None:
        if batch_rows < 1 or batch_bytes < 1:
            raise ValueError("batch_rows and batch_bytes must be positive")
        self.load = load
        self.normalise = normalise
        self.batch_rows, self.batch_bytes = batch_rows, batch_bytes
        self.key = uuid.uuid4().hex

    def column(self, text: Column) -> Column:
        key, load, normalise = self.key, self.load, self.normalise
        rows, octets = self.batch_rows, self.batch_bytes

        @F.arrow_udf("array<float>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = _loaded(key, load)
            for batch in batches:
                texts = len(batch)
                if not texts:
                    yield pa.array([], type=pa.list_(pa.float32()))
                    continue
                vectors = np.concatenate([np.asarray(model(part), dtype=np.float64) for part in _calls(batch, rows, octets)])
                if normalise:
                    length = np.linalg.norm(vectors, axis=1, keepdims=True)
                    vectors = vectors / np.where(length > 0, length, 1)
                flat = vectors.astype(np.float32).ravel()
                yield _list_array(flat, [vectors.shape[1]] * texts, pa.float32())

        return encode(text)

    def transform(self, df: DataFrame, text_col: str, out_col: str = "dense") -> DataFrame:
        return df.withColumn(out_col, self.column(F.col(text_col)))


class SparseModelEncoder:
    """Sparse vectors from a user's model, such as one that weighs terms.

    ``load`` runs once per worker process and returns a function from a list of texts to one
    (indices, values) pair per text. Weights of one index are added up, those of zero left
    out, indices sorted; a null text gets no vector. Calls are as for ``ModelEncoder``.
    """

    def __init__(self, load: Callable[[], Callable], batch_rows: int = MODEL_ROWS, batch_bytes: int = MODEL_BYTES) -> None:
        if batch_rows < 1 or batch_bytes < 1:
            raise ValueError("batch_rows and batch_bytes must be positive")
        self.load = load
        self.batch_rows, self.batch_bytes = batch_rows, batch_bytes
        self.key = uuid.uuid4().hex

    def column(self, text: Column) -> Column:
        key, load, rows, octets = self.key, self.load, self.batch_rows, self.batch_bytes

        @F.arrow_udf(SPARSE_TYPE)
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = _loaded(key, load)
            for batch in batches:
                sizes, indices, values = [], [np.empty(0, np.int32)], [np.empty(0, np.float32)]
                for part in _calls(batch, rows, octets):
                    made = list(model(part))
                    if len(made) != len(part):
                        raise ValueError(f"the model returned {len(made)} vectors for {len(part)} texts")
                    for index, value in made:
                        index, value = np.asarray(index, np.int64), np.asarray(value, np.float64)
                        if len(index) != len(value):
                            raise ValueError(f"the model returned {len(index)} indices with {len(value)} values")
                        if len(index) and not 0 <= index.min() <= index.max() <= LOW_31_BITS:
                            raise ValueError("indices must be between 0 and 2^31 - 1")
                        own, at = np.unique(index, return_inverse=True)
                        total = np.bincount(at, weights=value, minlength=len(own)).astype(np.float32)
                        kept = total != 0
                        indices.append(own[kept].astype(np.int32))
                        values.append(total[kept])
                        sizes.append(int(kept.sum()))
                lists = [_list_array(np.concatenate(indices), sizes, pa.int32()), _list_array(np.concatenate(values), sizes, pa.float32())]
                yield pa.StructArray.from_arrays(lists, names=["indices", "values"], mask=batch.is_null())

        return encode(text)

    def transform(self, df: DataFrame, text_col: str, out_col: str = "sparse") -> DataFrame:
        return df.withColumn(out_col, self.column(F.col(text_col)))


def word_counts(text: Column) -> Column:
    """Sparse vector of how often each word occurs, indexed by 31 bits of its md5."""

    @F.arrow_udf(SPARSE_TYPE)
    def encode(batch: pa.Array) -> pa.Array:
        sizes, indices, counts = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.float32)]
        for piece in _pieces(batch):
            rows, codes = _batch_codes(piece)
            words, count = np.unique(rows << 31 | (codes >> 4 & LOW_31_BITS), return_counts=True)
            sizes.append(np.bincount(words >> 31, minlength=len(piece)))
            indices.append((words & LOW_31_BITS).astype(np.int32))
            counts.append(count.astype(np.float32))
        give_back()
        size = np.concatenate(sizes)
        return pa.StructArray.from_arrays(
            [
                _list_array(np.concatenate(indices), size, pa.int32()),
                _list_array(np.concatenate(counts), size, pa.float32()),
            ],
            names=["indices", "values"],
        )

    return encode(bare_text(text))


def _length(counts: Column) -> Column:
    return F.aggregate(counts["values"], F.lit(0.0), lambda total, x: total + x)


def _bm25(counts: Column, mean: Column) -> Column:
    """Weights of counted words, given the mean text length; the indices stay as they are."""

    @F.arrow_udf("array<float>")
    def weigh(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for listed, mean_lengths in batches:
            mean = (mean_lengths[0].as_py() if len(mean_lengths) else None) or 1.0
            weights = [np.empty(0, np.float32)]
            for start in range(0, len(listed), HELD_ROWS):
                piece = listed.slice(start, HELD_ROWS)
                sizes = pc.list_value_length(piece).fill_null(0).to_numpy()
                row = np.repeat(np.arange(len(piece)), sizes)
                count = piece.flatten().to_numpy().astype(np.float64)
                share = np.bincount(row, weights=count, minlength=len(piece)) / mean
                shrink = BM25_K1 * (1 - BM25_B + BM25_B * share)
                weight = count * (BM25_K1 + 1) / (count + shrink[row])
                weights.append(weight.astype(np.float32))
            give_back()
            sizes = pc.list_value_length(listed).fill_null(0).to_numpy()
            yield _list_array(np.concatenate(weights), sizes, pa.float32())

    return F.struct(counts["indices"].alias("indices"), weigh(counts["values"], mean).alias("values"))


def bm25_weights(counted: DataFrame, using: str = "sparse") -> DataFrame:
    """Turns stored word counts into BM25 weights, with one look at the text in all."""
    mean = counted.agg(F.avg(_length(F.col(using)))).scalar()
    return counted.withColumn(using, _bm25(F.col(using), mean))


class Bm25Encoder:
    """Sparse default: BM25 weights of the words.

    A document's values hold the saturated term frequency, a query's values the
    inverse document frequency, so that their inner product is the BM25 score.
    ``fit`` needs a pass of its own for the mean length, which stays on the executors;
    where counts are stored on the way, ``bm25_weights`` saves that pass.
    """

    def __init__(self, mean_length: Column) -> None:
        self.mean_length = mean_length

    @classmethod
    def fit(cls, df: DataFrame, text_col: str) -> Bm25Encoder:
        words = F.coalesce(word_count(F.col(text_col)), F.lit(0))
        return cls(df.agg(F.avg(words)).scalar())

    def transform(self, df: DataFrame, text_col: str, out_col: str = "sparse") -> DataFrame:
        counted = df.withColumn(out_col, word_counts(F.col(text_col)))
        return counted.withColumn(out_col, _bm25(F.col(out_col), self.mean_length))


def query_weights(
    queries: DataFrame, documents: DataFrame, text_col: str = "text", using: str = "sparse"
) -> DataFrame:
    """Sparse queries: one inverse document frequency per distinct word.

    ``documents`` holds the encoded collection. Words that no query asks for drop out
    where they lie, and the others are counted before they are shuffled.
    """
    code = F.conv(F.substring(F.md5(F.col("word")), 1, 8), 16, 10).cast("bigint")
    words = queries.select(
        "query_id", F.explode(F.array_distinct(F.split(clean_text(F.col(text_col)), " "))).alias("word")
    ).filter("word <> ''")
    asked = words.select("query_id", code.bitwiseAND(LOW_31_BITS).cast("int").alias("index")).distinct()
    # explode_outer: plain explode would add a filter that encodes every text twice.
    listed = documents.select(F.explode_outer(F.col(using)["indices"]).alias("index"))
    vocabulary = asked.select("index").distinct()
    if vocabulary.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        listed = listed.join(F.broadcast(vocabulary), "index", "left_semi")
    frequency = listed.groupBy("index").agg(F.count("*").alias("df"))
    total = documents.agg(F.count("*")).scalar()
    idf = F.log1p((total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = (
        asked.join(frequency, "index")
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("index", idf.cast("float").alias("value")))).alias("w"))
    )
    sparse = F.struct(F.col("w.index").alias("indices"), F.col("w.value").alias("values"))
    return queries.join(weights.select("query_id", sparse.alias(using)), "query_id", "left")
