"""Helpers that several operators share: words, table reading, written intermediates."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.session import give_back, shared_dir

# Words are runs of other characters than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
# A task forgets its word hashes at this many words, to bound its memory.
WORD_CACHE = 200_000
# Rows whose texts a task holds as Python strings at a time.
HELD_ROWS = 512

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, "llm")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while True:
        name = f"{stem}_{uuid.uuid4().hex[:8]}"
        if name not in taken:
            return name


def held_out(doc_id: str | Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether the row belongs to the fold that no model may learn from; null ids do."""
    rest = F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % folds
    return F.coalesce(rest == fold, F.lit(True))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() parts at exactly the six blanks of WORD."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class WordHashes(dict):
    """word -> XXH64, remembered while a task runs."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word, 42)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(codes: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each input bit over all output bits."""
    x = codes ^ (codes >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` codes, in their order."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    return mixed(total)


def each_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Batches], Batches]:
    """``make`` over the rows of a task, so many at a time; None gives no rows."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for first in range(0, batch.num_rows, HELD_ROWS):
                made = make(batch.slice(first, HELD_ROWS))
                if made is not None and made.num_rows:
                    yield made
        give_back()

    return run


def parts(rows: int, rows_per_part: int) -> int:
    """Partitions for so many rows, at least one."""
    return max(1, -(-rows // rows_per_part))
