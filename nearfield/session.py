"""Session helpers: code shipping, the shared working folder, memory of workers."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A table is broadcast only when it was measured and has at most so many rows and bytes.
MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 << 20


def ship_package() -> None:
    """Send this package's functions by value, so workers need no install of it."""
    cloudpickle.register_pickle_by_value(sys.modules["nearfield"])


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh path below the folder every executor can reach.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a
    local session may go without; it then gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        # Where the master cannot be read the session may well be a cluster's.
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="nearfield-")
    return "/".join([root.rstrip("/"), "nearfield", *parts, uuid.uuid4().hex])


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder and read from there.

    For results that several later jobs need: they survive the loss of executors.
    """
    path = shared_dir(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def give_back() -> None:
    """Returns freed memory to the system: workers are kept for later tasks, what they freed need not be."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: strings by their length, lists by that of their elements."""

    def size(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.NumericType | T.BooleanType | T.DateType | T.TimestampType):
                return F.greatest(F.size(value), F.lit(0)).cast("bigint") * 8
            each = F.aggregate(value, F.lit(0).cast("bigint"), lambda total, x: total + size(x, kind.elementType))
            return F.coalesce(each, F.lit(0).cast("bigint"))
        if isinstance(kind, T.MapType):
            return size(F.map_keys(value), T.ArrayType(kind.keyType)) + size(F.map_values(value), T.ArrayType(kind.valueType))
        if isinstance(kind, T.StructType):
            return reduce(add, (size(value[f.name], f.dataType) for f in kind), F.lit(0).cast("bigint"))
        return F.lit(8).cast("bigint")

    return reduce(add, (size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16).cast("bigint"))


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Marks ``df`` for broadcast if a look at it, stopped at the bound, finds it small in rows and bytes."""
    seen = df.limit(max_rows + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if seen["rows"] <= max_rows and seen["bytes"] <= max_bytes else df
