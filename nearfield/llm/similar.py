"""Near copies by the share of common shingles: SimHash proposes groups, the shingles decide.

Texts of one set of shingles are one node. Similar sets are of similar size, so nodes are
dealt into classes by size, and only tiles of one class or of neighbouring ones are compared,
by two fingerprints. Nodes that such candidates reach form a group; within a group the
exact similarity of every pair is computed, block by block. Only links that hold are kept,
and no step returns pairs: blocks return spanning forests of their links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import Batches, each_batch, fresh, give_back, mixed, stored
from nearfield.llm.simhash import BLOCK, STRIP, TILE_ROWS, _roots, components, fingerprint, shingle_hashes
from nearfield.session import broadcast_if_small

SHINGLE_WORDS = 5
# Links join texts whose shingles have at least LIKE / OF in common, of those that either has.
LIKE, OF = 4, 5
# Bits that may differ in the first fingerprint, and in both together. At the least similarity
# about 9.7 and 19.4 of them do; chance allows 22 and 34 in all but about 1 of 10,000 pairs.
FIRST_BITS, BITS = 22, 34
# Texts of a block whose similarity is computed at once, their shingles, and shingles at a time.
BLOCK_TEXTS, BLOCK_SHINGLES, COLUMNS = 512, 500_000, 4_096


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(shingle_hashes(text, SHINGLE_WORDS))


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), 7) - (1 << 63)


def _prints(docs: DataFrame) -> DataFrame:
    """doc_id, node (one for each set of shingles), fp, fp2, n (shingles), for each row of ``docs``."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, prints, sizes = [], [], []
        for text in batch.column(1):
            found = shingles(text.as_py())
            nodes.append(_node(found))
            prints.append((fingerprint(found), fingerprint(mixed(found))))
            sizes.append(len(found))
        bits = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
        columns = [batch.column(0), pa.array(nodes, pa.int64()), pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy()), pa.array(sizes, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "fp", "fp2", "n"])

    return docs.mapInArrow(each_batch(make), "doc_id bigint, node bigint, fp bigint, fp2 bigint, n bigint")


def _near(left: np.ndarray, right: np.ndarray | None) -> np.ndarray:
    """For each node of both tiles (columns fp, fp2, n), the least position that candidates reach."""
    other, shift = (left, 0) if right is None else (right, left.shape[1])
    labels = np.arange(left.shape[1] if right is None else left.shape[1] + right.shape[1])
    for i in range(0, left.shape[1], STRIP):
        strip = left[0, i : i + STRIP, None]
        for j in range(i if right is None else 0, other.shape[1], BLOCK):
            a, b = np.nonzero(np.bitwise_count(strip ^ other[0, None, j : j + BLOCK]) <= FIRST_BITS)
            x, y = left[:, a + i], other[:, b + j]
            bits = np.bitwise_count(x[0] ^ y[0]) + np.bitwise_count(x[1] ^ y[1])
            sized = np.minimum(x[2], y[2]) * np.uint64(OF) >= np.maximum(x[2], y[2]) * np.uint64(LIKE)
            good = (bits <= BITS) & sized
            if good.any():
                labels = _roots(labels, a[good] + i, b[good] + j + shift)
    return labels


def _linked(nodes: np.ndarray, labels: np.ndarray) -> pa.RecordBatch | None:
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    if not len(moved):
        return None
    return pa.RecordBatch.from_arrays([pa.array(nodes[labels[moved]]), pa.array(nodes[moved])], names=["u", "v"])


def _tile_pairs(tiles: DataFrame, pairs: DataFrame, keys: list[str], held: str) -> DataFrame:
    """A row for each of ``pairs`` (keys with _a and _b): ``held`` of both; of a pair of one tile the second is null."""
    a, b = (tiles.select(*(F.col(k).alias(f"{k}_{s}") for k in keys), F.col(held).alias(s)) for s in "ab")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"{k}_a") == F.col(f"{k}_b"))
    on_a, on_b = ([f"{k}_{s}" for k in keys] for s in "ab")
    alone = pairs.where(same).join(a, on_a).select("a", F.lit(None).cast(b.schema["b"].dataType).alias("b"), *on_a, *on_b)
    both = pairs.where(~same).join(a, on_a).join(b, on_b).select("a", "b", *on_a, *on_b)
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return alone.union(both).repartition(n, F.xxhash64(*on_a, *on_b)).select("a", "b")


def _candidates(nodes: DataFrame, tile_rows: int) -> DataFrame:
    """u, v: links that join just the nodes that candidates reach; ``nodes`` has node, fp, fp2, n."""
    # A class is wider than the greatest ratio of sizes, so that only neighbouring ones meet.
    sized = nodes.where("n > 0").withColumn("class", F.floor(F.log("n") / math.log(1.01 * OF / LIKE)).cast("int"))
    # One row for each class: fewer than a hundred.
    counts = {r["class"]: -(-r["count"] // tile_rows) for r in sized.groupBy("class").count().collect()}
    spark = nodes.sparkSession
    parts = spark.createDataFrame(list(counts.items()), "class int, parts int")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    placed = sized.join(F.broadcast(parts), "class").select("class", part, "node", "fp", "fp2", "n")
    tiles = stored(placed.groupBy("class", "part").agg(F.collect_list(F.struct("node", "fp", "fp2", "n")).alias("m")))
    a, b = parts.toDF("class_a", "parts_a"), parts.toDF("class_b", "parts_b")
    a = a.withColumn("class_b", F.explode(F.array(F.col("class_a"), F.col("class_a") + 1))).join(b, "class_b")
    a = a.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1)))
    a = a.withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
    pairs = a.where("class_a < class_b or part_a <= part_b").select("class_a", "part_a", "class_b", "part_b")

    def compare(batches: Batches) -> Batches:
        def columns(side: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            rows = side.flatten()
            at = [rows.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
            return at[0], np.stack([c.view(np.uint64) for c in at[1:]])

        for batch in batches:
            for k in range(batch.num_rows):
                ids, left = columns(batch.column(0).slice(k, 1))
                right = None
                if batch.column(1)[k].is_valid:
                    more, right = columns(batch.column(1).slice(k, 1))
                    ids = np.concatenate([ids, more])
                found = _linked(ids, _near(left, right))
                if found is not None:
                    yield found

    return _tile_pairs(tiles, pairs, ["class", "part"], "m").mapInArrow(compare, "u bigint, v bigint")


def alike(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets of ``left`` and ``right`` have the wanted similarity."""
    sets = left + right
    sizes = np.array([len(s) for s in sets])
    # Hashes that one set alone has are in no intersection.
    known, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, use = np.repeat(np.arange(len(sets)), sizes), times[code] > 1
    column = (np.cumsum(times > 1) - 1)[code[use]]
    row = row[use]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), np.int64)
    for first in range(0, int((times > 1).sum()), COLUMNS):
        low, high = np.searchsorted(column, [first, first + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[row[low:high], column[low:high] - first] = 1
        common += (has[: len(left)] @ has[len(left) :].T).astype(np.int64)
    either = sizes[: len(left), None] + sizes[None, len(left) :] - common
    return common * OF >= either * LIKE


def _verified(groups: DataFrame, docs: DataFrame) -> DataFrame:
    """u, v: links that join just the nodes that similar texts of a group reach.

    ``groups`` has node, group, n, least_id: a row of ``docs`` (doc_id, text) that has the node's shingles.
    """
    ids = stored(groups.select(F.col("least_id")).distinct())
    texts = docs.join(broadcast_if_small(ids), F.col("doc_id").eqNullSafe(F.col("least_id")), "left_semi")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t.as_py()) for t in batch.column(1)]
        sets = pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([_node(s) for s in found], pa.int64()), sets], names=["node", "set"])

    sets = texts.select("doc_id", "text").mapInArrow(each_batch(make), "node bigint, set binary").groupBy("node").agg(F.first("set").alias("set"))
    size = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    parts = stored(groups.groupBy("group").agg(size.alias("parts")))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    placed = groups.join(parts, "group").select("node", "group", part).join(sets, "node")
    blocks = stored(placed.groupBy("group", "part").agg(F.collect_list(F.struct("node", "set")).alias("m")))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(c)
    pairs = parts.select("group", "parts", each("part_a")).select("group", "part_a", each("part_b")).where("part_a <= part_b")
    pairs = pairs.select(F.col("group").alias("group_a"), "part_a", F.col("group").alias("group_b"), "part_b")

    def compare(batches: Batches) -> Batches:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                ids = np.array([m["node"] for m in left + (right or [])], np.int64)
                read = lambda side: [np.frombuffer(m["set"], "<u8") for m in side]
                of_left = read(left)
                a, b = np.nonzero(alike(of_left, of_left if right is None else read(right)))
                shift = 0 if right is None else len(left)
                found = _linked(ids, _roots(np.arange(len(ids)), a, b + shift))
                if found is not None:
                    yield found
        give_back()

    return _tile_pairs(blocks, pairs, ["group", "part"], "m").mapInArrow(compare, "u bigint, v bigint")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile_rows: int = TILE_ROWS) -> DataFrame:
    """doc_id, component_id, one row for each row of ``docs``.

    ``component_id`` is the least doc_id that links reach; a link joins texts whose shingles
    (five words; fewer words are one shingle) have at least 0.8 in common. Null and blank
    texts are alike. A null doc_id keeps its row and names a component only if all are null.
    """
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    prints = stored(_prints(narrow))
    firsts = [F.first(c).alias(c) for c in ("fp", "fp2", "n")]
    nodes = stored(prints.groupBy("node").agg(F.min("doc_id").alias("least_id"), *firsts))
    near = stored(components(_candidates(nodes, tile_rows)).withColumnRenamed("component", "group"))
    groups = stored(near.join(nodes.select("node", "n", "least_id"), "node"))
    found = components(_verified(groups, narrow))
    grouped = nodes.join(found, "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("group"))
    names = grouped.groupBy("group").agg(F.min("least_id").alias("component_id"))
    return prints.select("doc_id", "node").join(grouped.join(names, "group").select("node", "component_id"), "node").drop("node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the least id; rows without an id stay.

    Rows that repeat an id are one document.
    """
    gone = fresh(docs, "gone")
    found = near_copies(docs, id_col, text_col)
    dropped = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct())
    return docs.join(broadcast_if_small(dropped), F.col(id_col) == F.col(gone), "left_anti").select(*docs.columns)
