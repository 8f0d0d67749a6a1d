"""Near-duplicate detection with SimHash fingerprints, compared exactly tile by tile.

Distinct fingerprints are sorted into cells by the population counts of their four 16-bit
quarters. Cells of one total count are cut into tiles of bounded size; large cells are
dealt over several tiles. Two tiles are compared by exclusive-or and bit counts unless
their population counts differ by more than the radius: the sum of the differences of
the quarters' counts never exceeds the number of differing bits, so nothing is lost.
A comparison returns a spanning forest of its links, never the links themselves.

The work of comparing grows with the square of the number of distinct fingerprints, less
what the counts exclude; memory does not: a task holds two tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import Batches, each_batch, stored, words_of
from nearfield.session import broadcast_if_small

SHINGLE_WORDS = 4
RADIUS = 4
TILE_ROWS = 32_768
QUARTERS = 4
# Rows of one tile compared with the other at once, and rows of the other: fits the cache.
STRIP, BLOCK = 16, 4_096


def shingle_hashes(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words, A-Z lower-cased, joined by a space.

    Fewer words: one hash of them all; no words: none.
    """
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words).lower()
    n = len(words) - size + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())]
    return np.array(hashes, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes; no hashes: zero."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        octets = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed number), one row for each row of ``docs``."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(shingle_hashes(t.as_py())) for t in batch.column(1)]
        bits = np.array(found, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(each_batch(make), "doc_id bigint, fp bigint")


def _quarters(fp: F.Column) -> list[F.Column]:
    mask = F.lit(0xFFFF)
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(mask)).cast("int") for i in range(QUARTERS)]


def _cut_tiles(cells: pd.DataFrame, tile_rows: int) -> pd.DataFrame:
    """Tiles of consecutive cells of one population count, and how many parts each has.

    ``cells`` has at most 17 ** 4 rows, however many fingerprints there are.
    """
    cells = cells.sort_values(["pop", "q0", "q1", "q2", "q3"]).reset_index(drop=True)
    tile, filled, last = -1, 0, None
    numbers = []
    for pop, n in zip(cells["pop"].tolist(), cells["n"].tolist()):
        if pop != last or filled + n > tile_rows:
            tile, filled, last = tile + 1, 0, pop
        filled += n
        numbers.append(tile)
    cells["tile"] = numbers
    rows = cells.groupby("tile")["n"].transform("sum")
    cells["parts"] = (-(-rows // tile_rows)).astype(int)
    return cells


def _roots(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of connected components after joining ``a`` with ``b``, each its least member."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
    return labels


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint of both tiles, the least position it is linked to, over any path.

    Positions count through ``left`` and then ``right``; None compares a tile with itself.
    """
    both = left if right is None else np.concatenate([left, right])
    labels = np.arange(len(both))
    other, shift = (left, 0) if right is None else (right, len(left))
    for i in range(0, len(left), STRIP):
        strip = left[i : i + STRIP, None]
        for j in range(i if right is None else 0, len(other), BLOCK):
            near = np.bitwise_count(strip ^ other[None, j : j + BLOCK]) <= radius
            if near.any():
                a, b = np.nonzero(near)
                labels = _roots(labels, a + i, b + j + shift)
    return labels


def _links(rows: pd.DataFrame, radius: int) -> Iterator[pd.DataFrame]:
    for packed in rows.itertuples(index=False):
        left = np.frombuffer(packed.fps_a, ">u8").astype(np.uint64)
        nodes = np.frombuffer(packed.ids_a, ">i8").astype(np.int64)
        right = None
        if packed.tile_a != packed.tile_b or packed.part_a != packed.part_b:
            right = np.frombuffer(packed.fps_b, ">u8").astype(np.uint64)
            nodes = np.concatenate([nodes, np.frombuffer(packed.ids_b, ">i8").astype(np.int64)])
        # Positions in the order of the nodes, so that the least position is the least node.
        order = np.argsort(nodes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        labels = forest(left, right, radius)
        least = np.full(len(nodes), len(nodes), np.int64)
        np.minimum.at(least, labels, place)
        roots = nodes[order[least[labels]]]
        linked = roots != nodes
        if linked.any():
            yield pd.DataFrame({"u": roots[linked], "v": nodes[linked]})


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """u, v: links that join just the nodes that are reachable over ``radius`` bits or fewer.

    ``nodes`` has distinct fingerprints: node, fp. Of two linked nodes, u is the lesser.
    """
    spark = nodes.sparkSession
    counts = [q.alias(f"q{i}") for i, q in enumerate(_quarters(F.col("fp")))]
    pop = F.bit_count("fp").cast("int").alias("pop")
    keys = ["pop", *(f"q{i}" for i in range(QUARTERS))]
    placed = nodes.select("node", "fp", pop, *counts)
    cells = _cut_tiles(placed.groupBy(keys).agg(F.count("*").alias("n")).toPandas(), tile_rows)
    schema = "pop int, q0 int, q1 int, q2 int, q3 int, n bigint, tile int, parts int"
    cells_df = spark.createDataFrame(list(cells.itertuples(index=False, name=None)), schema)
    bounds = cells_df.groupBy("tile").agg(
        F.first("pop").alias("pop"), F.first("parts").alias("parts"),
        *(f(f"q{i}").alias(f"{n}{i}") for i in range(QUARTERS) for n, f in (("lo", F.min), ("hi", F.max))),
    )
    a, b = bounds.alias("a"), bounds.alias("b")
    a = a.withColumn("near", F.explode(F.sequence(F.col("pop"), F.col("pop") + radius)))
    apart = sum(
        F.greatest(F.col(f"a.lo{i}") - F.col(f"b.hi{i}"), F.col(f"b.lo{i}") - F.col(f"a.hi{i}"), F.lit(0))
        for i in range(QUARTERS)
    )
    ordered = (F.col("a.pop") < F.col("b.pop")) | (F.col("a.tile") <= F.col("b.tile"))
    pairs = (
        a.join(b, (F.col("near") == F.col("b.pop")) & ordered & (apart <= radius))
        .select(
            F.col("a.tile").alias("tile_a"), F.col("b.tile").alias("tile_b"),
            F.explode(F.sequence(F.lit(0), F.col("a.parts") - 1)).alias("part_a"), F.col("b.parts").alias("parts_b"),
        )
        .withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
        .where("tile_a < tile_b or part_a <= part_b")
        .drop("parts_b")
    )

    def packed(side: str) -> DataFrame:
        spread = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part")
        rows = placed.join(F.broadcast(cells_df.drop("n")), keys).select("tile", spread, "node", "fp")
        both = F.sort_array(F.collect_list(F.struct("node", "fp")))
        tiles = rows.groupBy("tile", "part").agg(both.alias("m"))
        octets = lambda c: F.unhex(F.array_join(F.transform(F.col("m")[c], lambda x: F.lpad(F.hex(x), 16, "0")), ""))
        return tiles.select(
            F.col("tile").alias(f"tile_{side}"), F.col("part").alias(f"part_{side}"),
            octets("fp").alias(f"fps_{side}"), octets("node").alias(f"ids_{side}"),
        )

    tiles = stored(packed("a"))
    right = tiles.toDF("tile_b", "part_b", "fps_b", "ids_b")
    jobs = pairs.join(tiles, ["tile_a", "part_a"]).join(right, ["tile_b", "part_b"])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = jobs.repartition(n, F.xxhash64("tile_a", "part_a", "tile_b", "part_b"))

    def compare(batches: Batches) -> Batches:
        for batch in batches:
            for k in range(batch.num_rows):
                for found in _links(batch.slice(k, 1).to_pandas(), radius):
                    yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    return dealt.mapInArrow(compare, "u bigint, v bigint")


def components(links: DataFrame) -> DataFrame:
    """node, component: the least node reachable over ``links`` (u, v), for every linked node.

    Each round gives every node its least neighbour as parent, follows parents twice and
    contracts the links; a link that joins a node with itself goes. Written rounds cut the lineage.
    """
    edges = stored(links.where("u <> v").distinct())
    rounds = []
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
        parent = stored(least.select("node", F.least("node", "least").alias("parent")))
        for _ in range(2):
            up = parent.toDF("parent", "above")
            parent = parent.join(up, "parent").select("node", F.col("above").alias("parent"))
        parent = stored(parent)
        rounds.append(parent)
        pu, pv = parent.toDF("u", "pu"), parent.toDF("v", "pv")
        moved = edges.join(pu, "u").join(pv, "v").where("pu <> pv")
        edges = stored(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    if not rounds:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    found = rounds.pop()
    while rounds:
        above = found.toDF("parent", "above")
        found = rounds.pop().join(above, "parent", "left").select(
            "node", F.coalesce("above", "parent").alias("component")
        ).toDF("node", "parent")
    return found.toDF("node", "component")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row for each row of ``docs``.

    ``component_id`` is the least doc_id that links of ``radius`` bits or fewer reach.
    Null and blank texts have fingerprint zero and are linked like others. A null doc_id
    keeps its row; it never names a component unless its component has no other id.
    Repeated rows stay, in one component. An empty table gives no rows. Other columns
    than the two named are never read.
    """
    prints = stored(fingerprints(docs, id_col, text_col))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    named = nodes.where("node is not null")
    # Fingerprints that only rows without an id have still link others; they join under ids of
    # their own, below every document's, and give them up at the end.
    unnamed = nodes.where("node is null")
    if unnamed.limit(1).count():
        return _with_unnamed(prints, named, unnamed, radius, tile_rows)
    found = components(fingerprint_links(named, radius, tile_rows))
    classes = named.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return _result(prints, classes)


def _result(prints: DataFrame, classes: DataFrame) -> DataFrame:
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(classes, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def _with_unnamed(prints: DataFrame, named: DataFrame, unnamed: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """Numbers nodes by fingerprint where some have no id, then names components by least id."""
    every = named.union(unnamed).select("fp", F.col("fp").alias("node"), F.col("node").alias("least_id"))
    found = components(fingerprint_links(every.select("node", "fp"), radius, tile_rows))
    grouped = every.join(found, "node", "left").withColumn("group", F.coalesce("component", "node"))
    names = grouped.groupBy("group").agg(F.min("least_id").alias("component_id"))
    return _result(prints, grouped.join(names, "group").select("fp", "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the least id; rows without an id stay.

    Rows that repeat an id are one document.
    """
    found = near_duplicates(docs, id_col, text_col)
    dropped = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(broadcast_if_small(dropped), id_col, "left_anti").select(*docs.columns)
