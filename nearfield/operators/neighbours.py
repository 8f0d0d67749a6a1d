"""Approximate nearest neighbours of a table of queries, by hyperplane codes.

A point's code is the pattern of its signs on some fixed hyperplanes. A collection laid
out by code has the points of one code in files of their own. A query looks only into the
cells it most likely has neighbours in: its own code, and those reached by turning the
signs it is least sure of (multi-probe). Only those cells are read; within them points are
scored exactly, where they lie, each against the queries that probe its cell.

A query table too large to ship is cut into blocks of neighbouring codes, so that a block
probes few cells, and each block reads its own cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.operators.pairs import MAX_CODE_BITS, directions, hyperplane_code
from nearfield.operators.search import shape_hits
from nearfield.operators.topk import (
    MAX_SHIPPED_BYTES,
    MAX_SHIPPED_QUERIES,
    PARTIAL_SCHEMA,
    Branch,
    Search,
    check_query_sizes,
    point_table,
    query_blocks,
    query_table,
    rank_hits,
)
from nearfield.schema import DEFAULT_LIMIT
from nearfield.session import stored

# Points of a cell that pay for a file of their own.
CELL_POINTS = 50_000


def code_bits(points: int, cell_points: int = CELL_POINTS) -> int:
    """Signs for so many points, so that a cell of evenly spread points has about ``cell_points``."""
    return max(1, min(MAX_CODE_BITS, (max(1, points) // cell_points).bit_length()))


def probed_codes(vectors: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """Per vector the ``probes`` codes that need the least turning of its signs.

    Turning a sign costs the square of the vector's shadow on that hyperplane. The cheapest
    sets are built sign by sign: of all sets so far the ``probes`` cheapest go on.
    """
    shadows = vectors @ directions(bits, vectors.shape[1]).T
    own = (shadows >= 0) @ (1 << np.arange(bits, dtype=np.int64))
    cost, turned = np.zeros((len(vectors), 1)), np.zeros((len(vectors), 1), np.int64)
    for bit in range(bits):
        cost = np.concatenate([cost, cost + shadows[:, bit : bit + 1] ** 2], axis=1)
        turned = np.concatenate([turned, turned | 1 << bit], axis=1)
        if cost.shape[1] > probes:
            kept = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            cost, turned = np.take_along_axis(cost, kept, 1), np.take_along_axis(turned, kept, 1)
    return own[:, None] ^ turned


def _block_hits(points: DataFrame, shipped: pa.Table, branch: Branch, bits: int, probes: int) -> DataFrame:
    """Best hits per task of a block of queries, from the cells they probe alone."""
    check_query_sizes(shipped, [branch])
    asked = shipped.column(branch.asked).combine_chunks()
    usable = np.flatnonzero(asked.is_valid().to_numpy(zero_copy_only=False))
    shipped = shipped.take(pa.array(usable))
    vectors = np.array(asked.take(pa.array(usable)).to_pylist(), np.float64).reshape(len(usable), -1)
    codes = probed_codes(vectors, bits, probes) if len(usable) else np.empty((0, 0), np.int64)
    members: dict[int, np.ndarray] = {}
    order = np.argsort(codes, axis=None, kind="stable")
    values, cuts = np.unique(codes.ravel()[order], return_index=True)
    for code, rows in zip(values.tolist(), np.split(order, cuts[1:])):
        members[code] = np.sort(rows // codes.shape[1])
    # The condition on the layout column is what lets the scan leave out other cells.
    near = points.filter(F.col("code").isin(list(members))) if members else points.limit(0)
    labelled = shipped.column("query_label").null_count < shipped.num_rows
    table = point_table(near, [branch], labelled, "code")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running: dict[int, Search] = {}
        for batch in batches:
            found = batch.column("code").to_numpy(zero_copy_only=False)
            for code in np.unique(found).tolist():
                if code not in running:
                    running[code] = Search(shipped.take(pa.array(members[code])), [branch])
                running[code].feed(batch if (found == code).all() else batch.filter(pa.array(found == code)))
        for one in running.values():
            yield from one.hits()

    return table.mapInArrow(search, PARTIAL_SCHEMA)


def approximate_topk(
    points: DataFrame, queries: DataFrame, bits: int, probes: int, k: int = DEFAULT_LIMIT, branch: Branch | None = None,
    block: int = MAX_SHIPPED_QUERIES,
) -> tuple[DataFrame, int | None]:
    """(query_id, rank, id, score) of the best points found in ``probes`` of 2^bits cells, and how many at most.

    ``points`` has id, the branch's vector and ``code``, its ``hyperplane_code`` of so many
    ``bits``: best as a layout column. ``queries`` has query_id, the vector, and optionally
    label, threshold and k, as for the exact search. Scores are exact; with all cells
    probed the result is. Points and queries without a vector find nothing.
    """
    branch = branch or Branch()
    wanted = query_table(queries, [branch], k)
    shipped = wanted.limit(block + 1).toArrow()
    if shipped.num_rows <= block and shipped.nbytes <= MAX_SHIPPED_BYTES:
        hits = _block_hits(points, shipped, branch, bits, probes)
        deepest, most = max([x or 0 for x in shipped.column("k").to_pylist()] or [0]), shipped.num_rows
    else:
        size = max(1, min(block, MAX_SHIPPED_BYTES // (shipped.nbytes // shipped.num_rows + 1)))
        # Queries of neighbouring codes are read together: they probe the same cells.
        coded = wanted.withColumn("query_code", hyperplane_code(branch.asked, bits))
        hits, deepest, most = None, 0, None
        for rows in query_blocks(coded, size, "query_code", "query_id"):
            part = stored(_block_hits(points, rows.drop_columns("query_code"), branch, bits, probes))
            deepest = max([deepest, *(x or 0 for x in rows.column("k").to_pylist())])
            hits = part if hits is None else hits.unionByName(part)
    ranked = rank_hits(hits, deepest).filter(F.col("rank") <= F.col("k"))
    score = F.col("gain") * F.lit(branch.sign) + F.lit(0.0)
    return ranked.select("query_id", "rank", "id", score.alias("score")), None if most is None else most * deepest


def approximate_search(
    points: DataFrame, queries: DataFrame, bits: int, probes: int, k: int = DEFAULT_LIMIT, distance: str = "Cosine",
    condition: Column | None = None, using: str = "dense", payload: DataFrame | None = None,
) -> DataFrame:
    """``dense_search`` in the most likely cells: query_id, rank, id, score, label, text."""
    points = points if condition is None else points.filter(condition)
    if "code" not in points.columns:
        points = points.withColumn("code", hyperplane_code(using, bits))
    hits, most = approximate_topk(points, queries, bits, probes, k, Branch(using, distance))
    return shape_hits(hits, points, most, payload)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, wanted, hits: how many of the exact hits (query_id, id) the others found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("hits"))
