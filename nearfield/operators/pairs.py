"""Most similar pairs of points, by cosine.

No join ever emits all pairs. Points meet in bounded blocks; each block keeps its own
best n pairs, and the winners are chosen among those.

``most_similar_pairs`` is exact. On a large table it first finds n good pairs cheaply;
their worst score is a floor that every winner reaches, hence a radius within which
the two points of a winning pair lie. Points are then laid on a grid of cells as wide
as that radius, and only neighbouring cells are compared. Where the radius is too wide
for a grid to help, all blocks are compared: that is the price of an exact answer.

``approximate_similar_pairs`` compares only points that agree on a band of hyperplane
signs, and scores those exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.distance import SCORE_DIGITS
from nearfield.session import broadcast_if_small, stored

# Bounds: rows per block and rows of one matrix product.
PAIR_BLOCK = 8192
PAIR_CHUNK = 512
GRID_AXES = 3
# More signs than this make more cells than points are worth reading apart.
MAX_CODE_BITS = 16
# A grid pays once a cell is this much narrower than the range of random shadows.
GRID_GAIN = 0.5
ROUNDING = 10.0**-SCORE_DIGITS
# Up to this many rows per group (spark.sql.optimizer.windowGroupLimitThreshold) are kept
# by tasks before the shuffle.
GROUP_LIMIT = 1000

_PAIR_SCHEMA = "id_a bigint, id_b bigint, score double"
_PAIR_ARROW = pa.schema([("id_a", pa.int64()), ("id_b", pa.int64()), ("score", pa.float64())])


def _unit_rows(column: pa.Array) -> np.ndarray:
    """Unit vectors; a row without a direction (zero, or not all numbers) becomes NaN."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = values.reshape(len(column), -1)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    usable = np.isfinite(length) & (length > 0)
    return matrix / np.where(usable, length, np.nan)


def directions(count: int, dim: int) -> np.ndarray:
    """Fixed random signs, the same in every task: (count, dim) of +1 and -1."""
    signs = [
        1.0 if int(md5(f"{row}_{i}".encode()).hexdigest()[0], 16) < 8 else -1.0
        for row in range(count)
        for i in range(dim)
    ]
    return np.array(signs).reshape(count, dim)


def _on_directions(dense: Column, count: int, finish, width: int) -> Column:
    """``width`` numbers per vector, made by ``finish`` from its shadows on the directions.

    ``finish`` maps (vector size, shadows of the unit vectors) to a matrix of integers.
    """

    @F.arrow_udf("array<bigint>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = pc.list_value_length(batch).fill_null(0).to_numpy()
            out = np.zeros((len(batch), width), dtype=np.int64)
            for size in np.unique(sizes[sizes > 0]).tolist():
                if size not in known:
                    known[size] = directions(count, size)
                rows = np.flatnonzero(sizes == size)
                unit = _unit_rows(batch.take(pa.array(rows)))
                out[rows] = finish(size, np.nan_to_num(unit @ known[size].T))
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * width)
            yield pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return project(dense)


def band_codes(dense: Column, bits: int, bands: int) -> Column:
    """Per band, one number made of ``bits`` hyperplane signs."""

    def code(_: int, shadows: np.ndarray) -> np.ndarray:
        signs = (shadows >= 0).reshape(len(shadows), bands, bits)
        return signs @ (1 << np.arange(bits, dtype=np.int64))

    return _on_directions(dense, bits * bands, code, bands)


def hyperplane_code(vector: str | Column, bits: int) -> Column:
    """The signs of a vector on ``bits`` fixed hyperplanes as a number; a null vector has code 0."""
    if not 1 <= bits <= MAX_CODE_BITS:
        raise ValueError(f"bits must be between 1 and {MAX_CODE_BITS}, not {bits}")
    return band_codes(F.col(vector) if isinstance(vector, str) else vector, bits, 1)[0]


class _BestPairs:
    """The n best pairs so far: by rounded score, then by ids."""

    def __init__(self, n: int, floor: float | None) -> None:
        self.n = n
        self.floor = -np.inf if floor is None else floor
        self.a = self.b = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)

    def add(self, ids_a: np.ndarray, ids_b: np.ndarray, score: np.ndarray, skip: np.ndarray) -> None:
        """Scores of a block; ``skip`` marks the cells that are no pairs to consider."""
        skip = skip | np.isnan(score)
        score = np.where(skip, -np.inf, score)
        floor = self.floor - ROUNDING
        if score.size > self.n:
            floor = max(floor, np.partition(score, -self.n, axis=None)[-self.n] - ROUNDING)
        rows, columns = np.nonzero((score >= floor) & ~skip)
        first, second = ids_a[rows], ids_b[columns]
        a = np.concatenate([self.a, np.minimum(first, second)])
        b = np.concatenate([self.b, np.maximum(first, second)])
        total = np.concatenate([self.score, np.round(score[rows, columns], SCORE_DIGITS) + 0.0])
        order = np.lexsort((b, a, -total))[: self.n]
        self.a, self.b, self.score = a[order], b[order], total[order]
        if len(order) == self.n:
            self.floor = max(self.floor, self.score[-1])

    def rows(self) -> dict:
        good = self.score >= self.floor if np.isfinite(self.floor) else np.isfinite(self.score)
        return {"id_a": self.a[good], "id_b": self.b[good], "score": self.score[good]}


def _within(best: _BestPairs, ids: np.ndarray, unit: np.ndarray, home: np.ndarray) -> None:
    place = np.arange(len(ids))
    for start in range(0, len(ids), PAIR_CHUNK):
        part = slice(start, start + PAIR_CHUNK)
        skip = (place[part, None] >= place[None, start:]) | ~(home[part, None] | home[None, start:])
        best.add(ids[part], ids[start:], unit[part] @ unit[start:].T, skip)


def _between(best: _BestPairs, left: tuple, right: tuple) -> None:
    (ids, unit, home), (other_ids, other_unit, other_home) = left, right
    for start in range(0, len(ids), PAIR_CHUNK):
        part = slice(start, start + PAIR_CHUNK)
        skip = ~(home[part, None] | other_home[None, :])
        best.add(ids[part], other_ids, unit[part] @ other_unit.T, skip)


def _vectors(points: DataFrame, using: str) -> DataFrame:
    """(id, dense). Vectors without a direction are left out where they are compared:
    a filter on a column that an encoder makes would encode every text twice."""
    named = points.filter(F.col("id").isNotNull())
    return named.select(F.col("id").cast("bigint").alias("id"), F.col(using).alias("dense"))


def _few_copies(vectors: DataFrame, n: int) -> DataFrame:
    """Of equal vectors the n + 1 smallest ids.

    Exact for the n best pairs: a pair with a later copy ranks behind at least n + 1
    pairs of the same score in which one of the kept copies takes its place.
    """
    keys = [F.xxhash64("dense"), F.col("dense")]
    if n >= GROUP_LIMIT:
        # Spark then no longer cuts the groups before it shuffles them: split each first.
        vectors = _first_copies(vectors, [*keys, F.pmod(F.xxhash64("id"), F.lit(GROUP_LIMIT))], n + 1)
    return _first_copies(vectors, keys, n + 1)


def _first_copies(vectors: DataFrame, keys: list[Column], count: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    return vectors.withColumn("copy", place).filter(F.col("copy") <= count).drop("copy")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _block_counts(members: DataFrame) -> DataFrame:
    """(cell, blocks) of the cells in which a point meets another one."""
    sizes = members.groupBy("cell").agg(F.count("*").alias("rows"), F.count_if("home").alias("homes"))
    return sizes.filter("homes > 0 and rows > 1").select(
        "cell", F.ceil(F.col("rows") / F.lit(PAIR_BLOCK)).alias("blocks")
    )


def _compare_blocks(members: DataFrame, n: int, floor: float | None) -> DataFrame:
    """Best n pairs of every pair of blocks within a cell.

    ``members``: cell, blocks, id, dense, home. Two points that are both guests are
    left to another cell. A cell is split into ``blocks`` by a hash of the id, and each
    of its blocks meets each other block in a group of its own.
    """
    partners = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
        lambda other: F.struct(
            F.least(F.col("block"), other).alias("lo"), F.greatest(F.col("block"), other).alias("hi")
        ),
    )
    # The explicit repartition spreads the block pairs of one crowded cell over tasks:
    # rows already lying together by cell would otherwise be grouped where they are. Its
    # number of tasks is fixed, since comparing is much work on few bytes.
    meeting = (
        members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .withColumn("pair", F.explode(partners))
        .select("cell", F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"), "id", "dense", "block", "home")
        .repartition(_tasks(members), "cell", "lo", "hi")
    )

    def compare(group: pa.Table) -> pa.Table:
        group = group.filter(pc.is_valid(group.column("dense"))).combine_chunks()
        if not group.num_rows:
            return _PAIR_ARROW.empty_table()
        ids = group.column("id").to_numpy()
        unit = _unit_rows(group.column("dense").combine_chunks())
        home = group.column("home").to_numpy(zero_copy_only=False).astype(bool)
        block = group.column("block").to_numpy()
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        best = _BestPairs(n, floor)
        if lo == hi:
            _within(best, ids, unit, home)
        else:
            left, right = block == lo, block == hi
            _between(best, (ids[left], unit[left], home[left]), (ids[right], unit[right], home[right]))
        return pa.table(best.rows(), schema=_PAIR_ARROW)

    return meeting.groupBy("cell", "lo", "hi").applyInArrow(compare, _PAIR_SCHEMA)


def _floor_score(vectors: DataFrame, n: int) -> float | None:
    """Score of the n-th best among some pairs; the true n-th best is no lower.

    Points sorted by their hyperplane signs are compared within each Arrow batch.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _BestPairs(n, None)
        for batch in batches:
            sizes = pc.list_value_length(batch.column("dense"))
            # sorted by size: one size fills nearly every batch
            batch = batch.filter(pc.equal(sizes, pc.max(sizes)))
            if not batch.num_rows:
                continue
            ids, unit = batch.column("id").to_numpy(), _unit_rows(batch.column("dense"))
            _within(best, ids, unit, np.ones(len(ids), dtype=bool))
        yield pa.RecordBatch.from_pydict(best.rows(), schema=_PAIR_ARROW)

    code = band_codes(F.col("dense"), 32, 1)[0]
    found = (
        vectors.withColumn("size", F.size("dense"))
        .withColumn("code", code)
        .repartitionByRange(_tasks(vectors), "size", "code", "id")
        .sortWithinPartitions("size", "code", "id")
        .select("id", "dense")
        .mapInArrow(compare, _PAIR_SCHEMA)
        .orderBy(F.desc("score"))
        .limit(n)
        .agg(F.count("*").alias("found"), F.min("score").alias("floor"))
        .first()
    )
    return found["floor"] if found["found"] == n else None


def _grid_radius(floor: float | None) -> float | None:
    """Largest distance of two unit vectors whose rounded cosine reaches the floor."""
    if floor is None:
        return None
    return float(np.sqrt(max(0.0, 2 - 2 * (floor - 2 * ROUNDING))))


def _on_grid(vectors: DataFrame, radius: float) -> DataFrame:
    """Every point in its own cell, and as a guest in half of the neighbouring cells.

    A vector's shadow on a unit direction moves no further than the vector itself, so
    points within the radius lie in the same cell or in neighbouring ones.
    """

    def cell(size: int, shadows: np.ndarray) -> np.ndarray:
        place = np.floor(shadows / np.sqrt(size) / radius).astype(np.int64)
        return np.column_stack([np.full(len(place), size), place])

    own = _on_directions(F.col("dense"), GRID_AXES, cell, 1 + GRID_AXES)
    ahead = [step for step in product((-1, 0, 1), repeat=GRID_AXES) if step > (0,) * GRID_AXES]
    steps = F.array(
        *[F.array(*[F.lit(x).cast("bigint") for x in (0, *step)]) for step in [(0,) * GRID_AXES, *ahead]]
    )
    return (
        vectors.withColumn("own", own)
        .withColumn("step", F.explode(steps))
        .select(
            F.zip_with("own", "step", lambda x, y: x + y).alias("cell"),
            "id",
            "dense",
            F.forall("step", lambda x: x == 0).alias("home"),
        )
    )


def _best(found: DataFrame, n: int) -> DataFrame:
    top = found.orderBy(F.desc("score"), "id_a", "id_b").limit(n)
    place = Window.orderBy(F.desc("score"), "id_a", "id_b")
    # A window over at most n rows.
    return top.select(F.row_number().over(place).alias("rank"), "id_a", "id_b", "score")


def most_similar_pairs(
    points: DataFrame, n: int = 5, using: str = "dense"
) -> DataFrame:
    """The n pairs of largest cosine: (rank, id_a, id_b, score), id_a < id_b."""
    vectors = _vectors(points, using)
    blocks = vectors.count() // PAIR_BLOCK + 1
    floor, longest = None, 1
    if blocks > 1:
        vectors = stored(_few_copies(vectors, n))
        floor = _floor_score(vectors, n)
        longest = vectors.agg(F.max(F.size("dense"))).first()[0] or 1
    radius = _grid_radius(floor)
    if radius is not None and radius <= GRID_GAIN / np.sqrt(longest):
        members = _on_grid(vectors, radius)
        members = members.join(_block_counts(members), "cell")
    else:
        members = vectors.select(
            F.array(F.size("dense")).alias("cell"),
            F.lit(blocks).cast("bigint").alias("blocks"),
            "id",
            "dense",
            F.lit(True).alias("home"),
        )
    return _best(_compare_blocks(members, n, floor), n)


def approximate_similar_pairs(
    points: DataFrame, n: int = 5, bits: int = 8, bands: int = 16, using: str = "dense"
) -> DataFrame:
    """The n best among the pairs that agree on all signs of at least one band.

    More bits compare fewer pairs, more bands miss fewer. Scores are exact.
    """
    members = band_members(points, n, bits, bands, using)
    return _best(_compare_blocks(members, n, None).distinct(), n)


def band_members(points: DataFrame, n: int, bits: int, bands: int, using: str = "dense") -> DataFrame:
    """Every point once per band, in the cell its signs name, with the cell's blocks."""
    vectors = _vectors(points, using)
    crowded = vectors.count() > PAIR_BLOCK
    coded = _few_copies(vectors, n).withColumn("codes", band_codes(F.col("dense"), bits, bands))
    if crowded:
        coded = stored(coded)
    size, band = F.size("dense").cast("bigint"), F.col("band").cast("bigint")
    # the outer form: the plain one adds a filter on the codes, which would be made twice
    members = coded.select("id", "dense", F.posexplode_outer("codes").alias("band", "code")).select(
        F.array(size, band, "code").alias("cell"), "id", "dense", F.lit(True).alias("home")
    )
    if not crowded:
        return members.withColumn("blocks", F.lit(1).cast("bigint"))
    return members.join(broadcast_if_small(_block_counts(members)), "cell")
