import numpy as np
import pytest
from conftest import plan
from pyspark.sql import functions as F

from nearfield.operators import pairs


def brute(rows, n):
    ids = [i for i, v in rows if v is not None and np.linalg.norm(v) > 0]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i in set(ids)}
    out = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if len(unit[a]) == len(unit[b]):
                out.append((-(round(float(unit[a] @ unit[b]), 6) + 0.0), min(a, b), max(a, b)))
    return [(r + 1, a, b, -s + 0.0) for r, (s, a, b) in enumerate(sorted(out)[:n])]


def found(df):
    return [(r["rank"], r.id_a, r.id_b, pytest.approx(r.score, abs=1e-9)) for r in df.orderBy("rank").collect()]


@pytest.fixture(scope="module")
def crowd():
    """300 points: a third of them copies of one vector, some nearly so, some odd ones."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(100, 16)).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 - i, base[0].tolist()) for i in range(100)]
    near = base + rng.normal(size=base.shape) * 0.01
    rows += [(2000 + i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(near)]
    rows += [(3000, [0.0] * 16), (3001, None), (3002, [1.0, 2.0]), (3003, [2.0, 4.1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, dense array<float>").repartition(3)


def test_one_block(spark, crowd):
    assert found(pairs.most_similar_pairs(frame(spark, crowd[:100]), 25)) == brute(crowd[:100], 25)


@pytest.mark.parametrize("n", [3, 60])
def test_many_blocks_copies_and_hot_cells(spark, crowd, n, monkeypatch):
    monkeypatch.setattr(pairs, "PAIR_BLOCK", 20)
    assert found(pairs.most_similar_pairs(frame(spark, crowd), n)) == brute(crowd, n)


@pytest.mark.parametrize("n", [4, 90])
def test_grid_finds_the_same(spark, crowd, n, monkeypatch):
    rows = crowd[:100] + crowd[200:]
    monkeypatch.setattr(pairs, "PAIR_BLOCK", 20)
    used = []
    on_grid = pairs._on_grid
    monkeypatch.setattr(pairs, "_on_grid", lambda *a: used.append(a) or on_grid(*a))
    assert found(pairs.most_similar_pairs(frame(spark, rows), n)) == brute(rows, n)
    assert used


def test_no_grid_where_it_does_not_help(spark, crowd, monkeypatch):
    monkeypatch.setattr(pairs, "PAIR_BLOCK", 30)
    monkeypatch.setattr(pairs, "_on_grid", lambda *a: pytest.fail("the radius is too wide"))
    assert found(pairs.most_similar_pairs(frame(spark, crowd[:100]), 2000)) == brute(crowd[:100], 2000)


def test_fewer_pairs_than_asked(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])]
    assert found(pairs.most_similar_pairs(frame(spark, rows), 5)) == [(1, 1, 2, 0.0)]
    assert found(pairs.most_similar_pairs(frame(spark, rows[:1]), 5)) == []


@pytest.mark.parametrize("block", [8192, 10])
def test_bands_compare_few_pairs_and_find_near_ones(spark, crowd, block, monkeypatch):
    monkeypatch.setattr(pairs, "PAIR_BLOCK", block)
    rows = crowd[:100] + crowd[200:300]
    got = found(pairs.approximate_similar_pairs(frame(spark, rows), 90, bits=8, bands=8))
    exact = brute(rows, 90)
    assert len({x[1:3] for x in got} & {x[1:3] for x in exact}) >= 0.9 * len(exact)
    scores = {x[1:3]: x[3] for x in brute(rows, 10**6)}
    assert all(s == scores[(a, b)] for _, a, b, s in got)
    members = pairs.band_members(frame(spark, rows), 90, 8, 8)
    cells = members.groupBy("cell").agg(F.collect_set("id").alias("ids")).collect()
    compared = {(a, b) for c in cells for a in c.ids for b in c.ids if a < b}
    assert len(compared) < 0.25 * len(rows) * (len(rows) - 1) / 2


def test_no_join_emits_all_pairs(spark, crowd):
    text = plan(pairs.most_similar_pairs(frame(spark, crowd), 5))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
