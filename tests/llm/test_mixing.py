import hashlib
import random
from fractions import Fraction

import pytest

from nearfield.llm import mixing
from nearfield.llm.common import table
from nearfield.llm.oracle import SQL
from nearfield.llm.queries import LEVELS, QUERIES, WEIGHTS, with_domain


def fill(caps, weights, budget):
    """Water level by trial: caps met in the order in which the level rises to them."""
    full = set()
    while True:
        rest = [c for c in caps if c not in full]
        room, total = budget - sum(caps[c] for c in full), sum(weights[c] for c in rest)
        level = Fraction(room, total) if total else Fraction(0)
        more = {c for c in rest if weights[c] and caps[c] <= level * weights[c]} | {c for c in rest if not caps[c]}
        if not more:
            return {c: caps[c] if c in full else room * weights[c] // total if total else 0 for c in caps}
        full |= more


def plain(rows, weights, share, max_epochs, seed):
    """rows: (doc_id, level values, tokens) -> {row number: epochs}."""
    leaves = {}
    for _, path, tokens in rows:
        leaves[path] = leaves.get(path, 0) + tokens
    budgets = {(): int(sum(leaves.values()) * share)}
    for depth in range(3):
        for parent in {p[:depth] for p in leaves}:
            caps = {}
            for p, t in leaves.items():
                if p[:depth] == parent:
                    caps[p[: depth + 1]] = caps.get(p[: depth + 1], 0) + t * max_epochs
            named = [weights[depth].get(c[-1], weights[depth].get("*", 1)) for c in caps]
            budgets |= fill(caps, dict(zip(caps, named)), budgets[parent])
    result = {}
    for path, supply in leaves.items():
        passes = budgets[path] // supply if supply else 0
        room = budgets[path] - passes * supply
        place = lambda r: hashlib.md5(f"{seed}:{passes}:{'null' if r[1][0] is None else r[1][0]}".encode()).hexdigest()
        own = sorted((r for r in enumerate(rows) if r[1][1] == path), key=place)
        for n, r in own:
            upto = sum(q[1][2] for q in own if place(q) <= place((n, r)))
            taken = passes + (upto <= room and (room > 0 or passes == 0))
            if taken:
                result[n] = taken
    return result


@pytest.mark.parametrize("share,epochs,seed", [(1.0, 2, 1), (0.3, 1, 5), (1.5, 4, 2), (0.0, 2, 3)])
def test_random_trees(spark, share, epochs, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        path = (rng.choice("aab"), rng.choice(["x", "x", "y", ""]), rng.choice(["s0", "s0", "s1", "s2"]))
        rows.append((i if i % 37 else None, path, rng.choice([0, 1, 3, 50])))
    rows += rows[:5]
    weights = ({"a": 1, "b": 5}, {"x": 3, "*": 2}, {"s2": 0})
    frame = spark.createDataFrame(
        [(i, *(v or None for v in p), " ".join(["w"] * t) if t else None, n, 9) for n, (i, p, t) in enumerate(rows)],
        "doc_id bigint, domain string, lang string, source string, text string, n int, tokens int",
    )
    found = mixing.mix(frame, LEVELS, dict(zip(LEVELS, weights)), share, epochs, seed)
    assert found.columns == [*frame.columns, "epochs"]
    assert {r.n: r.epochs for r in found.collect()} == plain(rows, weights, share, epochs, seed)


@pytest.mark.parametrize("share", [0.1, 0.37, 0.8, 1.0])
def test_budgets_beyond_64_bits(spark, share):
    rng = random.Random(7)
    leaves = {("a", f"l{i}"): rng.choice([1, 3, 5]) * 10**13 + rng.randrange(1000) for i in range(6)}
    leaves |= {("b", f"l{i}"): rng.choice([10**6, 2 * 10**13]) for i in range(4)}
    weights = {"top": {"a": 10**6, "b": 999_999}, "leaf": {"l0": 10**17, "l1": 10**17 - 1, "l2": 3, "l3": 0, "*": 10**9 + 7}}
    budget = int(sum(leaves.values()) * share)
    frame = spark.createDataFrame([(*p, n) for p, n in leaves.items()], "top string, leaf string, tokens bigint")
    found = {(r.top, r.leaf): r.budget for r in mixing.leaf_budgets(frame, ["top", "leaf"], weights, budget, 2).collect()}
    tops = fill({t: sum(2 * n for p, n in leaves.items() if p[0] == t) for t in "ab"}, weights["top"], budget)
    expected = {}
    for t in "ab":
        caps = {p: 2 * n for p, n in leaves.items() if p[0] == t}
        expected |= fill(caps, {p: weights["leaf"].get(p[1], weights["leaf"]["*"]) for p in caps}, tops[t])
    assert found == expected


def test_rows_without_id_lie_at_one_place(spark):
    """All rows of a place are taken or left together, as one row of the order."""
    frame = spark.createDataFrame([(None, "s", "a b c")] * 500 + [(i, "s", "a b c") for i in range(500)], "doc_id bigint, source string, text string")
    for share in (0.2, 0.7, 1.0):
        found = mixing.mix(frame, ["source"], {}, share, 1).collect()
        hidden = sum(r.doc_id is None for r in found)
        assert hidden in (0, 500) and len(found) <= 1000 * share
        rows = [(r.doc_id, ("s",), 3) for r in frame.collect()]
        place = {i: hashlib.md5(f"1:0:{'null' if i is None else i}".encode()).hexdigest() for i, *_ in rows}
        order, room, taken = sorted(place, key=place.get), int(3000 * share), set()
        for i in order:
            room -= 3 * (500 if i is None else 1)
            if room < 0:
                break
            taken.add(i)
        assert {r.doc_id for r in found} == (taken if share < 1 else set(place))


def test_empty_and_plan(spark, small):
    docs = with_domain(table(spark, small[1], "documents"))
    assert mixing.mix(docs.limit(0), LEVELS, WEIGHTS).count() == 0
    plan = mixing.mix(docs, LEVELS, WEIGHTS)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, small, name):
    db, folder = small
    mine = QUERIES[name](spark, folder)
    cursor = db.execute(SQL[name])
    order = [d[0] for d in cursor.description]
    assert sorted(map(tuple, mine.select(*order).collect()), key=str) == sorted(cursor.fetchall(), key=str)


def test_domains(spark):
    rows = spark.createDataFrame([("src0",), ("src19",), ("src20",), ("x",), (None,), ("src99999999999",)], "source string")
    assert with_domain(rows.withColumn("Domain", rows.source)).columns == ["source", "domain"]
    assert [r.domain for r in with_domain(rows).collect()] == ["web", "news", "other", "other", "other", "other"]
