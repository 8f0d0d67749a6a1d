import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from nearfield.llm import repair
from nearfield.llm.queries import QUERIES
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn int, role string, text string, at int, letters string, `first` int"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def plain_damage(rows):
    """conv_id -> rows (turn, role, text) in order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out[conv] += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {c: sorted(rs, key=order) for c, rs in out.items()}


def plain_report(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)

    @lru_cache(None)
    def best(i, q, inserts):
        """The least (cost, audit, written rows) from row i in state q."""
        ways = []
        if i == len(rows):
            if q in ("", "a"):
                ways.append((0, "", ()))
        else:
            role, text, fault = rows[i][1], rows[i][2], faults[i]
            extra = fault == "truncated"
            cost, audit, out = best(i + 1, q, 0)
            ways.append((3 + cost, "D" + audit, out))
            if fault in ("", "truncated"):
                if role[:1] == NEXT[q] or (q == "" and role[:1] == "s"):
                    cost, audit, out = best(i + 1, role[:1], 0)
                    ways.append((extra + cost, "K" + audit, ((role, text), *out)))
                cost, audit, out = best(i + 1, NEXT[q], 0)
                ways.append((2 + extra + cost, "R" + audit, ((NAMES[NEXT[q]], text), *out)))
        if inserts < 3:
            cost, audit, out = best(i, NEXT[q], inserts + 1)
            ways.append((2 + cost, "I" + audit, ((NAMES[NEXT[q]], ""), *out)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, out = best(0, "", 0)
    turns = {t for t, *_ in rows if t is not None}
    starts = [r[1][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:])),
        cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(spark, rows, **how):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair_report(frame, **how).collect()}
    expected = {c: plain_report(rs) for c, rs in plain_damage(rows).items()}
    assert found == expected


def conversation(rng, conv, n, roles):
    texts = ["Yes.", "No", "Why?", "", " ", "\t\n", "Well. ", "One. two", "a", "b!", "c"]
    return [(conv, rng.choice([t, t, t, 2 * t, None]), rng.choice(roles), rng.choice(texts) + (str(rng.randint(0, n)) + rng.choice(".,") if rng.random() < 0.7 else "")) for t in range(n)]


@pytest.mark.parametrize("chunk_rows, part_rows", [(4096, 100_000), (1, 7), (5, 40)])
def test_random_conversations(spark, chunk_rows, part_rows):
    rng = random.Random(chunk_rows)
    kinds = [["user", "assistant"], ["system", "user", "assistant", "tool", ""], ["system"], ["tool"], ["user"]]
    rows = [r for conv in range(60) for r in conversation(rng, conv, rng.randint(1, 12), kinds[conv % 5])]
    # Long ones, of which no role and all texts would do, or nothing would: costs agree late or never.
    rows += conversation(rng, 100, 60, kinds[1]) + [(101, t, "tool", f"{t}.") for t in range(64)] + [(102, t, "user", "") for t in range(50)]
    rows += [(None, t, "user", f"{t}") for t in range(30)] + [(103, None, "user", "same.")] * 9
    rng.shuffle(rows)
    check(spark, rows, chunk_rows=chunk_rows, part_rows=part_rows)


def test_edge_rows(spark):
    rows = [(1, 0, None, None), (2, None, "user", "x."), (None, None, None, "a."), (3, 5, "user", "Hi."), (3, 9, "assistant", "Ho."), (4, 3, "assistant", "ä ö. \v")]
    rows += [(i, 0, "user", "only") for i in range(10, 60)]
    check(spark, rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair_report(empty).collect() == []


def test_long_conversation(spark):
    """Rows of one conversation are dealt over tasks, and its chunks need no more passes than their doubling."""
    n = 60_000
    rows = spark.range(n).select(
        F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit("tool").alias("role"), F.concat("id", F.lit(".")).alias("text"), F.lit(1).alias("times")
    )
    kept, chunks = repair.repair(rows, chunk_rows=500, part_rows=5_000)
    assert chunks.count() == 120
    cost = chunks.agg(F.sum("cost")).first()[0]
    assert cost == 2 * n and kept.count() == n
    assert kept.groupBy(F.spark_partition_id()).count().count() > 1


def test_query(spark, small):
    db, folder = small
    rows = db.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_conversation_repair"](spark, folder).collect()}
    assert found == {c: plain_report(rs) for c, rs in plain_damage(rows).items()}
