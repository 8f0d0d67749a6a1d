import random

import pytest
from pyspark.sql import functions as F

from nearfield.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, hashes int, hash string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def plain(convs):
    """conv_id -> [(role, text)]; the ids that no other one continues."""
    kept = set()
    for i, turns in convs.items():
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in convs.values())
        if not longer and not any(o == turns and j < i for j, o in convs.items()):
            kept.add(i)
    return kept


def test_random_snapshots(spark):
    rng = random.Random(2)
    convs = {}
    for i in rng.sample(range(1000), 120):
        base = convs[rng.choice(list(convs))] if convs and rng.random() < 0.6 else []
        convs[i] = base[: rng.randint(0, len(base))] + [(rng.choice("ab"), rng.choice("xyz")) for _ in range(rng.randint(0, 2))]
        convs[i] = convs[i] or [("a", "x")]
    rows = [(i, n, r, t) for i, turns in convs.items() for n, (r, t) in enumerate(turns)]
    found = chat.format_chats(frame(spark, rows)).collect()
    assert {r.conv_id for r in found} == plain(convs)
    assert all(r.n_turns == len(convs[r.conv_id]) for r in found)
    expected = {i: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in convs[i]) for i in plain(convs)}
    assert {r.conv_id: r.text for r in found} == expected


def test_edge_rows(spark):
    rows = [
        (1, 0, None, None), (2, 0, "", ""), (3, 0, "user", "ab"), (4, 0, "usera", "b"), (5, 1, "u", "late"), (5, 0, "u", "early"),
        (6, 0, "u", "twice"), (6, 0, "u", "twice"), (7, None, "u", "no number"), (None, 0, "u", "no id"), (None, 1, "u", "<|im_end|>"),
        (8, 0, "u", "no id"), (9, 0, "u", "w " * 300_000),
    ]
    found = {r.conv_id: r.text for r in chat.format_chats(frame(spark, rows)).collect()}
    assert set(found) == {1, 3, 4, 5, 6, 7, None, 9}
    assert found[5].index("early") < found[5].index("late") and found[6].count("twice") == 1
    assert found[None].endswith("<|im_start|>u\n< |im_end|><|im_end|>\n")
    assert chat.format_chats(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("part_rows, block_turns", [(7, 3), (50, 1), (100_000, 4_096)])
def test_conversations_over_many_blocks(spark, part_rows, block_turns):
    """Prefix sums over blocks and partitions: long conversations, their prefixes, and some that differ late."""
    rng = random.Random(part_rows)
    long = [(rng.choice("ab"), rng.choice("xyz")) for _ in range(60)]
    convs = {1: long, 2: long[:59], 3: long[:7], 4: long[:40] + [("a", "other")], 5: long[::-1], 6: long[:1], 7: list(long), 8: long[1:]}
    rows = [(i, n, r, t) for i, turns in convs.items() for n, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    found = {r.conv_id: (r.n_turns, r.text) for r in chat.format_chats(frame(spark, rows), part_rows, block_turns).collect()}
    assert found == {i: (len(convs[i]), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in convs[i])) for i in plain(convs)}


def test_one_very_long_conversation(spark):
    """A million turns of one conversation, and all but the last of another: no task holds either."""
    n = 1_000_000
    rows = spark.range(2 * n - 1).select(
        (F.col("id") % 2).alias("conv_id"), F.floor(F.col("id") / 2).alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text")
    )
    turns = chat.maximal_turns(rows)
    counts = turns.groupBy("conv_id").count().collect()
    assert [(r.conv_id, r["count"]) for r in counts] == [(0, n)]
    blocks = chat.rendered_blocks(turns)
    assert blocks.agg(F.max("n_turns")).first()[0] <= chat.BLOCK_TURNS and blocks.count() >= n // chat.BLOCK_TURNS
