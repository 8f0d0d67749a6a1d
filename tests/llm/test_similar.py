import itertools
import random

import numpy as np

import corpus_pipeline
from nearfield.llm import similar
from nearfield.llm.common import table


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def plain_least(rows):
    """doc_id -> least doc_id that pairs of Jaccard 0.8 or more reach."""
    sets = {i: plain_set(t) for i, t in rows}
    least = {i: i for i in sets}
    links = [(i, j) for i, j in itertools.combinations(sets, 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(least[i], least[j])
            if least[i] != low or least[j] != low:
                least[i] = least[j] = low
                changed = True
    return least


def edited(rng, size, spots):
    """A text of so many words, and one that differs in so many words."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    other = list(words)
    for k in rng.sample(range(size), spots):
        other[k] = "changed"
    return " ".join(words), " ".join(other)


def test_near_copies_equal_brute_force(spark, docs):
    rng = random.Random(5)
    texts = [t for size in (8, 30, 60, 150, 400) for spots in range(0, max(2, size // 20)) for t in edited(rng, size, spots)]
    base = texts[-2].split()
    for k in range(40):  # a chain: each differs from the one before in a few more words
        base[rng.randrange(len(base))] = f"n{k}"
        texts.append(" ".join(base))
    rows = list(enumerate(rng.sample(texts, len(texts))))
    for tile_rows in (7, 1000):
        found = dict(map(tuple, similar.near_copies(docs(*rows), tile_rows=tile_rows).collect()))
        assert found == plain_least(rows) and len(set(found.values())) < len(rows)


def test_large_groups_are_cut(spark, docs, monkeypatch):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(100), 3):
            words[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(similar, "BLOCK_TEXTS", 9)
    assert dict(map(tuple, similar.near_copies(docs(*rows)).collect())) == plain_least(rows)


def test_similarity_is_exact():
    sets = [np.arange(10, dtype=np.uint64), np.arange(8, dtype=np.uint64), np.arange(7, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64)]
    assert similar.alike(sets, sets).tolist() == [
        [True, True, False, True], [True, True, True, False], [False, True, True, False], [True, False, False, True]
    ]


def test_stage_keeps_no_near_copies(spark, docs, small):
    """The pair of sf0.001 that four bits of the fingerprints miss, and the edge rows."""
    tables = table(spark, small[1], "documents")
    kept = dict(corpus_pipeline.near_dedup(spark, tables, small[1]).select("doc_id", "text").collect())
    rows = [tuple(r) for r in tables.select("doc_id", "text").collect()]
    assert set(kept) == {i for i, c in plain_least(rows).items() if i == c}
    frame = docs((5, None), (3, ""), (7, "one"), (8, "ONE"), (9, "a b c d e f"), (9, "a b c d e f"), (None, "one"), (None, "alone here"))
    left = corpus_pipeline.near_dedup(spark, frame, small[1])
    assert left.columns == frame.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["3", "7", "9", "9", "None", "None"]
    assert similar.keep_one(frame.limit(0)).count() == 0
