import random
import re

import numpy as np
import xxhash

from nearfield.llm import simhash
from nearfield.llm.common import table


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    runs = [words[i : i + 4] for i in range(len(words) - 3)] or ([words] if words else [])
    hashes = [xxhash.xxh64(b" ".join(r), seed=42).intdigest() for r in runs]
    bits = [b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)]
    return sum(1 << b for b in bits)


def plain_components(prints, radius=4):
    """prints: (doc_id, fingerprint); doc_id -> least reachable doc_id."""
    least = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= radius and least[j] < least[i]:
                    least[i], changed = least[j], True
    return least


def test_small_tables_equal_brute_force(spark, small):
    db, folder = small
    rows = db.execute("SELECT doc_id, text FROM documents").fetchall()
    prints = [(i, plain_print(t)) for i, t in rows]
    least = plain_components(prints)
    found = simhash.near_duplicates(table(spark, folder, "documents"), tile_rows=64).collect()
    assert sorted(map(tuple, found)) == sorted((i, f"{p:016x}", least[i]) for i, p in prints)


def test_chains_over_many_tiles(spark):
    rng = random.Random(3)
    prints, at = [], rng.getrandbits(64)
    for i in range(60):
        at ^= sum(1 << b for b in rng.sample(range(64), 3))
        prints.append((i, at))
        prints.append((1000 + i, rng.getrandbits(64)))
    rng.shuffle(prints)
    signed = [(i, int(np.array([p], np.uint64).view(np.int64)[0])) for i, p in prints]
    nodes = spark.createDataFrame(signed, "node bigint, fp bigint")
    for tile_rows in (9, 1000):
        found = dict(map(tuple, simhash.components(simhash.fingerprint_links(nodes, 4, tile_rows)).collect()))
        least = plain_components(prints)
        assert {i: found.get(i, i) for i, _ in prints} == least


def test_edge_rows(spark, docs):
    rows = [(5, None), (3, ""), (4, " \t\n"), (7, "one"), (8, "ONE"), (9, "one two three four five"), (9, "one two three four five")]
    rows += [(None, "one"), (None, "only without an id"), (20, "x " * 200_000)]
    found = sorted(map(tuple, simhash.near_duplicates(docs(*rows)).collect()), key=str)
    prints = {i: f"{plain_print(t):016x}" for i, t in rows}
    zero = "0" * 16
    assert [r for r in found if r[1] == zero] == [(3, zero, 3), (4, zero, 3), (5, zero, 3)]
    assert {(i, c) for i, p, c in found if p == prints[7]} == {(7, 7), (8, 7), (None, 7)}
    assert found.count((9, prints[9], 9)) == 2 and (20, prints[20], 20) in found
    assert [r[2] for r in found if r[1] == f"{plain_print('only without an id'):016x}"] == [None]
    assert len(found) == len(rows)
    assert simhash.near_duplicates(docs((1, "a")).limit(0)).count() == 0


def test_one_document_of_each_component_stays(spark, docs):
    rows = docs((2, "a b c d e"), (1, "A b c d e"), (3, "something else altogether here now"), (None, "a b c d e"))
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3]
