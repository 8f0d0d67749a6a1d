import hashlib
import random
import re

import numpy as np
import pytest

from nearfield.llm import substrings
from nearfield.llm.common import table
from nearfield.llm.fm_index import FMIndex


def plain(rows, window=20):
    """doc_id -> (n_words, n_removed, digest of the kept words)."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    seen, result = set(), {}
    for i in sorted(words, key=lambda i: (i is not None, i or 0)):
        w, covered = words[i], set()
        for s in range(len(w) - window + 1):
            run = tuple(w[s : s + window])
            if run in seen:
                covered.update(range(s, s + window))
            seen.add(run)
        kept = " ".join(x for k, x in enumerate(w) if k not in covered)
        result[i] = (len(w), len(covered), hashlib.sha256(kept.encode()).hexdigest())
    return result


def digests(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed_words(df).collect()}


def test_small_tables_equal_brute_force(spark, small):
    db, folder = small
    rows = db.execute("SELECT doc_id, text FROM documents").fetchall()
    assert digests(table(spark, folder, "documents")) == plain(rows)


@pytest.mark.parametrize("frequent", [1, 5, 1000])
def test_shared_passages_and_repeated_words(spark, docs, frequent, monkeypatch):
    rng = random.Random(frequent)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 2)
    passages = [[word() for _ in range(rng.randint(15, 70))] for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), 80):
        w = [word() for _ in range(rng.randint(0, 30))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            w += p + [word() for _ in range(rng.randint(0, 25))]
        rows.append((i, " ".join(w)))
    rows += [(2001, "same " * 90), (2002, "same\t" * 25), (-7, "x y " * 30), (2003, "one two same " * 40)]
    monkeypatch.setattr(substrings.remove_repeats, "__defaults__", ("doc_id", 20, 6, frequent, 40, "n_words", "n_removed"))
    assert digests(docs(*rows).repartition(5)) == plain(rows)


def test_edge_rows(spark, docs):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(3, None), (4, ""), (5, " \n\t"), (1, passage + " tail"), (None, "head " + passage), (9, "short text"), (6, "z " * 300_000)]
    assert digests(docs(*rows)) == plain(rows)
    # equal rows are one text; texts that share an id lose what another has
    found = substrings.remove_repeats(docs((1, passage), (1, passage), (2, passage))).collect()
    assert sorted((r.doc_id, r.n_removed) for r in found) == [(1, 0), (1, 0), (2, 40)]
    found = substrings.remove_repeats(docs((1, passage + " a"), (1, passage + " b"))).collect()
    assert sorted(r.n_removed for r in found) == [0, 40]
    empty = substrings.remove_repeats(docs((1, "a")).limit(0))
    assert empty.count() == 0
    frame = docs((1, "  some text "), (2, None))
    assert substrings.remove_repeats(frame).select(frame.columns).collect() == frame.collect()


def test_index_finds_first_matches():
    rng = np.random.default_rng(1)
    for size, letters in ((0, 1), (5, 1), (300, 2), (400, 9)):
        text = rng.integers(0, letters + 1, size + 1)
        text[-1] = 0
        index = FMIndex(text, 5)
        bounds = np.concatenate([[-1], np.flatnonzero(text == 0)])
        starts, sizes = bounds[:-1] + 1, np.diff(bounds) - 1
        found = {(int(s), int(o)): int(p) for s, o, p in zip(*index.matches(starts, sizes))}
        joined = lambda k: tuple(text[k : k + 5])
        expected = {}
        for s, (a, n) in enumerate(zip(starts, sizes)):
            for o in range(n - 4):
                expected[s, o] = next(k for k in range(len(text)) if joined(k) == joined(a + o))
        assert found == expected
