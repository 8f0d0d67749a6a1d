import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from nearfield.llm import lm_scoring
from nearfield.llm.queries import QUERIES


def plain_tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in lower.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w] + ["<end>"]


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain_base(rows):
    counts = Counter(t for i, text in rows if not held(i) for t in plain_tokens(text))
    n, v = sum(counts.values()), len(counts)
    for i, text in rows:
        tokens = plain_tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        yield i, held(i), len(tokens), sum(counts[t] > 0 for t in tokens), n, base


def compare(found, rows):
    key = lambda r: (r[0] is None, r[0] or 0, *r[2:])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=key)
    expected = sorted(plain_base(rows), key=key)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert all(g[5] == pytest.approx(e[5], rel=1e-9, abs=1e-9) for g, e in zip(got, expected))


@pytest.mark.parametrize("kept", [lm_scoring.HELD_WORDS, 40])
def test_query(spark, small, kept, monkeypatch):
    """Counts, base and held-out gain; also where tasks hold few counts and most are joined."""
    monkeypatch.setattr(lm_scoring, "HELD_WORDS", kept)
    db, folder = small
    rows = db.execute("SELECT doc_id, text FROM documents").fetchall()
    found = QUERIES["op11_lm_scoring"](spark, folder).collect()
    compare(found, rows)
    apart = [r for r in found if r.held_out]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart) and all(r.score < 0 for r in found)


def test_edge_rows(spark, docs):
    rows = [(1, "A b B\tc"), (1, "A b B\tc"), (2, None), (3, ""), (None, "a unseen"), (4, "x " * 30_000), (5, "Été a"), (9, "b " * 5), (16, "q r s")]
    compare(lm_scoring.scores(docs(*rows)).collect(), rows)
    assert lm_scoring.scores(docs()).collect() == []
    # Without training rows nothing is known, and the base is certain of its one unknown word.
    alone = lm_scoring.scores(docs((None, "some words"))).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in alone] == [(3, 0, 0, 0.0)] and alone[0].score < 0


def test_probabilities_add_up():
    """After any history: all words with a code, and the shares of the endings' classes."""
    words = [lm_scoring.END] + [f"w{i}".encode() for i in range(1_500)]
    counts = np.arange(len(words), 0, -1) + 5
    mass, kinds = np.zeros(lm_scoring.ENDINGS, int), np.zeros(lm_scoring.ENDINGS, int)
    for w, n in list(zip(words, counts))[lm_scoring.TOP :]:
        mass[lm_scoring.ending(w)] += n
        kinds[lm_scoring.ending(w)] += 1
    voc = lm_scoring.Vocabulary(words, counts, int(counts.sum()), len(words), mass, kinds)
    weights = lm_scoring.Weights(voc)
    rng = np.random.default_rng(3)
    codes = rng.integers(0, lm_scoring.TOP + lm_scoring.ENDINGS, 5_000).astype(np.uint16)
    lm_scoring.learn(weights, codes, np.arange(0, 5_000, 50), voc.start)
    every = np.arange(lm_scoring.TOP + lm_scoring.ENDINGS, dtype=np.uint16)
    for a, b in itertools.product((3, 1_030), repeat=2):
        texts = np.stack([np.array([5, a, b, last], np.uint16) for last in every])
        scores = lm_scoring.log_scores(weights, texts.ravel(), np.arange(0, texts.size, 4), voc.start).reshape(-1, 4)[:, 3]
        assert (10**scores).sum() == pytest.approx(1, abs=1e-4)
    # Within an ending's class: seen words and one unknown share it.
    for e in range(lm_scoring.ENDINGS):
        inside = [n for w, n in list(zip(words, counts))[lm_scoring.TOP :] if lm_scoring.ending(w) == e]
        assert sum((n + 1) / (mass[e] + kinds[e] + 1) for n in inside) + 1 / (mass[e] + kinds[e] + 1) == pytest.approx(1)


def test_texts_do_not_see_each_other():
    codes = np.array([1, 2, 3, 4, 5, 6], np.uint16)
    before = lm_scoring.histories(codes, np.array([0, 1, 4]), 99)
    assert before.tolist() == [[99, 99, 2, 3, 99, 5], [99, 99, 99, 2, 99, 99], [99] * 6]
