import random
import re
import zlib
from collections import Counter

import pytest
from nearfield.llm import spelling
from nearfield.llm.queries import QUERIES


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def neighbours(words):
    """word -> near words, through what is left when one letter goes."""
    left = {}
    for w in words:
        for i in range(len(w)):
            left.setdefault((i, len(w), w[:i] + w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for group in left.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            s = w[:i] + w[i + 1 :]
            if s in near:
                near[w].add(s)
                near[s].add(w)
    return near


def plain_variants(counts):
    near = neighbours(counts)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def plain_counts(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return seen


def collected(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


@pytest.mark.parametrize("most", [20_000, 3])
def test_random_words(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choice("abÉ") for _ in range(rng.randint(1, 9))): rng.choice([1, 2, 5, 5, 11, 60, 700]) for _ in range(500)}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert collected(spelling.variants(frame, most=most)) == plain_variants(words)


def test_words_that_share_a_long_stretch(spark):
    """A hot group is halved until its groups are small: all but three letters are shared."""
    rng = random.Random(5)
    words = {"prefixed" + "".join(rng.choice("abcdefgh") for _ in range(3)) + "suffixes": rng.randint(1, 99) for _ in range(300)}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    rows = spelling._grouped(frame, 40)
    assert rows.where("high - low > 1").groupBy("key").count().where("count > 40").count() == 0
    assert collected(spelling.variants(frame, most=40)) == plain_variants(words)


def test_pairs_of_long_words():
    long = "ab" * 5_000
    found = list(spelling.pairs(sorted([long, long[:-1] + "c"]), sorted([long + "x", long[:500] + "z" + long[500:]]), len(long) + 1))
    assert sorted(map(len, (a for a, _ in found))) == [10_000] * 3 and all(one_edit(a, b) for a, b in found)


def test_documents(docs, spark):
    texts = ["Address adress address. ADDRESS address address", None, "", "été étés Étés x×y÷zzz", "a" * 30_000, "word " * 9]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 6 + [(None, "address adress" * 3), (2**40, "a" * 30_000)] + [(i, "a" * 30_000) for i in range(5)]
    expected = {w: n for w, n in plain_counts(rows).items() if len(w) >= 6 and n >= 5}
    assert collected(spelling.spelling_variants(docs(*rows))) == plain_variants(expected)
    assert collected(spelling.spelling_variants(docs())) == {}


def test_query(spark, small):
    db, folder = small
    rows = db.execute("SELECT doc_id, text FROM documents").fetchall()
    words = {w: n for w, n in plain_counts(rows).items() if len(w) >= 6 and n >= 5}
    assert collected(QUERIES["op12_spelling_variants"](spark, folder)) == plain_variants(words)
