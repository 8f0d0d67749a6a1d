import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from nearfield.llm import fingerprint as fp
from nearfield.llm.common import table


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def shingles(text):
    """Hashes of five words chained as Spark's xxhash64 of several columns does."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return set()
    if len(words) < 5:
        return {signed(xxhash.xxh64_intdigest(" ".join(words).encode(), 42))}
    found = set()
    for i in range(len(words) - 4):
        seed = 42
        for w in words[i : i + 5]:
            seed = xxhash.xxh64_intdigest(w.encode(), seed)
        found.add(signed(seed))
    return found


def likeness(a, b, k):
    union = sorted(a | b)[:k]
    return len(a & b & set(union)) / len(union) if union else 1.0


def plain(rows, k):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    result = {}
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = ({*sorted(shingles(t))[:k]} for t in (text, edited, following))
        prints = ["".join(f"{h % (1 << 64):016x}" for h in sorted(s)) for s in (a, b)]
        result[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), *prints, likeness(a, b, k), likeness(a, c, k))
    return result


COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_small_table_equals_brute_force(spark, small):
    db, folder = small
    rows = db.execute("SELECT doc_id, text FROM documents").fetchall()
    found = fp.edit_likeness(table(spark, folder, "documents")).select("doc_id", *COLUMNS).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == plain(rows, fp.SKETCH_SIZE)


def test_edge_rows(spark, docs):
    rows = [(4, None), (9, ""), (1, "a b c"), (-3, " \t é́ 🦊 x\x0by z w"), (None, "no id here at all, but text"), (7, "word " * 100_000)]
    found = fp.edit_likeness(docs(*rows)).select("doc_id", *COLUMNS).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == plain(rows, fp.SKETCH_SIZE)
    one = fp.edit_likeness(docs((5, "a b c d e f"))).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(5, 1.0)]
    twice = fp.edit_likeness(docs((5, "a"), (5, "b"), (5, "b"), (2, "c"))).select("doc_id", "n_chars").collect()
    assert sorted(map(tuple, twice)) == [(2, 1), (5, 1)]
    assert fp.edit_likeness(docs((1, "a")).limit(0)).count() == 0


def test_merged_parts_and_estimates(spark):
    texts = {g: [" ".join(f"w{(g + 1) * i * j % 97}" for i in range(40)) for j in range(1, 30)] for g in (0, 1)}
    rows = [(g, t) for g, ts in texts.items() for t in ts] + [(None, ""), (2, None)]
    parts = fp.with_sketch(spark.createDataFrame(rows, "g int, text string"), "text", "sketch")
    whole = {r.g: list(r.sketch) for r in fp.merged(parts, "g").collect()}
    every = {g: set().union(*map(shingles, ts)) for g, ts in texts.items()}
    assert whole == {g: sorted(s)[: fp.SKETCH_SIZE] for g, s in every.items()} | {None: [], 2: []}
    pair = spark.createDataFrame([(whole[0], whole[1])], "a array<bigint>, b array<bigint>")
    near, inside, n = pair.select(
        fp.resemblance(F.col("a"), F.col("b")), fp.containment(F.col("a"), F.col("b")), fp.distinct_shingles(F.col("a"))
    ).first()
    true = len(every[0] & every[1]) / len(every[0] | every[1])
    assert abs(near - true) < 0.2 and abs(inside - len(every[0] & every[1]) / len(every[0])) < 0.25
    assert abs(n / len(every[0]) - 1) < 0.4


def test_no_python_in_the_plan(spark, small):
    plan = fp.edit_likeness(table(spark, small[1], "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
