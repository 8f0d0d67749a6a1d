import hashlib
import os
import re
import string
import tracemalloc

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.functions import encode
from nearfield.functions import text as tx
from nearfield.functions.encode import ModelEncoder, SparseModelEncoder


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], [f"{k} string" for k in values][0] if len(values) == 1 else None)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, stripped",
    [("  a b 　", "a b"), (" x ", "x"), ("\x1fy\x85", "y"), ("   ", ""), (None, None)],
)
def test_strip_knows_unicode_blanks(spark, raw, stripped):
    assert one(spark, tx.strip(F.col("t")), t=raw) == stripped


def test_blank_list_is_what_python_strips():
    assert sorted(tx.BLANKS) == [chr(i) for i in range(0x110000) if chr(i).isspace()]


@pytest.mark.parametrize(
    "raw, label",
    [("0", "negative"), ("1", "neutral"), ("2", "positive"), (" Positive ", "positive"),
     ("spam", "spam"), ("  ", ""), ("3", "3"), (None, None)],
)
def test_labels(spark, raw, label):
    assert one(spark, tx.normalise_label(F.col("t")), t=raw) == label


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=string.ascii_letters + string.digits + " _-'.,!\t\nàéßñüçÀÉ 　", max_size=40), min_size=1, max_size=8))
def test_clean_text_equals_the_plain_patterns(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.select("i", tx.clean_text(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t.lower())).strip() for t in texts]


def test_tokens_keep_repeats_and_drop_stop_words(spark):
    text = "The cat, the CAT and it's a hat"
    assert one(spark, tx.tokens(F.col("t")), t=text) == ["the", "cat", "the", "cat", "and", "its", "a", "hat"]
    assert one(spark, tx.tokens(F.col("t"), True), t=text) == ["cat", "cat", "hat"]
    assert one(spark, tx.tokens(F.col("t")), t=" .. ") == []


@pytest.mark.parametrize("length, limit", [(100, 100), (101, 100), (200, 200), (201, 200)])
def test_truncate_counts_the_dots(spark, length, limit):
    text = "é" * length
    want = text if length <= limit else text[: limit - 3] + "..."
    assert one(spark, tx.truncate(F.col("t"), limit), t=text) == want


def test_word_count(spark):
    for text in ("The cat, the CAT", " ..  ", "", "a　b\x85c\n"):
        got = one(spark, tx.word_count(F.col("t")), t=text)
        assert got == one(spark, F.size(tx.tokens(F.col("t"))), t=text)


def test_preview_and_score(spark):
    assert one(spark, tx.preview(F.col("t")), t="x" * 60) == "x" * 50 + "..."
    assert one(spark, tx.preview(F.col("t")), t="ab") == "ab..."
    assert one(spark, tx.preview(F.col("t")), t="") is None
    scores = spark.createDataFrame([(0.5,), (1.23456,)], "s double")
    assert [r.x for r in scores.select(tx.score_text(F.col("s")).alias("x")).collect()] == ["0.5000", "1.2346"]


def test_lookup_and_percent(spark):
    row = spark.createDataFrame([({"a": "1"},)], "m map<string,string>").select(
        tx.lookup(F.col("m"), "a").alias("a"),
        tx.lookup(F.col("m"), "b", "none").alias("b"),
        tx.percent(F.lit(1), F.lit(4)).alias("p"),
        tx.percent(F.lit(1), F.lit(0)).alias("z"),
    ).first()
    assert tuple(row) == ("1", "none", 25.0, None)


def _recording(folder):
    """A model that notes how many texts and bytes each of its calls gets."""

    def load():
        def model(texts):
            with open(f"{folder}/{os.getpid()}", "a") as out:
                out.write(f"{len(texts)} {sum(len(t.encode()) for t in texts)}\n")
            return [([3, 1, 3], [1.0, len(t), 2.0]) for t in texts]

        return model

    return load


def _calls_of(folder):
    return [tuple(map(int, line.split())) for f in folder.iterdir() for line in f.read_text().splitlines()]


def test_models_get_texts_in_batches_of_rows_and_bytes(spark, tmp_path):
    texts = spark.range(0, 50, 1, 1).select("id", F.when(F.col("id") < 40, F.repeat(F.lit("é"), 10)).when(F.col("id") < 49, F.repeat(F.lit("x"), 1_000)).alias("text"))
    sparse = SparseModelEncoder(_recording(tmp_path), batch_rows=16, batch_bytes=500).transform(texts, "text")
    rows = {r.id: r.sparse for r in sparse.collect()}
    assert (rows[0].indices, rows[0]["values"]) == ([1, 3], [10.0, 3.0])
    # A null text has no vector.
    assert rows[49] is None
    calls = _calls_of(tmp_path)
    assert sum(n for n, _ in calls) == 50 and all(n <= 16 and (b <= 500 or n == 1) for n, b in calls)
    dense = ModelEncoder(_recorded_dense(tmp_path / "dense"), normalise=False, batch_rows=7).transform(texts, "text")
    (tmp_path / "dense").mkdir()
    assert [r.dense for r in dense.orderBy("id").limit(2).collect()] == [[10.0, 1.0]] * 2
    assert max(n for n, _ in _calls_of(tmp_path / "dense")) == 7


def _recorded_dense(folder):
    load = _recording(folder)

    def dense():
        model = load()
        return lambda texts: [[w[1][1], 1.0] for w in model(texts)]

    return dense


def test_a_sparse_model_must_fit_its_texts(spark):
    text = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    for wrong in (lambda: lambda t: [([1], [1.0])], lambda: lambda t: [([1, 2], [1.0])] * len(t), lambda: lambda t: [([-1], [1.0])] * len(t)):
        with pytest.raises(Exception, match="the model returned|indices must be"):
            SparseModelEncoder(wrong).transform(text, "text").collect()
    with pytest.raises(ValueError, match="positive"):
        SparseModelEncoder(lambda: None, batch_rows=0)


def test_encoders_hold_few_texts_at_a_time():
    texts = pa.array([None, "", "a b a"] * 700 + ["long " * 1_000_000] * 2 + ["x"])
    pieces = list(encode._pieces(texts))
    assert pa.concat_arrays(pieces).equals(texts)
    assert all(len(p) <= 512 and (len(p) == 1 or p.nbytes <= 3 << 20) for p in pieces)
    assert list(encode._pieces(texts[:0])) == []


def test_texts_of_several_pieces_keep_their_rows(spark):
    rows = spark.range(1500).coalesce(1).selectExpr("id", "CASE WHEN id % 7 > 0 THEN concat('w', id, ' both w', id) END AS text")
    dense = encode.HashingEncoder(8, normalise=False).transform(rows, "text")
    got = {r.id: r for r in dense.withColumn("sparse", encode.word_counts(F.col("text"))).collect()}
    for i, r in got.items():
        assert sorted(r.sparse["values"]) == ([1.0, 2.0] if i % 7 else [])
        assert sum(map(abs, r.dense)) in ((1.0, 3.0) if i % 7 else (0.0,))
    assert len(got) == 1500 and len({tuple(r.sparse.indices) for r in got.values() if r.id % 7}) == sum(i % 7 > 0 for i in range(1500))


def test_encoders_remember_no_words(spark, monkeypatch):
    made = []
    monkeypatch.setattr(encode.F, "arrow_udf", lambda kind: lambda f: made.append(f) or (lambda *columns: columns[0]))
    encode.word_counts(F.col("text"))
    encode.HashingEncoder(8).column(F.col("text"))
    texts = pa.array([" ".join(f"w{i + j}" for j in range(100)) for i in range(0, 100_000, 100)])
    for encoder in made:
        encoder(texts[:10])
        tracemalloc.start()
        assert len(encoder(texts)) == 1000
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        assert held < 1 << 20
    assert len(made) == 2


def test_words_are_numbered_by_their_md5():
    texts = pa.array(["  a é a ", None, "", " ", "日本 a", "x" * 5000])
    rows, codes = encode._batch_codes(texts)
    words = ["a", "é", "a", "日本", "a", "x" * 5000]
    assert rows.tolist() == [0, 0, 0, 4, 4, 5]
    assert codes.tolist() == [int(hashlib.md5(w.encode()).hexdigest()[:9], 16) for w in words]
    for few in (texts[:0], texts[1:3], texts[2:4]):
        assert [len(x) for x in encode._batch_codes(few)] == [0, 0]
