"""Both classifiers against labels they never saw, and on edge rows."""

import math
import re
import zlib

import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from nearfield.llm import quality, toxicity
from nearfield.llm.common import held_out, table
from nearfield.llm.samples import labelled_sample

SF = "/root/testdata/sf0.1"
SCORERS = {"quality": quality.quality_scores, "toxic": toxicity.toxicity_scores}


@pytest.mark.parametrize("label", SCORERS)
def test_held_out_accuracy(spark, label):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    judged = labels.select("doc_id", F.col(label).alias("y"))
    rows = SCORERS[label](docs.join(judged, "doc_id", "left_semi"), labels).where("held_out").join(judged, "doc_id").collect()
    assert len(rows) > 500
    right = {y: sum(r.predicted == y for r in rows if r.y == y) / sum(r.y == y for r in rows) for y in (0, 1)}
    if label == "quality":
        assert right[1] >= 0.97 and right[0] >= 0.9
    else:
        assert right[1] >= 0.9 and right[0] >= 0.97
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


@pytest.mark.parametrize("label", SCORERS)
def test_edge_rows(spark, docs, label):
    rows = [(i, f"good text number {i} of many") for i in range(20)] + [(i, "bad moron " * i) for i in range(20, 40)]
    rows += [(50, None), (51, ""), (None, "no id"), (52, "word " * 200_000), (52, "word " * 200_000)]
    frame = docs(*rows)
    marks = [(i, int(i < 20), int(i >= 20), 0.1) for i in range(40)] + [(None, 1, 1, 0.1), (3, None, None, 0.1), (999, 1, 0, 0.1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int, score double")
    found = SCORERS[label](frame, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found}
    assert by_id[None].held_out and by_id[50].score == by_id[51].score
    assert len({r.score for r in found if r.doc_id == 52}) == 1
    # without labels every text scores alike
    assert len({r.score for r in SCORERS[label](frame, labels.limit(0)).collect()}) == 1
    assert SCORERS[label](frame.limit(0), labels).count() == 0


def test_held_out_rows_teach_nothing(spark, docs):
    rows = docs(*((i, f"text {i}") for i in range(60)))
    marks = [(i, i % 2, 0) for i in range(60)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    sample, counts = labelled_sample(rows, labels, "quality")
    assert {i for i, *_ in sample} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert sum(counts.values()) == len(sample)
    kept = labels.where(~held_out("doc_id"))
    assert quality.train(rows, labels) == quality.train(rows, kept)
    few, _ = labelled_sample(rows, labels, "quality", rows=3, octets=14)
    assert len(few) == 4


def test_the_machine_learns_meetings():
    """Neither word alone is toxic; both together are."""
    texts = [("alpha", 0), ("beta", 0), ("alpha beta", 1), ("gamma", 0)] * 60
    machine = toxicity.fit([(i, t.encode(), y) for i, (t, y) in enumerate(texts)], {0: 180, 1: 60})
    terms = toxicity.Terms(machine.slots)
    score = {t: machine.score(terms.of(t)) for t, _ in texts}
    assert score["alpha beta"] > 0.5 > max(v for t, v in score.items() if t != "alpha beta")
    assert (machine.factors**2).sum() > 0.1


def test_accepted_keeps_columns_and_decides(spark, docs):
    frame = docs((1, "a b c"), (2, None))
    model = quality.CompressionModel(b"", b"", (0.0,) * 5, (1.0,) * 5, (0.0, 0.0, 0.0, 0.0, 1.0, -3.0))
    kept = quality.accepted(frame, model)
    assert kept.schema == frame.schema and kept.collect() == []
    assert quality.accepted(frame, model, threshold=0.45).collect() == frame.where("doc_id = 1").collect()


@pytest.mark.parametrize("texts", [["a b", "c d", "e f"] * 2, ["same words"] * 6, [""] * 6])
def test_no_term_tells(spark, docs, texts):
    """Too few texts, equal ones or empty ones: every text scores the labels' mean."""
    machine = toxicity.fit([(i, t.encode(), i % 2) for i, t in enumerate(texts)], {0: 3, 1: 3})
    assert machine.score([]) == pytest.approx(0.5) and len(machine.slots) == 0
    rows = docs(*((i, t) for i, t in enumerate(texts * 5)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id bigint, toxic int")
    assert len({round(r.score, 9) for r in toxicity.toxicity_scores(rows.where("doc_id < 6"), labels).collect()}) == 1


def test_a_text_that_does_not_fit_leaves_room_for_others(spark, docs):
    rows = docs(*((i, "x" * (5_000 if i % 5 == 0 else 10)) for i in range(60)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    sample, _ = labelled_sample(rows, labels, "quality", octets=1_000)
    learnt = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert {i for i, *_ in sample} == {i for i in learnt if i % 5}


@pytest.mark.parametrize("label", SCORERS)
def test_scores_equal_plain_ones(spark, docs, label):
    """Each row scores what the fitted model gives its text alone, by the formula written out."""
    rows = [(i, f"good text number {i} of many, and more of it " * 3) for i in range(40)] + [(i, f"bad moron {i % 3} " * 9) for i in range(40, 80)]
    frame = docs(*rows)
    labels = spark.createDataFrame([(i, int(i < 40), int(i >= 40)) for i in range(80)], "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r.score for r in SCORERS[label](frame, labels).collect()}
    if label == "quality":
        model = quality.train(frame, labels)
        for i, text in rows:
            raw = text.encode()
            good, bad, plain = (
                len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None).compress(raw))
                for d in (model.good, model.bad, b"")
            )
            n = len(raw) + 16
            values = [(bad - good) / max(good, bad), (bad - good) / n, good / n, plain / n, math.log(n)]
            z = sum((v - m) / s * w for v, m, s, w in zip(values, model.mean, model.scale, model.weights)) + model.weights[-1]
            assert found[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)
    else:
        machine = toxicity.train(frame, labels)
        place = {int(s): k for k, s in enumerate(machine.slots)}
        for i, text in rows:
            words = re.findall(r"[^\W\d_]+", text.lower())
            terms = {"w" + w for w in words} | {"p" + w[:n] for w in words for n in (3, 4, 5) if len(w) >= n}
            at = sorted({place[s] for t in terms if (s := xxhash.xxh64_intdigest(t, 7) % toxicity.SLOTS) in place})
            z = machine.bias + sum(machine.weights[k] for k in at)
            z += sum(float(machine.factors[a] @ machine.factors[b]) for k, a in enumerate(at) for b in at[k + 1 :])
            assert found[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)
