"""The pipeline's stages against plain versions of each decision."""

import corpus_pipeline
from pyspark.sql import functions as F

from nearfield.llm import quality
from nearfield.llm.common import table
from tests.llm.test_similar import plain_least
from tests.llm.test_substrings import plain as plain_repeats


def test_stages_decide_as_their_operators(spark, small):
    db, folder = small
    docs = table(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, folder).cache()
        steps[name] = ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()})
        if name != "mixing to target weights":
            assert docs.schema.names == table(spark, folder, "documents").schema.names
    before, after = steps["quality classifier"]
    model = quality.train(table(spark, folder, "documents"), table(spark, folder, "labels"))
    scores = {r.doc_id: r.score for r in quality.score_texts(table(spark, folder, "documents"), model).collect()}
    assert set(after) == {i for i in before if scores[i] >= 0.7} and 0 < len(after) < len(before)
    before, after = steps["simhash near-dedup"]
    least = plain_least([(i, r.text) for i, r in before.items()])
    assert set(after) == {i for i, c in least.items() if i == c} and len(after) < len(before)
    before, after = steps["substring dedup"]
    plain = plain_repeats([(i, r.text) for i, r in before.items()])
    assert set(after) == {i for i, (n, gone, _) in plain.items() if not gone or gone < n}
    for i, r in after.items():
        assert r.n_chars == len(r.text) and len(r.text.split()) == plain[i][0] - plain[i][1]
    before, after = steps["benchmark decontamination"]
    items = [" ".join(t.split()) for (t,) in db.execute("SELECT text FROM benchmark").fetchall()]
    held = {i for i, r in before.items() if any(t in " ".join(r.text.split()) for t in items)}
    assert not held & set(after) and len(before) - len(after) <= len(held) + 3
    before, after = steps["mixing to target weights"]
    assert after and set(after) <= set(before) and all(r.epochs >= 1 for r in after.values())
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.epochs for r in found} == {i: r.epochs for i, r in after.items()}
    assert list(stages) == [n for n, _ in corpus_pipeline.STAGES]


CLASHING = ("hits", "spans", "its_id", "its_part", "its_removed", "its_words", "domain", "n_words", "node", "words", "score", "held_out", "id", "part")


def test_columns_of_any_name_stay(spark, docs, small):
    """No stage fails on, drops or overwrites a column because it uses the name itself."""
    texts = [f"words number {i} of a text that says what {i * i} is about " * 4 for i in range(12)]
    rows = docs(*enumerate([*texts, texts[3] + " more", texts[4]])).select("doc_id", "text", "lang", "source", "n_chars")
    for c in CLASHING:
        rows = rows.withColumn(c, F.concat(F.lit(f"{c} "), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[1:]:
        if name == "mixing to target weights":
            rows = rows.drop("domain")
        after = stage(spark, rows, small[1])
        assert after.columns[: len(rows.columns)] == rows.columns or name == "mixing to target weights"
        found = after.collect()
        assert found and all(r[c] == f"{c} {r.doc_id}" for r in found for c in CLASHING if c in rows.columns)
        rows = after


def test_documents_stay_where_no_classifier_could_learn(spark, small, tmp_path):
    docs = table(spark, small[1], "documents").limit(20)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = table(spark, small[1], "labels")
    for name, rows in (("none", labels.limit(0)), ("one", labels.where("quality = 1"))):
        rows.write.parquet(str(tmp_path / name / "labels.parquet"))
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        assert corpus_pipeline.quality_filter(spark, docs, str(tmp_path / name)).count() == 20


def test_edge_rows_pass(spark, docs, small):
    rows = docs((1, None), (2, ""), (2, ""), (None, "a text without an id"), (3, "some words " * 50)).select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, small[1])
        assert frame.count() <= 5
