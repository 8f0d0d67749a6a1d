import pytest

from nearfield.llm import decontaminate as dc
from nearfield.llm.common import table

QUESTION = "A train leaves Paris at 9:15 with 120 passengers and travels 300 km before it meets the bus that Anna drives to Rome"
OTHER = "A train leaves London at 8:40 with 75 passengers and travels 210 miles before it meets the bus that Maria drives to Berlin"
MIXED = "A train leaves London at 8:40 with 75 passengers and travels 75 km before it meets the bus that London drives to London"


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, QUESTION), (2, "Short one"), (3, None), (4, ""), (None, "Some text that has no item id at all here"), (1, QUESTION)]
    return spark.createDataFrame([(*r, 7) for r in rows], "item_id bigint, text string, doc_id int")


def test_changed_values_are_found(docs, bench):
    rows = [(1, "Intro words. " + QUESTION + " and more text."), (2, "x y z " + OTHER), (3, MIXED), (4, "Nothing of the kind here at all, no."),
            (5, None), (6, ""), (7, "this is a SHORT one, is it"), (8, "word " * 200_000 + QUESTION), (None, QUESTION), (1, QUESTION)]
    found = {(r.doc_id, r.item_id): r for r in dc.contaminated(docs(*rows), bench).collect()}
    assert set(found) == {(1, 1), (2, 1), (7, 2), (8, 1), (None, 1)}
    assert not found[1, 1].reparameterised and found[2, 1].reparameterised
    assert found[8, 1].share == 1.0
    kept = dc.drop_contaminated(docs(*rows), bench)
    assert kept.columns == docs((1, "a")).columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]


def test_values_must_correspond():
    block = dc.Items([(1, QUESTION)])
    for text, all_windows in ((QUESTION, True), (OTHER, True), (MIXED, False)):
        tokens = dc.Tokens()
        code, _, numbers, _ = tokens.of([text])
        pairs = [(place, at, size) for _, _, place, at, size in block.matches(code, numbers * 0)]
        n, _ = dc._consistent(pairs, block.slots[0], {i: tokens.values[k] for i, k in enumerate(numbers)})
        assert len(pairs) == block.totals[0] and (n == len(pairs)) == all_windows


def test_blocks_and_empty_tables(docs, bench, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 1)
    rows = docs((1, QUESTION), (2, "a short one"))
    assert sorted((r.doc_id, r.item_id) for r in dc.contaminated(rows, bench).collect()) == [(1, 1), (2, 2)]
    assert dc.contaminated(rows, bench.limit(0)).count() == 0
    assert dc.drop_contaminated(rows, bench.limit(0)).count() == 2
    assert dc.contaminated(rows.limit(0), bench).count() == 0


def test_passages_of_the_tables(spark, small):
    """Documents that hold an item word for word are found; the others have few of its words in a row."""
    db, folder = small
    items = db.execute("SELECT item_id, text FROM benchmark").fetchall()
    texts = {i: " ".join((t or "").split()) for i, t in db.execute("SELECT doc_id, text FROM documents").fetchall()}
    verbatim = {(d, i) for d, t in texts.items() for i, b in items if " ".join(b.split()) in t}
    found = {(r.doc_id, r.item_id) for r in dc.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).collect()}
    assert verbatim and verbatim <= found
    for d, i in found - verbatim:
        words = dict(items)[i].split()
        assert any(" ".join(words[k : k + 6]) in texts[d] for k in range(len(words) - 5))


def test_each_occurrence_is_judged_by_itself(spark, docs):
    def asked(numbers):
        words = "a tank holds {} litres and a pump moves {} of them in {} minutes while {} leak out each {} hours so after {} days or {} weeks how many of {} remain"
        return words.format(*numbers)

    item = asked([11, 12, 13, 14, 15, 16, 17, 18])
    others = [asked([100 * k + j for j in range(8)]) for k in range(1, 7)]
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = docs((1, item), (2, f"{item} . {others[0]}"), (3, " . ".join([*others, item])), (4, " . ".join(others)), (5, f"{others[0]} {item}"),
                (6, item.replace("while", "while it is the case that for some reason or other about")))
    found = {r.doc_id: r for r in dc.contaminated(rows, bench).collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6}
    assert all(found[i].share == 1.0 for i in (1, 2, 3, 4, 5))
    assert {i for i, r in found.items() if r.reparameterised} == {4}


def test_every_item_has_windows_and_long_quotes_are_found(spark, docs):
    long = " ".join(f"word{k}" for k in range(51))
    items = ["1 2 4 8 16 32 what comes next", "What is 56?", "Who wrote Hamlet", long, "7 8 9 10 11 12 13 14 15 16"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = docs((0, "so 1 2 4 8 16 32 what comes next is asked"), (1, "tell me: what is 56? please"), (2, "and who wrote Hamlet then"),
                (3, "x " + " ".join(long.split()[20:33]) + " y"), (4, "count 7 8 9 10 11 12 13 14 15 16 on"), (5, " ".join(long.split()[20:32])),
                (6, "so 3 2 4 8 16 33 what"), (7, "what is 57? who wrote Macbeth"), (8, "1 2 3 4 5 6 7 8 9"), (9, None), (10, "56"))
    found = {(r.doc_id, r.item_id): r for r in dc.contaminated(rows, bench).collect()}
    assert set(found) == {(k, k) for k in range(5)}
    assert all(found[k, k].share == 1.0 for k in (0, 1, 2, 4)) and not any(r.reparameterised for r in found.values())
    assert (found[3, 3].n_matched, found[3, 3].n_windows) == (6, 44)
