"""Spelling variants: words one edit apart, found by composing finite-state machines.

The vocabulary is dealt out so that each group is what the composed machine accepts from one
initial state: words of one length L, and of L + 1, that share all but a stretch of their
code points, in which the edit lies. Of a group's stretches a minimised acyclic acceptor is
built for either length; composing acceptor, one-edit transducer and acceptor again and
walking the composition from its initial state enumerates the accepted pairs.

A word of length L belongs to the groups of both halves of its places, so two words one edit
apart meet in exactly one group: that of the half where they first differ. Groups that
are still too large are halved again, at worst down to a single place, where only as many
words can share the rest as there are letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import WORD_CACHE, Batches, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
# One run in so many loses a code point, chosen by its hash.
DAMAGED = 199
LEAST_LETTERS, LEAST_COUNT = 6, 5
# A form is so many times as frequent as its variant.
LEAD = 5
# Words of a group that one acceptor takes; larger groups are halved.
GROUP_WORDS = 20_000


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: runs of letters over whole texts, A-Z lower-cased, some damaged; all lengths.

    ``docs``: doc_id, text. Null texts hold no words; a null id hashes as an empty one.
    """

    def run(batches: Batches) -> Batches:
        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return made

        seen: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                start = zlib.crc32(f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode())
                for word, n in Counter(RUN.findall((text.as_py() or "").translate(_LOWER))).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % DAMAGED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    seen[word] += n
                if len(seen) >= WORD_CACHE:
                    yield flush()
        yield flush()

    narrow = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The minimal acyclic acceptor of sorted, distinct words of one length: arcs of each state, letter to state.

    Equal sets of endings are one state. A state knows its endings' number of letters by its depth.
    """

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = []
        known: dict[tuple, int] = {}
        path: list[dict[str, int]] = [{}]
        last = ""

        def close(depth: int) -> None:
            # Freeze the states of the last word that no later word can enter.
            while len(path) > depth + 1:
                arcs = path.pop()
                key = tuple(arcs.items())
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.arcs)
                    self.arcs.append(arcs)
                path[-1][last[len(path) - 1]] = state

        for word in words:
            same = 0
            while same < len(last) and last[same] == word[same]:
                same += 1
            close(same)
            path.extend({} for _ in range(len(word) - same))
            last = word
        close(0)
        self.start = len(self.arcs)
        self.arcs.append(path[0])


class Composed:
    """Two acceptors read side by side, after the edit: pairs of states, one from each."""

    def __init__(self, a: Acceptor, b: Acceptor) -> None:
        self.a, self.b = a.arcs, b.arcs
        self.same = a is b
        self.memo: dict[tuple[int, int], bool] = {}

    def _next(self, p: int, q: int) -> list[tuple[str, int, int]]:
        x, y = self.a[p], self.b[q]
        return [(c, to, y[c]) for c, to in x.items() if c in y]

    def meets(self, p: int, q: int) -> bool:
        """Whether some ending is accepted from both. Words may be long, so it does not recur."""
        memo = self.memo
        stack = [(p, q)]
        while stack:
            at = stack[-1]
            if at in memo:
                stack.pop()
                continue
            if self.same and at[0] == at[1] or not self.a[at[0]] and not self.b[at[1]]:
                memo[at] = True
                continue
            open_ones, found = [], False
            for _, *to in self._next(*at):
                known = memo.get(tuple(to))
                if known:
                    found = True
                    break
                if known is None:
                    open_ones.append(tuple(to))
            if found or not open_ones:
                memo[at] = found
            else:
                stack.append(open_ones[0])
        return memo[p, q]

    def endings(self, p: int, q: int) -> Iterator[str]:
        """All endings that both accept."""
        if not self.meets(p, q):
            return
        read: list[str] = []
        stack = [(0, "", p, q)]
        while stack:
            depth, letter, p, q = stack.pop()
            del read[max(0, depth - 1) :]
            if depth:
                read.append(letter)
            if not self.a[p]:
                yield "".join(read)
            stack.extend((depth + 1, c, u, v) for c, u, v in self._next(p, q) if self.meets(u, v))


def pairs(short: list[str], long: list[str], edits: int) -> Iterator[tuple[str, str]]:
    """Pairs that first differ before place ``edits``: equal lengths by a replaced letter, each
    once; else (shorter, longer) by one inserted letter.

    ``short`` holds sorted words of one length, ``long`` of one more.
    """
    if not short:
        return
    a = Acceptor(short)
    after = Composed(a, a)
    read: list[str] = []
    walk = [(0, "", a.start)]
    while walk:
        depth, letter, p = walk.pop()
        del read[max(0, depth - 1) :]
        if depth:
            read.append(letter)
        arcs = list(a.arcs[p].items())
        for i, (c, to) in enumerate(arcs):
            for d, other in arcs[i + 1 :]:
                for rest in after.endings(to, other):
                    start = "".join(read)
                    yield start + c + rest, start + d + rest
        if depth + 1 < edits:
            walk.extend((depth + 1, c, to) for c, to in arcs)
    if not long:
        return
    b = Acceptor(long)
    after = Composed(a, b)
    both = [(0, "", a.start, b.start)]
    while both:
        depth, letter, p, q = both.pop()
        del read[max(0, depth - 1) :]
        if depth:
            read.append(letter)
        x, y = a.arcs[p], b.arcs[q]
        for c, to in y.items():
            # The longer word reads c here and the shorter one another letter, or ends: the first difference.
            if not x:
                yield "".join(read), "".join(read) + c
            for d in x.keys() & b.arcs[to].keys() - {c}:
                for rest in after.endings(x[d], b.arcs[to][d]):
                    start = "".join(read)
                    yield start + d + rest, start + c + d + rest
        if depth + 1 < edits:
            both.extend((depth + 1, c, x[c], y[c]) for c in x if c in y)


def _group(base: str, low: str, high: str, word: str = "word") -> str:
    """SQL of a group's key: length, first and last place of the edit, and all that words share."""
    return f"concat_ws(':', {base}, {low}, {high}, left({word}, {low}), right({word}, greatest(0, {base} - {high})))"


def _halved(rows: DataFrame) -> DataFrame:
    """word, n, base, low, high: each row's places [low, high) in two halves; one place stays whole."""
    middle = "(low + high) div 2"
    sides = f"if(high - low < 2, array(struct(low, high)), array(struct(low, {middle} AS high), struct({middle} AS low, high)))"
    return rows.select("word", "n", "base", F.explode(F.expr(sides)).alias("side")).select("word", "n", "base", "side.low", "side.high")


def _grouped(words: DataFrame, most: int) -> DataFrame:
    """word, n, base, low, high, key: rows dealt to groups of at most ``most`` words, but for single places."""
    length = F.length("word")
    # A word is one of its own length, and the longer one beside words one letter shorter.
    whole = words.where(length > 0).select("word", "n", F.explode(F.array(length, length - 1)).alias("base"))
    # An inserted letter may come after the last, so there are base + 1 places.
    rows = _halved(whole.select("word", "n", "base", F.lit(0).alias("low"), (F.col("base") + 1).alias("high")))
    key = F.expr(_group("base", "low", "high"))
    done = None
    while True:
        rows = stored(rows.withColumn("key", key))
        large = rows.where("high - low > 1").groupBy("key").count().where(F.col("count") > most).select("key")
        large = stored(large)
        small = rows.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        rows = _halved(rows.join(large, "key", "left_semi"))


def near_words(words: DataFrame, most: int = GROUP_WORDS) -> DataFrame:
    """word, n, n_near, best, best_n: each word that has near ones, and the most frequent of these.

    ``words``: distinct ``word`` with their ``n``. Equal counts go by code points. A pair is
    found in one group only, so groups add up; none writes out its pairs.
    """
    rows = _grouped(words, most)
    entry = F.struct("word", "n")
    own = F.length("word") == F.col("base")
    # Bounded: larger groups were halved until they have few words, or a single place.
    groups = rows.groupBy("key", "base", "low", "high").agg(F.collect_list(entry).alias("words"), F.max(own).alias("any")).where("any AND size(words) > 1")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            near: dict[str, list] = {}
            for base, low, high, found in zip(*(batch.column(i) for i in range(4))):
                base, low, high = base.as_py(), low.as_py(), high.as_py()
                members = {r["word"]: r["n"] for r in found.as_py()}
                front = next(iter(members))[:low]
                back = max(0, base - high)
                by = defaultdict(list)
                for w in sorted(members):
                    by[len(w)].append(w[low : len(w) - back])
                end = next(iter(members))[-back:] if back else ""
                for a, b in pairs(by[base], by[base + 1], high - low):
                    a, b = front + a + end, front + b + end
                    for one, other in ((a, b), (b, a)):
                        n = members[other]
                        at = near.get(one)
                        if at is None:
                            near[one] = [members[one], 1, other, n]
                        else:
                            at[1] += 1
                            if (n, at[2]) > (at[3], other):
                                at[2:] = other, n
            if near:
                columns = zip(*((w, *v) for w, v in near.items()))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["word", "n", "n_near", "best", "best_n"])

    found = groups.select("base", "low", "high", "words").mapInArrow(run, "word string, n bigint, n_near bigint, best string, best_n bigint")
    # The greatest n first, then the least word: max_by of n, among those the least.
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best"))).alias("b")
    return found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best).select("word", "n", "n_near", "b.best", (-F.col("b.minus")).alias("best_n"))


def variants(words: DataFrame, lead: int = LEAD, most: int = GROUP_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of ``words`` (distinct word, n).

    A word's form is its most frequent near word if that is ``lead`` times as frequent; its
    root is where forms lead in the end. An empty table gives no rows.
    """
    words = stored(words)
    near = near_words(words, most).withColumn("leads", F.col("best_n") >= lead * F.col("n"))
    near = near.select("word", "n_near", F.when(F.col("leads"), F.col("best")).alias("form"), F.when(F.col("leads"), F.col("best_n")).alias("form_n"))
    near = stored(near)
    # Each round doubles how far a root lies, and each form is ``lead`` times as frequent: a few rounds.
    roots = near.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        roots = stored(roots)
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = roots.join(on, "root")
        if further.isEmpty():
            break
        roots = roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n",
    )


def spelling_variants(docs: DataFrame, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """``variants`` of the words of ``docs`` (doc_id, text) that have so many letters and occur so often.

    Repeated rows count as often; other columns are not read.
    """
    frequent = word_counts(docs).where((F.col("n") >= count) & (F.length("word") >= letters))
    return variants(frequent)
