"""Benchmark decontamination by templates: finds questions also when their values were changed.

Numbers, units after numbers and names become typed placeholders; what is left are words
without case and outer punctuation. Windows of such tokens are looked up in a hash table of
the benchmark's windows. For each occurrence of an item in a document the values behind the
placeholders must correspond one to one; windows whose values contradict its majority do not
count, and the best occurrence is reported.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import WORD_CACHE, Batches, each_batch, fresh, gram_hashes, stored
from nearfield.session import broadcast_if_small

WINDOW = 8
# Tokens of a window that must be words, so that placeholders alone match nothing.
LEAST_WORDS = 4
# Share of an item's windows that a document must have.
SHARE = 0.3
# Tokens of an item in a row, values unchanged, that are a match whatever their share.
RUN = 13
# Items looked up at once, and characters of their texts: bounds what every task holds.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000

WORD, NUMBER, UNIT, NAME = range(4)
# Units of measure that may follow a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons oz lb lbs pound pounds ml cl l "
    "liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years mph kmh km/h m/s hz khz mhz ghz w kw mw j kj cal kcal v a b kb mb gb tb c f k % $ € £ dollar dollars euro "
    "euros cent cents percent degree degrees".split()
)
_NUMBER = re.compile(r"[-+$€£]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th|%)?")
_NUMBER_UNIT = re.compile(r"([-+]?\d+(?:[.,]\d+)*)([^\W\d_]+|%)")
_PLACEHOLDERS = np.array([0, 0x5EED_0001, 0x5EED_0002, 0x5EED_0003], np.uint64)


class Tokens:
    """Numbers the tokens of a task, with what each is by itself; forgets them when too many."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.codes: list[int] = []
        self.kinds: list[int] = []
        self.ends: list[bool] = []
        self.values: list[str] = []
        self._made: tuple[np.ndarray, ...] | None = None

    def _add(self, token: str) -> int:
        bare = token.strip("\"'()[]{}<>.,;:!?«»“”‘’…*#&") or token
        lower = bare.lower()
        if _NUMBER.fullmatch(bare) or _NUMBER_UNIT.fullmatch(bare) and lower.lstrip("+-.,0123456789") in UNITS:
            kind = NUMBER
        elif lower in UNITS:
            kind = UNIT
        elif bare[:1].isupper() and bare[1:].islower():
            kind = NAME
        else:
            kind = WORD
        self.codes.append(xxhash.xxh64_intdigest(lower, 3))
        self.kinds.append(kind)
        self.ends.append(token.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":"))
        self.values.append(lower)
        self._made = None
        n = self.number[token] = len(self.number)
        return n

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(codes, kinds, token numbers, sizes) of the tokens of several texts, one after another."""
        if len(self.number) >= WORD_CACHE:
            self.clear()
        known, add, numbers, sizes = self.number, self._add, [], []
        for text in texts:
            tokens = (text or "").split()
            sizes.append(len(tokens))
            numbers.extend(known[t] if t in known else add(t) for t in tokens)
        if self._made is None:
            self._made = (np.array(self.codes, np.uint64), np.array(self.kinds, np.uint8), np.array(self.ends, bool))
        codes, kinds, ends = self._made
        at, sizes = np.array(numbers, np.int64), np.array(sizes, np.int64)
        kind = kinds[at]
        opens = np.zeros(len(at) + 1, bool)
        opens[1:] = ends[at]
        opens[np.cumsum(sizes)] = True
        opens[:1] = True
        # A capital that opens a sentence tells nothing, and a unit is one after a number only.
        kind[(kind == NAME) & opens[:-1]] = WORD
        after = np.concatenate([[False], kind[:-1] == NUMBER])[: len(kind)]
        after[opens[:-1]] = False
        kind[(kind == UNIT) & ~after] = WORD
        code = np.where(kind == WORD, codes[at], _PLACEHOLDERS[kind])
        return code, kind, at, sizes

    def exact(self, numbers: np.ndarray) -> np.ndarray:
        """Codes of the tokens just numbered by ``of``, without placeholders."""
        return self._made[0][numbers]


class Items:
    """Windows of a block of benchmark items, ready to look up.

    Windows of too few words for placeholders keep their values and match those alone.
    """

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW) -> None:
        tokens = Tokens()
        self.ids, self.slots, self.totals = [], [], Counter()
        # Of each item, which of its windows have placeholders.
        self.open: dict[int, np.ndarray] = {}
        at: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        for item_id, text in items:
            code, kind, numbers, _ = tokens.of([text])
            size, k = min(window, len(code)), len(self.ids)
            self.ids.append(item_id)
            self.slots.append([tokens.values[n] if t != WORD else None for n, t in zip(numbers.tolist(), kind.tolist())])
            if not size:
                continue
            words = np.convolve(kind == WORD, np.ones(size, int), "valid")
            self.open[k] = words >= min(LEAST_WORDS, size)
            self.totals[k] = len(words)
            for exact, codes in ((False, code), (True, tokens.exact(numbers))):
                good = np.flatnonzero(self.open[k] != exact)
                if len(good):
                    at[size, exact].append((gram_hashes(codes, size)[good], np.full(len(good), k), good))
        self.windows = {}
        for key, found in at.items():
            hashes, which, place = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(hashes, kind="stable")
            self.windows[key] = (hashes[order], which[order], place[order])

    def matches(self, code: np.ndarray, text: np.ndarray, exact_code: np.ndarray | None = None) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, place in the item, place in the text, size) of each common window.

        Windows that keep their values are looked up in ``exact_code`` only.
        """
        for (size, exact), (hashes, which, place) in self.windows.items():
            if exact and exact_code is None:
                continue
            grams = gram_hashes(exact_code if exact else code, size)
            if not len(grams):
                continue
            low = np.searchsorted(hashes, grams, "left")
            hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == grams)
            hit = hit[text[hit] == text[hit + size - 1]]
            high = np.searchsorted(hashes, grams[hit], "right")
            for p, a, b in zip(hit.tolist(), low[hit].tolist(), high.tolist()):
                for j in range(a, b):
                    yield int(text[p]), int(which[j]), int(place[j]), p, size


Window = tuple[int, int, int]


def _kept(pairs: list[Window], first: list[Window], slots: list[str | None], values: dict[int, str]) -> tuple[list[Window], bool]:
    """Windows whose values correspond one to one, and whether any differ; those of ``first`` are heard before all others."""
    def slot_pairs(place: int, at: int, size: int) -> list[tuple[str, str]]:
        return [(slots[place + k], values[at + k]) for k in range(size) if slots[place + k] is not None]

    there: dict[str, str] = {}
    back: dict[str, str] = {}
    for heard in (first, pairs):
        seen = Counter(v for w in heard for v in slot_pairs(*w))
        for (a, b), _ in sorted(seen.items(), key=lambda v: (-v[1], v[0])):
            if a not in there and b not in back:
                there[a], back[b] = b, a
    kept = [w for w in pairs if all(there.get(a) == b for a, b in slot_pairs(*w))]
    return kept, any(a != b for w in kept for a, b in slot_pairs(*w))


def _occurrences(pairs: list[Window]) -> Iterator[list[Window]]:
    """Windows of one place in the text minus place in the item, and of places a few tokens apart."""
    along: dict[int, list[Window]] = defaultdict(list)
    for w in pairs:
        along[w[1] - w[0]].append(w)
    gap = (min(size for *_, size in pairs) - 1) // 2
    yield from along.values()
    group: list[int] = []
    for at in [*sorted(along), None]:
        if group and (at is None or at - group[-1] > gap):
            if len(group) > 1:
                yield [w for g in group for w in along[g]]
            group = []
        group.append(at)


def _best(pairs: list[Window], slots: list[str | None], values: dict[int, str]) -> tuple[list[Window], bool]:
    """The consistent windows of the occurrence that has most, and whether their values differ.

    Each occurrence of the item in the text is judged by itself; windows elsewhere that fit the
    best one count with it. The vote of all windows together stands where it finds more.
    """
    def worth(found: tuple[list[Window], bool]) -> tuple[int, bool]:
        return len({place for place, *_ in found[0]}), not found[1]

    seed = max(_occurrences(pairs), key=lambda o: worth(_kept(o, [], slots, values)))
    return max(_kept(pairs, seed, slots, values), _kept(pairs, [], slots, values), key=worth)


def _consistent(pairs: list[Window], slots: list[str | None], values: dict[int, str]) -> tuple[int, bool]:
    """Windows of the item whose values correspond one to one with the text's, and whether any differ."""
    kept, changed = _best(pairs, slots, values)
    return len({place for place, *_ in kept}), changed


def _longest(pairs: list[Window], slots: list[str | None], values: dict[int, str]) -> int:
    """The most windows in a row, in the item and in the text, whose values are unchanged."""
    same = {(at - place, place) for place, at, size in pairs if all(slots[place + k] in (None, values[at + k]) for k in range(size))}
    most, length, last = 0, 0, None
    for line, place in sorted(same):
        length = length + 1 if last == (line, place - 1) else 1
        most, last = max(most, length), (line, place)
    return most


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; the driver holds two of them at most."""
    block: list[tuple[int, str]] = []
    chars = 0
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + len(r.text) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((int(r.item_id), r.text))
        chars += len(r.text)
    if block:
        yield block


FOUND = "doc_id bigint, item_id bigint, n_matched bigint, n_windows bigint, share double, reparameterised boolean"


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs`` and benchmark item whose windows it has.

    A match has ``share`` of all windows of the item, or of those with placeholders, or RUN of
    its tokens in a row unchanged; n_matched and n_windows count what gives the greater share.

    ``docs`` has doc_id, text; ``benchmark`` item_id, text. Null and blank texts match nothing;
    an item shorter than a window is one window. A null doc_id keeps its rows; repeated rows
    each have theirs; repeated items count once. Other columns are not read. Documents are
    read whole and never shuffled; each block of items is sent to the tasks.
    """
    found = None
    for items in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Batches, sent=sent) -> Batches:
            block, tokens = Items(sent.value, window), Tokens()

            def find(batch: pa.RecordBatch) -> pa.RecordBatch:
                ids = batch.column(0).to_pylist()
                code, kind, numbers, sizes = tokens.of(batch.column(1).to_pylist())
                text = np.repeat(np.arange(len(sizes)), sizes)
                pairs: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
                for t, item, place, at, size in block.matches(code, text, tokens.exact(numbers)):
                    pairs[t, item].append((place, at, size))
                rows = []
                for (t, item), windows in pairs.items():
                    total, opened = block.totals[item], block.open[item]
                    row_of = max(1, RUN - windows[0][2] + 1)

                    def of(found: set[int], total=total, opened=opened) -> tuple[int, int]:
                        """Windows found and windows counted, of all or of those with placeholders, whichever is more."""
                        n, m = sum(1 for p in found if opened[p]), int(opened.sum())
                        return (n, m) if n * total > len(found) * m else (len(found), total)

                    n, m = of({p for p, *_ in windows})
                    if n < share * m and len(windows) < row_of:
                        continue
                    near = {at + k for _, at, size in windows for k in range(size)}
                    values = {p: tokens.values[numbers[p]] for p in near}
                    kept, changed = _best(windows, block.slots[item], values)
                    n, m = of({p for p, *_ in kept})
                    if n < share * m:
                        row = _longest(windows, block.slots[item], values)
                        if row < row_of:
                            continue
                        if row >= n:
                            n, m, changed = row, total, False
                    rows.append((ids[t], block.ids[item], n, m, n / m, changed))
                return pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r)) for r in rows], schema=_SCHEMA)

            return each_batch(find)(batches)

        part = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, FOUND)
        found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], FOUND)


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_matched", pa.int64()), ("n_windows", pa.int64()), ("share", pa.float64()), ("reparameterised", pa.bool_())]
)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs`` without the documents that have benchmark items; rows without an id are judged row by row."""
    row = fresh(docs, "row")
    whole = docs.withColumn(row, F.coalesce(F.col("doc_id").cast("bigint"), -F.abs(F.xxhash64(F.coalesce("text", F.lit(""))))))
    found = contaminated(whole.select(F.col(row).alias("doc_id"), "text"), benchmark, share)
    ids = stored(found.select(F.col("doc_id").alias(row)).distinct())
    return whole.join(broadcast_if_small(ids), row, "left_anti").select(*docs.columns)
