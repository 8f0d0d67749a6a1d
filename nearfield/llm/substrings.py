"""Exact substring deduplication: words covered by a window of 20 that also starts earlier go.

Each window belongs to its anchor, the run of six words in it with the least hash; equal
windows have equal anchors at the same place. Windows that follow one another and share
an anchor make a stretch. Stretches whose anchor occurs once hold no repeated window;
the others go, by anchor, to shards. A shard indexes its distinct stretches (FMIndex) and
streams them through it; each window's match with the earliest start tells whether it is
the first. Anchors of many stretches are dealt by window instead, so that no anchor, however
frequent, fills a shard. Equal stretches are reduced to the earliest before the shuffle,
batch by batch, and again in the shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import Batches, WordHashes, each_batch, fresh, give_back, gram_hashes, parts, stored, words_of
from nearfield.llm.fm_index import FMIndex

WINDOW = 20
ANCHOR = 6
# Anchors with more stretches than this are dealt by window.
FREQUENT = 4_096
# Stretches for each shard, before equal ones are reduced.
SHARD_STRETCHES = 40_000
HELD_TEXTS = 256

PLACES = "anchor bigint, ids array<bigint>, parts array<bigint>, starts array<int>"
# Stretches of one batch for one shard: their places, numbers of windows, and words by lines.
BUNDLES = "shard bigint, ids binary, parts binary, starts binary, ns binary, words binary"
SPANS = "id bigint, part bigint, first int, last int"


def _least_in_runs(values: np.ndarray, size: int) -> np.ndarray:
    """Position of the first least value in each run of ``size`` values."""
    at, have = np.arange(len(values)), 1
    least = values
    while have < size:
        shift = min(have, size - have)
        a, b = least[: len(least) - shift], least[shift:]
        later = b < a
        least, at = np.where(later, b, a), np.where(later, at[shift:], at[: len(at) - shift])
        have += shift
    return at


def _stretches(codes: np.ndarray, sizes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor hash) of each stretch of several texts' words, in their order."""
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    if len(codes) < window:
        return none
    grams = gram_hashes(codes, anchor)
    at = _least_in_runs(grams, window - anchor + 1)
    text = np.repeat(np.arange(len(sizes)), sizes)
    whole = text[: len(at)] == text[window - 1 : window - 1 + len(at)]
    place = np.flatnonzero(whole)
    if not len(place):
        return none
    at, text = at[place], text[place]
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return text[cut], place[cut] - first[text[cut]], np.diff(np.append(cut, len(at))), grams[at[cut]]


def _batch_stretches(texts: pa.Array, known: WordHashes, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, start, anchor hash) of each stretch of a batch, a few texts at a time."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
    for first in range(0, len(texts), HELD_TEXTS):
        codes = [known.of(words_of(t.as_py())) for t in texts.slice(first, HELD_TEXTS)]
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        text, start, _, hashes = _stretches(np.concatenate(codes), sizes, window, anchor)
        found.append((text + first, start, hashes))
    return tuple(np.concatenate(c) for c in zip(*found))


def _keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, str, str]:
    """``docs`` with the id that orders them, and a part that tells texts of one id apart."""
    id_name, part_name = fresh(docs, "id"), fresh(docs, "part")
    least = F.lit(-(1 << 63)).cast("bigint")
    ided = docs.withColumn(id_name, F.coalesce(F.col(id_col).cast("bigint"), least))
    repeated = ided.groupBy(id_name).count().where("count > 1").limit(1).count()
    part = F.xxhash64(F.coalesce("text", F.lit(""))) if repeated else F.lit(0).cast("bigint")
    return ided.withColumn(part_name, part), id_name, part_name


def _anchors(keyed: DataFrame, id_name: str, part_name: str, window: int, anchor: int) -> DataFrame:
    """Each anchor of each batch, with the texts and words where its stretches start."""

    def run(batches: Batches) -> Batches:
        known = WordHashes()
        for batch in batches:
            text, start, hashes = _batch_stretches(batch.column(2), known, window, anchor)
            if not len(hashes):
                continue
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            bounds, text = pa.array(np.append(first, len(hashes)), pa.int32()), pa.array(text[order])
            lists = [batch.column(0).take(text), batch.column(1).take(text), pa.array(start[order], pa.int32())]
            columns = [pa.array(hashes[first].view(np.int64)), *(pa.ListArray.from_arrays(bounds, c) for c in lists)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "ids", "parts", "starts"])

    return keyed.select(id_name, part_name, "text").mapInArrow(run, PLACES)


def _cut_stretches(joined: DataFrame, id_name: str, part_name: str, hits_name: str, window: int, anchor: int, n_shards: int) -> DataFrame:
    """The stretches of repeated anchors, without words where the batch has equal ones earlier."""
    at = {name: joined.columns.index(name) for name in (id_name, part_name, "text", hits_name)}

    def run(batches: Batches) -> Batches:
        known = WordHashes()
        for batch in batches:
            least: dict[bytes, tuple] = {}
            rows: list[tuple] = []

            def add(key: int | None, place: tuple, size: int, stretch: bytes) -> None:
                if key is None:
                    key = xxhash.xxh64_intdigest(stretch, 1)
                new = (key, *place, size, stretch)
                old = least.get(stretch)
                if old is None:
                    least[stretch] = new
                elif old[1:4] != place:
                    late = max(old, new, key=lambda r: r[1:4])
                    # Equal words start earlier elsewhere in the batch: all of these go.
                    rows.append((*late[:5], b""))
                    if late is old:
                        least[stretch] = new

            # Words are held for a few texts at a time, stretches for the batch.
            for first in range(0, batch.num_rows, HELD_TEXTS):
                few = batch.slice(first, HELD_TEXTS)
                ids, names = (few.column(at[c]).to_pylist() for c in (id_name, part_name))
                hits = [{h >> 1: h & 1 for h in hs} for hs in few.column(at[hits_name]).to_pylist()]
                words = [words_of(t.as_py()) for t in few.column(at["text"])]
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                text, start, n, hashes = _stretches(np.concatenate([known.of(w) for w in words]), sizes, window, anchor)
                for t, s, size, h in zip(text.tolist(), start.tolist(), n.tolist(), hashes.tolist()):
                    often = hits[t].get(s)
                    if often is None:
                        continue
                    if not often:
                        add(h, (ids[t], names[t], s), size, b" ".join(words[t][s : s + size + window - 1]))
                    else:
                        for k in range(s, s + size):
                            add(None, (ids[t], names[t], k), 1, b" ".join(words[t][k : k + window]))
            rows.extend(least.values())
            if rows:
                yield _bundled(rows, n_shards)
        give_back()

    return joined.mapInArrow(run, BUNDLES)


def _bundled(rows: list[tuple], n_shards: int) -> pa.RecordBatch:
    """(key, id, part, start, n, words) rows, gathered by shard."""
    key, ids, names, starts, ns = (np.array(c, k) for c, k in zip(zip(*(r[:5] for r in rows)), (np.uint64, *[np.int64] * 4)))
    shard = (key % np.uint64(n_shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    packer = zstandard.ZstdCompressor(level=1)
    groups = np.split(order, cuts)
    return pa.RecordBatch.from_pydict(
        {
            "shard": pa.array([int(shard[g[0]]) for g in groups], pa.int64()),
            "ids": [ids[g].astype("<i8").tobytes() for g in groups],
            "parts": [names[g].astype("<i8").tobytes() for g in groups],
            "starts": [starts[g].astype("<i4").tobytes() for g in groups],
            "ns": [ns[g].astype("<i4").tobytes() for g in groups],
            "words": [packer.compress(b"\n".join([rows[i][5] for i in g.tolist()])) for g in groups],
        }
    )


def _unbundled(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], int, bytes]]:
    """(place, n, words) of each stretch; empty words stand for words that an earlier place has."""
    unpack = zstandard.ZstdDecompressor().decompress
    for row in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
        columns = [np.frombuffer(c, k).tolist() for c, k in zip(row, ("<i8", "<i8", "<i4", "<i4"))]
        for i, part, start, n, words in zip(*columns, unpack(row[4]).split(b"\n")):
            yield (i, part, start), n, words


def _shard_spans(stretches: list[tuple[tuple, bytes]], window: int) -> list[tuple]:
    """Spans of words to remove in distinct stretches (place, words), by the shard's index."""
    stretches.sort(key=lambda s: s[0])
    split = [words.split(b" ") for _, words in stretches]
    numbers: dict[bytes, int] = {}
    text: list[int] = []
    for words in split:
        text.extend(numbers.setdefault(w, len(numbers) + 1) for w in words)
        text.append(0)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    stretch, offset, first = FMIndex(np.array(text, np.int64), window).matches(starts, sizes)
    late = first < starts[stretch] + offset
    stretch, offset = stretch[late], offset[late]
    order = np.lexsort((offset, stretch))
    stretch, offset = stretch[order], offset[order]
    # Windows that overlap or touch make one span.
    cut = np.flatnonzero(np.concatenate([[True], (stretch[1:] != stretch[:-1]) | (offset[1:] > offset[:-1] + window)])) if len(stretch) else []
    spans = []
    for a, b in zip(cut, [*cut[1:], len(stretch)]):
        (i, part, start), _ = stretches[stretch[a]]
        spans.append((i, part, start + int(offset[a]), start + int(offset[b - 1]) + window))
    return spans


def _spans(dealt: DataFrame, window: int) -> DataFrame:
    def run(batches: Batches) -> Batches:
        least: dict[bytes, tuple] = {}
        spans: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = zip(*spans)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            made = [pa.array(c, k) for c, k in zip(columns, kinds)]
            spans.clear()
            return pa.RecordBatch.from_arrays(made, names=[c.split()[0] for c in SPANS.split(", ")])

        for batch in batches:
            for place, n, words in _unbundled(batch):
                old = least.setdefault(words, place) if words else None
                if old is None or old != place:
                    late = place if old is None else max(old, place)
                    spans.append((late[0], late[1], late[2], late[2] + n + window - 1))
                    if late is old:
                        least[words] = place
            if spans:
                yield flushed()
        if least:
            spans.extend(_shard_spans([(place, words) for words, place in least.items()], window))
        if spans:
            yield flushed()
        least.clear()
        give_back()

    return dealt.mapInArrow(run, SPANS)


def _without(words: list[bytes], spans: list[dict]) -> list[bytes]:
    """The words that no span covers."""
    kept, at = [], 0
    for span in sorted(spans, key=lambda s: s["first"]):
        kept += words[at : max(at, span["first"])]
        at = max(at, span["last"])
    return kept + words[at:]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR,
    frequent: int = FREQUENT, shard_stretches: int = SHARD_STRETCHES, words_col: str = "n_words", removed_col: str = "n_removed",
    *, digest_col: str | None = None,
) -> DataFrame:
    """``docs`` without repeated words in ``text``, and how many words it had and lost.

    A word goes if a window of ``window`` words that covers it also starts earlier: in a text
    of a lesser id, or earlier in the same text. Windows are those of the input. What is left
    is joined by single spaces; texts that lose nothing stay as they are, null stays null.
    A null id counts as the least. Rows that repeat an id and text are one text, none
    earlier than the other; texts that share an id are ordered by a hash. An empty table gives
    no rows. Columns named like the two counts are replaced. With ``digest_col`` the text is
    left out for the SHA-256 of what is kept, its words joined by single spaces.
    """
    made = [words_col, removed_col] + ([digest_col] if digest_col else [])
    docs = docs.drop(*(c for c in docs.columns if c.lower() in {m.lower() for m in made}))
    keyed, id_name, part_name = _keyed(docs, id_col)
    anchors = stored(_anchors(keyed, id_name, part_name, window, anchor))
    counts = anchors.groupBy("anchor").agg(F.sum(F.size("starts")).alias("n")).where("n > 1")
    often = (F.col("n") > frequent).cast("int")
    # ``docs`` may have columns of any name.
    its_id, its_part, hits_name, spans_name = (fresh(docs, c) for c in ("its_id", "its_part", "hits", "spans"))
    hits = (
        anchors.join(counts, "anchor")
        .select(F.explode(F.arrays_zip("ids", "parts", "starts")).alias("p"), often.alias("often"))
        .groupBy("p.ids", "p.parts")
        .agg(F.collect_list(F.col("p.starts") * 2 + F.col("often")).alias("hits"))
        .toDF(its_id, its_part, hits_name)
    )
    key = (F.col(id_name) == F.col(its_id)) & (F.col(part_name) == F.col(its_part))
    n_shards = parts(anchors.count(), shard_stretches)
    # One shuffle of the texts by id serves this join and the last.
    cut = _cut_stretches(keyed.join(hits, key), id_name, part_name, hits_name, window, anchor, n_shards)
    spans = _spans(cut.repartitionById(n_shards, F.col("shard").cast("int")), window)
    listed = spans.groupBy("id", "part").agg(F.collect_list(F.struct("first", "last")).alias("spans")).toDF(its_id, its_part, spans_name)
    joined = keyed.join(listed, key, "left")
    names = docs.columns
    at, text_at = joined.columns.index(spans_name), names.index("text")

    others = [i for i in range(len(names)) if digest_col is None or i != text_at]

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, had, lost = [], [], []
        for text, spans in zip(batch.column(text_at).to_pylist(), batch.column(at).to_pylist()):
            words = words_of(text)
            kept = _without(words, spans) if spans else words
            if digest_col is not None:
                texts.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            else:
                texts.append(b" ".join(kept).decode("utf-8", "surrogatepass") if len(kept) < len(words) else text)
            had.append(len(words))
            lost.append(len(words) - len(kept))
        columns = [pa.array(texts, pa.string()) if i == text_at else batch.column(i) for i in others]
        counts = [pa.array(had, pa.int64()), pa.array(lost, pa.int64())]
        if digest_col is not None:
            counts.append(pa.array(texts, pa.string()))
        return pa.RecordBatch.from_arrays([*columns, *counts], names=[*(names[i] for i in others), *made])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for i, f in enumerate(docs.schema) if i in others)
    digest = f", `{digest_col}` string" if digest_col else ""
    return joined.mapInArrow(each_batch(keep), f"{kinds}`{words_col}` bigint, `{removed_col}` bigint{digest}")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated words, and without texts that lost all theirs; n_chars, if any, as it is now."""
    words, removed = fresh(docs, "words"), fresh(docs, "removed")
    cut = remove_repeats(docs, words_col=words, removed_col=removed)
    left = cut.where((F.col(removed) == 0) | (F.col(removed) < F.col(words)))
    now = F.when(F.col(removed) > 0, F.char_length("text").cast("bigint"))
    return left.select(*(F.coalesce(now, c).alias(c) if c == "n_chars" else c for c in docs.columns))


def removed_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the kept words, joined by one space, for each row."""
    return remove_repeats(docs.select("doc_id", "text"), digest_col="kept_sha256")
