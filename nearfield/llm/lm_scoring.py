"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

The probability of a token is that of its class after the tokens before it, times that of
the token in its class; the class is drawn in two steps, first a group of GROUP classes. The
most frequent words make up classes of MEMBERS words each, in order of frequency; every
other word, seen or not, belongs to the class of its ending. Each softmax adds up one row
of weights for each feature: the token before, the pair before (hashed), and the tokens two
and three places back (skips). Words of an ending's class have their add-one share of it,
so the probabilities of all words and of one unknown word for each ending add up to 1.

Training takes every document outside the held-out fold, once, in ROUNDS rounds: in each
one tasks run AdaGrad over their share of the round from the same weights, and what they
changed is averaged by Spark. Counts come from all training tokens.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import WORD_CACHE, Batches, held_out, parts, stored

# Words with a code of their own, words in one class of theirs, classes by ending, classes of a group.
TOP, MEMBERS, ENDINGS, GROUP = 1_024, 32, 32, 8
CLASSES = TOP // MEMBERS + ENDINGS
# Binary digits of the rows of weights: hashed pairs, features within a group, and within a class.
PAIR_BITS, GROUP_BITS, CLASS_BITS = 14, 16, 15
ROUNDS = 4
RATE = 0.5
# Tokens of a training step, and of a task's share of a round.
STEP_TOKENS, TASK_TOKENS = 16_384, 2_000_000
# Words whose counts every task holds; the counts of all others come through a join.
HELD_WORDS = 200_000
FOLDS, FOLD = 7, 2

# No word is a line break, so it can stand for the end of a text.
END = b"\n"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_CODED = "doc_id bigint, held_out boolean, codes binary, n_tokens bigint, n_known bigint, sure double, model double, words array<binary>, times array<int>"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, and the end."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    words.append(END)
    return words


def ending(word: bytes) -> int:
    """The class of a word outside the most frequent ones: by its last two bytes."""
    return zlib.crc32(word[-2:]) % ENDINGS


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), n: the training tokens; repeated rows count as often."""

    def run(batches: Batches) -> Batches:
        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return made

        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens_of(text.as_py()))
                if len(seen) >= WORD_CACHE:
                    yield flush()
        yield flush()

    learnt = docs.where(~held_out(F.col("doc_id").cast("string"), FOLDS, FOLD)).select("text")
    return learnt.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class _Places(dict):
    """Held words' places; -1 for all others."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass(frozen=True)
class Vocabulary:
    """Counts of the most frequent words in their order, and of what each ending's class holds."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    kinds: int
    ending_tokens: np.ndarray
    ending_kinds: np.ndarray

    @property
    def top(self) -> int:
        return min(TOP, len(self.words))

    @property
    def start(self) -> int:
        """The code before a text."""
        return TOP + ENDINGS


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From ``word_counts``: at most HELD_WORDS words come to the driver, the end first if it is one of them."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # Classes of counts, an eighth of a doubling wide, tell from which count on there are few enough words.
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("v")).collect()
    least, held = None, 0
    for r in sorted(levels, key=lambda r: -r.level):
        held += r.v
        if held > HELD_WORDS:
            break
        least = r.level
    chosen = counts.where(level >= least).collect() if least is not None else []
    rows = sorted(chosen, key=lambda r: (bytes(r.word) != END, -r.n, bytes(r.word)))
    words, n = [bytes(r.word) for r in rows], np.array([r.n for r in rows], np.int64)
    tail = F.crc32(F.substring("word", -2, 2)) % ENDINGS
    groups = counts.groupBy(tail.cast("int").alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    mass, kinds = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for r in groups:
        mass[r.c], kinds[r.c] = r.n, r.v
    # The most frequent words are no members of their endings' classes.
    for w, k in zip(words[:TOP], n[:TOP]):
        mass[ending(w)] -= k
        kinds[ending(w)] -= 1
    return Vocabulary(words, n, int(total.n), int(total.v), mass, kinds)


def coded(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """Each row as token codes, with the parts of its scores that need no weights.

    ``sure`` is the base score and ``model`` what tokens in an ending's class have in it, but
    for the counts of ``words``, to be joined.
    """
    shares = -np.log10(voc.ending_tokens + voc.ending_kinds + 1.0)
    whole = float(np.log10(voc.tokens + voc.kinds + 1.0))
    packed = (voc.words, voc.counts, voc.top, shares, voc.tokens + voc.kinds + 1)

    def run(batches: Batches) -> Batches:
        words, counts, top, share, total = packed
        ends = np.fromiter(map(ending, words), np.int64, len(words))
        # For each held word, and last for all others: code, base score, log of its share in its ending's class.
        code = np.append(np.where(np.arange(len(words)) < top, np.arange(len(words)), TOP + ends), 0).astype(np.uint16)
        base = np.append(np.log10((counts + 1) / total), -whole)
        inner = np.append(np.where(np.arange(len(words)) < top, 0, np.log10(counts + 1.0) + share[ends]), 0)
        places = _Places(zip(words, range(len(words))))
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                texts = [tokens_of(t.as_py()) for t in part.column(2)]
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                starts = np.cumsum(sizes) - sizes
                place = np.fromiter(chain.from_iterable(map(places.__getitem__, t) for t in texts), np.int64, int(sizes.sum()))
                codes, model = code[place], inner[place]
                late = np.flatnonzero(place < 0)
                bounds = np.searchsorted(late, np.append(starts, len(place)))
                rest = [Counter() for _ in texts]
                for i in np.flatnonzero(np.diff(bounds)).tolist():
                    at = late[bounds[i] : bounds[i + 1]]
                    missed = [texts[i][k] for k in (at - starts[i]).tolist()]
                    tail = np.fromiter(map(ending, missed), np.int64, len(missed))
                    codes[at], model[at] = TOP + tail, share[tail]
                    rest[i] = Counter(missed)
                packed_codes = [codes[a : a + n].tobytes() for a, n in zip(starts.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(packed_codes, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.array(sizes - np.diff(bounds), pa.int64()), pa.array(np.add.reduceat(base[place], starts)),
                     pa.array(np.add.reduceat(model, starts)), pa.array([list(r.keys()) for r in rest], pa.list_(pa.binary())),
                     pa.array([list(r.values()) for r in rest], pa.list_(pa.int32()))],
                    names=["doc_id", "held_out", "codes", "n_tokens", "n_known", "sure", "model", "words", "times"],
                )

    own = F.col("doc_id").cast("bigint")
    narrow = docs.select(own.alias("doc_id"), held_out(F.col("doc_id").cast("string"), FOLDS, FOLD).alias("held_out"), "text")
    return narrow.mapInArrow(run, _CODED).withColumn("row", F.monotonically_increasing_id())


class Weights:
    """Rows of the three softmaxes (group, class, word), biases, and how far each row was moved."""

    def __init__(self, voc: Vocabulary) -> None:
        rows = (3 * (TOP + ENDINGS + 1) + (1 << PAIR_BITS), 1 << GROUP_BITS, 1 << CLASS_BITS)
        self.tables = [np.zeros((n, wide), np.float32) for n, wide in zip(rows, (CLASSES // GROUP, GROUP, MEMBERS))]
        self.moved = [np.zeros(n, np.float32) for n in rows]
        counts = np.zeros(TOP)
        counts[: voc.top] = voc.counts[: voc.top]
        words = counts.reshape(-1, MEMBERS)
        classes = np.r_[words.sum(axis=1), voc.ending_tokens + 1.0].reshape(-1, GROUP)
        masses = (classes.sum(axis=1)[None, :], classes, words)
        real = (None, None, np.arange(TOP).reshape(-1, MEMBERS) < voc.top)
        self.biases = [_log_shares(m, r) for m, r in zip(masses, real)]

    def learnt(self) -> list[np.ndarray]:
        return [*self.tables, *self.moved]

    def copy(self) -> Weights:
        other = Weights.__new__(Weights)
        other.biases = self.biases
        other.tables, other.moved = [t.copy() for t in self.tables], [m.copy() for m in self.moved]
        return other


def _log_shares(mass: np.ndarray, real: np.ndarray | None) -> np.ndarray:
    """Logarithms of counts by row; what cannot occur has none, but where a whole row cannot."""
    real = mass > 0 if real is None else real
    with np.errstate(divide="ignore"):
        logs = np.where(real, np.log(np.maximum(mass, 1e-9)), -np.inf)
    logs[~real.any(axis=1)] = 0
    return logs.astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def histories(codes: np.ndarray, starts: np.ndarray, start: int) -> np.ndarray:
    """The codes one, two and three places before each token of texts put one after another."""
    before = np.full((3, len(codes)), start, np.int64)
    for k in range(3):
        before[k, k + 1 :] = codes[: max(0, len(codes) - k - 1)]
        # The first tokens of a text see none of the text before it.
        for i in range(k + 1):
            at = starts + i
            before[k, at[at < len(codes)]] = start
    return before


def features(before: np.ndarray) -> np.ndarray:
    """Rows of ``first`` for each token: the token before, skips of two and three, the pair before."""
    wide = TOP + ENDINGS + 1
    pair = ((before[0] * wide + before[1]).astype(np.uint64) * _SPREAD >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
    return np.stack([before[0], wide + before[1], 2 * wide + before[2], 3 * wide + pair])


@dataclass(frozen=True)
class Choice:
    """One step on the way to tokens: which tokens take it, its rows of weights, where from, what is chosen."""

    tokens: np.ndarray | slice
    rows: np.ndarray
    node: np.ndarray
    chosen: np.ndarray


def choices(rows: np.ndarray, codes: np.ndarray) -> list[Choice]:
    """The steps by which tokens with these features are reached: group, class, word."""
    klass = np.where(codes < TOP, codes // MEMBERS, codes - TOP + TOP // MEMBERS)
    group = klass // GROUP
    own = np.flatnonzero(codes < TOP)

    def hashed(features_at: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
        key = (features_at * CLASSES + node).astype(np.uint64)
        return (key * _SPREAD >> np.uint64(64 - bits)).astype(np.int64)

    return [
        Choice(slice(None), rows, np.zeros(len(codes), np.int64), group),
        Choice(slice(None), hashed(rows, group, GROUP_BITS), group, klass % GROUP),
        Choice(own, hashed(rows[:, own], klass[own], CLASS_BITS), klass[own], codes[own] % MEMBERS),
    ]


def _probabilities(table: np.ndarray, bias: np.ndarray, step: Choice) -> np.ndarray:
    z = table.take(step.rows[0], axis=0)
    for r in step.rows[1:]:
        z += table.take(r, axis=0)
    z += bias.take(step.node, axis=0)
    return _softmax(z)


def _move(table: np.ndarray, moved: np.ndarray, rows: np.ndarray, slopes: np.ndarray) -> None:
    """One AdaGrad step; a row's rate falls with the squares of its summed slopes."""
    # No table has more rows than 16 bits number, and those sort fastest.
    for r in rows.astype(np.uint16):
        order = np.argsort(r, kind="stable")
        placed = r[order]
        first = np.flatnonzero(np.r_[True, placed[1:] != placed[:-1]])
        which = placed[first]
        total = np.add.reduceat(slopes.take(order, axis=0), first, axis=0)
        moved[which] += np.einsum("ij,ij->i", total, total) / table.shape[1] ** 0.5
        total *= (-RATE / np.sqrt(1 + moved[which]))[:, None]
        total += table.take(which, axis=0)
        table[which] = total


def learn(w: Weights, codes: np.ndarray, starts: np.ndarray, start: int) -> None:
    """Steps over the texts that begin at ``starts``."""
    rows = features(histories(codes, starts, start))
    codes = codes.astype(np.int64)
    for at in range(0, len(codes), STEP_TOKENS):
        steps = choices(rows[:, at : at + STEP_TOKENS], codes[at : at + STEP_TOKENS])
        for table, moved, bias, step in zip(w.tables, w.moved, w.biases, steps):
            if len(step.chosen):
                p = _probabilities(table, bias, step)
                p[np.arange(len(p)), step.chosen] -= 1
                _move(table, moved, step.rows, p)


def log_scores(w: Weights, codes: np.ndarray, starts: np.ndarray, start: int) -> np.ndarray:
    """log10 of what the weights give each token: its class, and the word where it has a code of its own."""
    rows = features(histories(codes, starts, start))
    codes = codes.astype(np.int64)
    out = np.zeros(len(codes))
    for at in range(0, len(codes), STEP_TOKENS):
        part = out[at : at + STEP_TOKENS]
        for table, bias, step in zip(w.tables, w.biases, choices(rows[:, at : at + STEP_TOKENS], codes[at : at + STEP_TOKENS])):
            if len(step.chosen):
                p = _probabilities(table, bias, step)[np.arange(len(step.chosen)), step.chosen]
                part[step.tokens] += np.log10(np.maximum(p.astype(float), 1e-30))
    return out


def joined_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a batch one after another, and where each text starts; no text is empty."""
    texts = [np.frombuffer(c.as_py(), np.uint16) for c in column]
    sizes = np.array([len(t) for t in texts])
    return np.concatenate(texts), np.cumsum(sizes) - sizes


# Pieces of each table of weights on their way from the tasks.
_SLICES = 64


def train(docs: DataFrame, voc: Vocabulary) -> Weights:
    """Weights from ``coded`` rows (stored), held-out ones left out."""
    w = Weights(voc)
    spark = docs.sparkSession
    learnt = docs.where(~F.col("held_out")).select("codes", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)).alias("round"))
    sizes = {r["round"]: r.n for r in learnt.groupBy("round").agg(F.sum("n_tokens").alias("n")).collect()}
    start = voc.start
    for k in range(ROUNDS):
        if not sizes.get(k):
            continue
        shared = spark.sparkContext.broadcast(w)

        def run(batches: Batches) -> Batches:
            mine = shared.value.copy()
            seen = 0
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    codes, starts = joined_codes(batch.column(0).slice(at, 64))
                    learn(mine, codes, starts, start)
                    seen += len(codes)
            if seen:
                # What changed, in slices of rows, so that no row of the exchange is large.
                for part, (new, old) in enumerate(zip(mine.learnt(), shared.value.learnt())):
                    delta = new - old
                    for s, piece in enumerate(np.array_split(delta, _SLICES)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([part * _SLICES + s], pa.int32()), pa.array([float(seen)]), pa.array([(piece * seen).astype(np.float32).tobytes()], pa.binary())],
                            names=["slice", "weight", "bytes"],
                        )

        deltas = learnt.where(F.col("round") == k).select("codes").coalesce(parts(sizes[k], TASK_TOKENS)).mapInArrow(run, "slice int, weight double, bytes binary")
        merged = _merged(deltas)
        arrays = w.learnt()
        for r in merged.collect():
            part, s = divmod(r.slice, _SLICES)
            target = np.array_split(arrays[part], _SLICES)[s]
            target += np.frombuffer(r.bytes, np.float32).reshape(target.shape)
        shared.unpersist()
    return w


def _merged(deltas: DataFrame) -> DataFrame:
    """The mean of the tasks' changes for each slice: a task adds up a slice row by row."""

    def run(batches: Batches) -> Batches:
        sums: dict[int, list] = {}
        for batch in batches:
            for s, n, octets in zip(*(batch.column(i) for i in range(3))):
                piece = np.frombuffer(octets.as_py(), np.float32)
                if s.as_py() in sums:
                    sums[s.as_py()][0] += n.as_py()
                    sums[s.as_py()][1] += piece
                else:
                    sums[s.as_py()] = [n.as_py(), piece.astype(float)]
        for s, (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["slice", "bytes"])

    return deltas.repartition(_SLICES, "slice").mapInArrow(run, "slice int, bytes binary")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row (doc_id, text).

    Scores are log10 probabilities of the whole text with its end. Null texts are empty: the
    end alone. Rows without an id are scored and count as held out; repeated rows stay, score
    alike and count as often in training; other columns are never read. An empty table gives
    no rows; without training rows nothing is known and the base gives every token 1.
    """
    counts = stored(word_counts(docs))
    voc = vocabulary(counts)
    made = stored(coded(docs, voc))
    w = train(made, voc)
    shared = docs.sparkSession.sparkContext.broadcast(w)
    start = voc.start

    own = ["row", "doc_id", "held_out", "n_tokens", "n_known", "sure", "model"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.select(*own).schema)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                codes, starts = joined_codes(part.column(len(own)))
                sums = np.add.reduceat(log_scores(shared.value, codes, starts, start), starts)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sums)], names=[*own, "weighed"])

    weighed = made.select(*own, "codes").mapInArrow(run, f"{schema}, weighed double")
    late = made.select("row", F.arrays_zip("words", "times").alias("z")).select("row", F.explode("z").alias("z"))
    late = late.select("row", "z.words", "z.times").withColumnRenamed("words", "word")
    log = F.log10(F.col("n") + 1.0) * F.col("times")
    found = late.join(counts, "word").groupBy("row").agg(F.sum(log).alias("late"), F.sum("times").alias("late_known"))
    late_log = F.coalesce("late", F.lit(0.0))
    return weighed.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("late_known", F.lit(0))).alias("n_known"),
        F.lit(voc.tokens).cast("bigint").alias("train_tokens"),
        (F.col("sure") + late_log).alias("base_score"),
        (F.col("weighed") + F.col("model") + late_log).alias("score"),
    )
