"""Toxicity scores by a factorization machine over hashed terms.

Terms are a document's lower-cased words and their first three to five letters, present or
not. A bounded labelled sample picks the slots that tell the labels apart most (chi
squared) and fits one weight and a few factors for each: the product of two terms' factors
is the weight of their meeting, such as an insult beside the mention of a group.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import WORD_CACHE, Batches, held_out
from nearfield.llm.samples import labelled_sample

SLOTS = 1 << 20
CHOSEN = 1_024
# A slot counts if so many texts have it, and its chi squared is so large a share of them all.
LEAST_TEXTS, LEAST_CHI = 4, 0.01
RANK = 4
ROUNDS = 250
RATE = 0.05
DECAY = 0.002
# Share of a text's terms hidden in each training round, so that no term relies on others.
HIDDEN = 0.6
THRESHOLD = 0.3
PREFIXES = (3, 4, 5)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class FactorizationMachine:
    """Slots that count, and for each a weight and a row of factors."""

    slots: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def score(self, at: list[int]) -> float:
        """Probability of label 1 for a text with these distinct positions of ``slots``."""
        v = self.factors[at]
        meetings = ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum() / 2
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at].sum() + meetings, -30, 30))))


class Terms(dict):
    """token -> slots of its terms, or positions in the chosen slots; remembered while a task runs."""

    def __init__(self, chosen: np.ndarray | None = None) -> None:
        self.place = None if chosen is None else {int(s): i for i, s in enumerate(chosen)}
        self.starts: dict[str, tuple[int, ...]] = {}

    def _kept(self, term: str) -> tuple[int, ...]:
        slot = xxhash.xxh64_intdigest(term, 7) % SLOTS
        if self.place is None:
            return (slot,)
        return (self.place[slot],) if slot in self.place else ()

    def _start(self, start: str) -> tuple[int, ...]:
        """What the first letters of a word have."""
        if start not in self.starts:
            if len(self.starts) >= WORD_CACHE:
                self.starts.clear()
            self.starts[start] = tuple(s for n in PREFIXES if len(start) >= n for s in self._kept("p" + start[:n]))
        return self.starts[start]

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= WORD_CACHE:
            self.clear()
        words = _WORD.findall(token.lower())
        found = {s for w in words for s in (*self._kept("w" + w), *self._start(w[: PREFIXES[-1]]))}
        kept = self[token] = tuple(found)
        return kept

    def of(self, text: str | None) -> list[int]:
        """What the tokens of a text have, distinct and sorted."""
        return sorted({s for token in set((text or "").split()) for s in self[token]})


def _telling(rows: list[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
    """The slots with the largest chi squared, at most ``most``, in at least LEAST_TEXTS texts."""
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    label = np.repeat(y, [len(r) for r in rows])
    slots, at = np.unique(flat, return_inverse=True)
    n, pos = np.bincount(at, minlength=len(slots)), np.bincount(at, weights=label, minlength=len(slots))
    total, share = len(y), y.mean()
    expected = n * share
    chi = (pos - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - n / (total + 1)), 1e-9)
    chi[n < LEAST_TEXTS] = 0
    order = np.lexsort((slots, -chi))[:most]
    return np.sort(slots[order[chi[order] > LEAST_CHI * len(y)]])


def fit(sample: list[tuple[int, bytes, int]], counts: dict[int, int], seed: int = 11) -> FactorizationMachine:
    """A machine from (doc_id, text, label); rows weigh so that the labels keep their true shares."""
    y = np.array([label for *_, label in sample], np.float32)
    total = counts[0] + counts[1]
    terms = Terms()
    rows = [np.array(terms.of(text.decode("utf-8", "replace")), np.int64) for _, text, _ in sample]
    one_label = not len(y) or y.min() == y.max()
    slots = np.empty(0, np.int64) if one_label else _telling(rows, y, CHOSEN)
    if not len(slots):
        # One label alone, or no term that tells them apart.
        share = (counts[1] + 1) / (total + 2)
        return FactorizationMachine(slots, np.empty(0), np.empty((0, RANK)), float(np.log(share / (1 - share))))
    x = np.zeros((len(rows), len(slots)), np.float32)
    for i, found in enumerate(rows):
        x[i, np.isin(slots, found, assume_unique=True)] = 1
    weigh = np.where(y == 1, counts[1] / total / y.sum(), counts[0] / total / (len(y) - y.sum())).astype(np.float32)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(slots), np.float32), rng.normal(0, 0.02, (len(slots), RANK)).astype(np.float32)
    b = np.array([np.log(counts[1] / counts[0])], np.float32)
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (w, v, b)]
    for t in range(1, ROUNDS + 1):
        seen = x * (rng.random(x.shape, np.float32) > HIDDEN)
        sums = seen @ v
        z = b[0] + seen @ w + ((sums**2).sum(axis=1) - seen @ (v**2).sum(axis=1)) / 2
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weigh
        slopes = (
            seen.T @ error + DECAY / len(slots) * w,
            seen.T @ (error[:, None] * sums) - v * (seen.T @ error)[:, None] + DECAY / len(slots) * v,
            np.array([error.sum()], np.float32),
        )
        for (p, m, s), g in zip(state, slopes):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return FactorizationMachine(slots, w.astype(float), v.astype(float), float(b[0]))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> FactorizationMachine:
    return fit(*labelled_sample(docs, labels, label_col))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text).

    Null texts score as empty ones. Rows without an id are scored and count as held out;
    repeated rows stay and score alike; other columns are never read. An empty table gives
    no rows. Without texts of both labels, or terms that tell them apart, every text scores the
    labels' mean.
    """
    machine = train(docs, labels)

    def run(batches: Batches) -> Batches:
        terms = Terms(machine.slots)
        for batch in batches:
            scores = [machine.score(terms.of(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id bigint, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
