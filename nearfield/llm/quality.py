"""Quality scores from how well dictionaries of good and of bad text compress a document.

One zstandard dictionary is trained on good and one on bad labelled texts, both from a
bounded sample. A document's compressed sizes with either give the normalised size
difference; a logistic curve, fitted on labelled texts that trained no dictionary, turns
it into a score, corrected for the document's length and how far it compresses anyway.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import Batches, each_batch, held_out
from nearfield.llm.samples import labelled_sample

DICTIONARY_BYTES = 64_000
LEVEL = 3
RIDGE = 0.01
THRESHOLD = 0.7


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()


class Sizes:
    """Compressed sizes of texts under a model's dictionaries."""

    def __init__(self, model: CompressionModel) -> None:
        packers = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None)
                   for d in (model.good, model.bad)]
        self.packers = [*packers, zstandard.ZstdCompressor(level=LEVEL)]

    def features(self, text: bytes) -> list[float]:
        good, bad, plain = (len(p.compress(text)) for p in self.packers)
        n = len(text) + 16
        return [(bad - good) / max(good, bad), (bad - good) / n, good / n, plain / n, float(np.log(n))]


def _dictionary(texts: list[bytes], octets: int) -> bytes:
    """A trained dictionary; texts too few or too short to train on serve as one themselves."""
    texts = [t for t in texts if t]
    try:
        return zstandard.train_dictionary(octets, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[:octets]


def _logistic(x: np.ndarray, y: np.ndarray, weigh: np.ndarray, ridge: float = RIDGE, rounds: int = 60) -> np.ndarray:
    """Weights of a weighted logistic regression by damped Newton steps; the last is the intercept."""
    a = np.c_[x, np.ones(len(x))]
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    w = np.zeros(a.shape[1])
    loss = lambda v: np.logaddexp(0, np.where(y == 1, -1, 1) * (a @ v)) @ weigh + (penalty * v * v).sum() / 2
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (weigh * p * (1 - p))[:, None]) + np.diag(penalty), a.T @ (weigh * (p - y)) + penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w, before, now = w - size * step, now, loss(w - size * step)
        if before - now < 1e-9:
            break
    return w


def fit(sample: list[tuple[int, bytes, int]], counts: dict[int, int]) -> CompressionModel:
    """A model from (doc_id, text, label): every second text of a label trains, the others calibrate.

    Texts weigh so that the labels keep their true shares, ``counts``.
    """
    kinds = {y: [t for _, t, label in sample if label == y] for y in (0, 1)}
    if min(map(len, kinds.values())) < 2:
        return CompressionModel(b"", b"")
    model = CompressionModel(_dictionary(kinds[1][::2], DICTIONARY_BYTES), _dictionary(kinds[0][::2], DICTIONARY_BYTES))
    sizes = Sizes(model)
    x = np.array([sizes.features(t) for y in (0, 1) for t in kinds[y][1::2]])
    y = np.repeat([0.0, 1.0], [len(kinds[0][1::2]), len(kinds[1][1::2])])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    share = counts[1] / (counts[0] + counts[1])
    weigh = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum())) * len(y)
    weights = _logistic((x - mean) / scale, y, weigh)
    return CompressionModel(model.good, model.bad, *(tuple(map(float, v)) for v in (mean, scale, weights)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> CompressionModel:
    return fit(*labelled_sample(docs, labels, label_col))


def score_texts(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, one row for each row of ``docs``; null texts score as empty ones.

    A model that saw fewer than two texts of either label scores every text 0.5.
    """
    mean, scale = np.array(model.mean), np.array(model.scale)
    weights = np.array(model.weights)

    def run(batches: Batches) -> Batches:
        sizes = Sizes(model) if len(weights) else None
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if sizes and batch.num_rows:
                x = np.array([sizes.features((t.as_py() or "").encode()) for t in batch.column(1)])
                z = ((x - mean) / scale) @ weights[:-1] + weights[-1]
                scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text).

    Rows without an id are scored and count as held out; repeated rows stay and score alike;
    other columns are never read. An empty table gives no rows.
    """
    model = train(docs, labels)
    return score_texts(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: CompressionModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores the threshold or more, all columns kept.

    A model that saw fewer than two texts of either label knows nothing against any row: all stay.
    """
    mean, scale, weights = np.array(model.mean), np.array(model.scale), np.array(model.weights)
    at = docs.columns.index("text")

    def run(batches: Batches) -> Batches:
        sizes = Sizes(model) if len(weights) else None

        def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not sizes:
                return batch
            x = np.array([sizes.features((t.as_py() or "").encode()) for t in batch.column(at)])
            z = ((x - mean) / scale) @ weights[:-1] + weights[-1]
            return batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) >= threshold))

        return each_batch(keep)(batches)

    return docs.mapInArrow(run, docs.schema)
