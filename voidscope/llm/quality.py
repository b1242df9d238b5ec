"""Text quality with a factorisation machine.

Inputs are hashed words, structure statistics and metadata (the recorded length). Pairwise interactions have
low rank; their sum is computed in linear time as ``(sum v x)^2 - sum (v x)^2`` for each factor.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voidscope.llm.common import bounded_sample, row_sums, slices, texts

WORD_SLOTS = 1 << 15
FACTORS = 8
PER_CLASS = 3000  # bound of the training sample, rows for each label
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.05, 1e-5
_CACHED = 300_000

_CLASSES = [
    lambda c: "A" <= c <= "Z", lambda c: "a" <= c <= "z", lambda c: "0" <= c <= "9", lambda c: ord(c) >= 128,
    lambda c: c in " \t", lambda c: c == "\n", lambda c: c in ".,;:?",
    *[(lambda c, mark=mark: c == mark) for mark in "!#$%&*|<>/=_"],
]
_CLASS_OF = np.array([[f(chr(b)) for f in _CLASSES] for b in range(256)], float)
STATISTICS = len(_CLASSES) + 8
METADATA = 2
INPUTS = WORD_SLOTS + STATISTICS + METADATA

_slots: dict[str, int] = {}


def _slot(word: str) -> int:
    if len(_slots) > _CACHED:
        _slots.clear()
    slot = _slots[word] = zlib.crc32(word.encode("utf-8", "replace")) % WORD_SLOTS
    return slot


def describe(text: str, n_chars: int | None) -> tuple[list[int], np.ndarray]:
    """Slots of the distinct words, and the statistics with the metadata (all zero for an empty text)."""
    words = text.lower().split()
    counts = Counter(words)
    slots = sorted({_slots[w] if w in _slots else _slot(w) for w in counts})
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    lines = text.split("\n")
    n = max(len(words), 1)
    shares = np.bincount(raw, minlength=256) @ _CLASS_OF / max(len(raw), 1)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    shape = [
        np.log1p(len(words)), len(raw) / n / 10, len(counts) / n, max(counts.values(), default=0) / n, repeats / n,
        np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)),
    ]
    known = n_chars is not None and n_chars >= 0
    return slots, np.array([*shares, *shape, np.log1p(n_chars) if known else 0.0, float(not known)])


@dataclass
class FactorisationMachine:
    """``bias + w x + interactions`` over word slots (value 1/sqrt(words)) and standardised statistics."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    center: np.ndarray
    scale: np.ndarray

    def rows(self, found: list[tuple[list[int], np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows: input numbers, values, inputs per row."""
        dense = np.arange(WORD_SLOTS, INPUTS)
        numbers, values, sizes = [], [], []
        for slots, statistics in found:
            numbers += [np.array(slots, np.int64), dense]
            values += [np.full(len(slots), 1 / np.sqrt(max(len(slots), 1))),
                       np.clip((statistics - self.center) / self.scale, -5, 5) / np.sqrt(len(dense))]
            sizes.append(len(slots) + len(dense))
        return np.concatenate(numbers), np.concatenate(values), np.array(sizes)

    def margins(self, numbers: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        linear = row_sums(self.weights[numbers] * values, sizes)
        terms = self.factors[numbers] * values[:, None]
        sums, squares = row_sums(terms, sizes), row_sums(terms * terms, sizes)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1)

    def scores(self, found: list[tuple[list[int], np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*self.rows(found)), -30, 30)))


def fit(found: list[tuple[list[int], np.ndarray]], labels: np.ndarray, prior: float | None = None) -> FactorisationMachine:
    """Adaptive gradient descent on the logistic loss; ``prior`` is the share of label 1 before sampling."""
    random = np.random.default_rng(11)
    model = FactorisationMachine(
        0.0, np.zeros(INPUTS), random.normal(0, 0.02, (INPUTS, FACTORS)),
        np.zeros(STATISTICS + METADATA), np.ones(STATISTICS + METADATA))
    if not found:
        model.factors[:] = 0
        return model
    dense = np.stack([s for _, s in found])
    model.center, model.scale = dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3)
    numbers, values, sizes = model.rows(found)
    starts = np.cumsum(sizes) - sizes
    mass_w, mass_v, mass_b = np.full(INPUTS, 1e-4), np.full((INPUTS, FACTORS), 1e-4), 1e-4
    for _ in range(EPOCHS):
        order = random.permutation(len(found))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            size = sizes[rows]
            take = np.repeat(starts[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            i, x = numbers[take], values[take]
            terms = model.factors[i] * x[:, None]
            sums = row_sums(terms, size)
            margin = model.bias + row_sums(model.weights[i] * x, size) + 0.5 * (sums ** 2 - row_sums(terms ** 2, size)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / len(rows)
            each = np.repeat(error, size)
            grad = np.bincount(i, each * x, INPUTS) + DECAY * model.weights
            mass_w += grad * grad
            model.weights -= RATE * grad / np.sqrt(mass_w)
            pull = each[:, None] * x[:, None] * (np.repeat(sums, size, axis=0) - terms)
            grad_v = np.stack([np.bincount(i, pull[:, f], INPUTS) for f in range(FACTORS)], axis=1) + DECAY * model.factors
            mass_v += grad_v * grad_v
            model.factors -= RATE * grad_v / np.sqrt(mass_v)
            mass_b += error.sum() ** 2
            model.bias -= RATE * error.sum() / np.sqrt(mass_b)
    share = labels.mean()
    if prior and 0 < prior < 1 and 0 < share < 1:
        model.bias += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return model


_COLUMNS = "doc_id", "text", "n_chars"


def _inputs(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), n_chars.alias("n_chars"))


def _described(part: pa.RecordBatch) -> list[tuple[list[int], np.ndarray]]:
    return [describe(t, n) for t, n in zip(texts(part.column("text")), part.column("n_chars").to_pylist())]


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> FactorisationMachine:
    """Model from ``docs(doc_id, text, n_chars)`` and ``labels(doc_id, label)``; at most ``per_class`` labelled
    rows of each class are used, whole texts. Labels other than 0 and 1 are left out."""
    labels = labels.filter("label in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    chosen = bounded_sample(labels, "label", "doc_id", per_class)
    rows = _inputs(docs).join(F.broadcast(chosen), "doc_id")  # bounded by the parameter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = _described(part)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("label"),
                    pa.array([np.array(s, np.uint16).tobytes() for s, _ in found], pa.binary()),
                    pa.array([x.tobytes() for _, x in found], pa.binary()),
                ], ["doc_id", "label", "slots", "statistics"])

    got = rows.select(*_COLUMNS, "label").mapInArrow(run, "doc_id long, label int, slots binary, statistics binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"]))
    found = [(np.frombuffer(bytes(r["slots"]), np.uint16).tolist(), np.frombuffer(bytes(r["statistics"]))) for r in got]
    prior = counts.get(1, 0) / max(sum(counts.values()), 1)
    return fit(found, np.array([r["label"] for r in got], float), prior)


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs(doc_id, text[, n_chars])``, over whole texts.

    A NULL text counts as an empty one and is scored by its (zero) statistics; an unknown ``n_chars`` has an
    input of its own. Without training rows every score is 0.5. Repeated rows give repeated results; further
    columns of the input are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                scores = shared.value.scores(_described(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                    ["doc_id", "score", "predicted"])

    return _inputs(docs).mapInArrow(run, "doc_id long, score double, predicted int")
