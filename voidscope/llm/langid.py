"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts is, for every n, the cosine of their sets of byte n-grams,
summed over n = 1..4 with weights. Nystroem landmarks are texts of the training rows; one-versus-rest kernel
ridge regression is solved on the landmark columns. As the kernel is a scalar product of (hashed) presence
vectors, ``(X M') A`` is computed as ``X (M' A)``: texts are scored by one matrix product per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voidscope.llm.common import bounded_sample, slices, texts

#: (n, slots of the hashed n-gram set, weight in the blend)
SPECTRUM = ((1, 256, 0.5), (2, 1 << 13, 1.0), (3, 1 << 15, 1.0), (4, 1 << 15, 1.0))
SLOTS = sum(size for _, size, _ in SPECTRUM)
PER_LANGUAGE = 500  # bound of the training sample, rows for each language
LANDMARKS = 60  # of them, for each language
RIDGE = 1e-2
UNKNOWN = "und"
BATCH = 32
_PIECE = 1 << 20
_LETTER = regex.compile(r"\p{L}")  # numerals such as a half or a small two are no letters
#: Every ASCII byte that is no letter becomes a space.
_FOLDED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def presence(text: str) -> list[np.ndarray]:
    """For each n the slots of the n-grams in the whole text, ascending."""
    raw = text.lower().encode("utf-8", "replace").translate(_FOLDED)
    out = []
    for n, size, _ in SPECTRUM:
        seen = np.zeros(size, bool)
        for start in range(0, max(len(raw) - n + 1, 0), _PIECE):
            a = np.frombuffer(raw[start:start + _PIECE + n - 1], np.uint8).astype(np.uint32)
            code = a[: len(a) - n + 1].copy()
            for j in range(1, n):
                code = (code << np.uint32(8)) | a[j: len(a) - n + 1 + j]
            if size > 256:
                code = (code * np.uint32(2654435769)) >> np.uint32(33 - size.bit_length())
            seen[code] = True
        out.append(np.flatnonzero(seen))
    return out


def matrix(rows: list[list[np.ndarray]]) -> np.ndarray:
    """Presence sets as scaled vectors: scalar products are the blended kernel."""
    x = np.zeros((len(rows), SLOTS), np.float32)
    for row, sets in zip(x, rows):
        start = 0
        for (_, size, weight), seen in zip(SPECTRUM, sets):
            if len(seen):
                row[start + seen] = np.sqrt(weight / len(seen))
            start += size
    return x


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # SLOTS x languages

    def scores(self, rows: list[list[np.ndarray]]) -> np.ndarray:
        return matrix(rows) @ self.weights


def fit(sets: list[list[np.ndarray]], names: list[str]) -> LanguageModel:
    """Kernel ridge regression on Nystroem landmarks, the first ``LANDMARKS`` rows of each language."""
    languages = sorted(set(names))
    if not languages:
        return LanguageModel([], np.zeros((SLOTS, 0), np.float32))
    taken: dict[str, int] = {}
    chosen = []
    for i, name in enumerate(names):
        taken[name] = taken.get(name, 0) + 1
        if taken[name] <= LANDMARKS:
            chosen.append(i)
    marks = matrix([sets[i] for i in chosen])
    target = np.where(np.array(names)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    gram = np.zeros((len(chosen), len(chosen)))
    moment = np.zeros((len(chosen), len(languages)))
    for start in range(0, len(sets), BATCH):
        k = (matrix(sets[start:start + BATCH]) @ marks.T).astype(np.float64)
        gram += k.T @ k
        moment += k.T @ target[start:start + BATCH]
    inner = (marks @ marks.T).astype(np.float64)
    scale = np.trace(gram) / max(np.trace(inner), 1e-12)
    solved = np.linalg.lstsq(gram + RIDGE * scale * inner, moment, rcond=1e-10)[0]
    return LanguageModel(languages, (marks.T @ solved).astype(np.float32))


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Model from ``doc_id, text, lang``: at most ``per_language`` whole texts of every language."""
    ids = bounded_sample(
        labelled.filter("lang is not null and doc_id is not null").select("doc_id", "lang"), "lang", "doc_id", per_language)
    rows = labelled.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id")  # bounded by the parameter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [presence(t) for t in texts(part.column("text"))]
                packed = [pa.array([s[n].astype(np.uint16).tobytes() for s in sets], pa.binary()) for n in range(len(SPECTRUM))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), *packed],
                    ["doc_id", "lang", *[f"n{n}" for n, _, _ in SPECTRUM]])

    schema = "doc_id long, lang string, " + ", ".join(f"n{n} binary" for n, _, _ in SPECTRUM)
    found = rows.select("doc_id", "lang", "text").mapInArrow(run, schema).collect()
    found.sort(key=lambda r: (r["lang"], r["doc_id"]))
    sets = [[np.frombuffer(bytes(r[f"n{n}"]), np.uint16).astype(np.int64) for n, _, _ in SPECTRUM] for r in found]
    return fit(sets, [r["lang"] for r in found])


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs(doc_id, text)``, over whole texts.

    ``und`` with score 0 where the text is NULL, has no letter, or no language was learned. The score is the
    winning regression output mapped from -1..1 to 0..1; of equal outputs the first language by name wins.
    Repeated rows give repeated results; further columns of the input are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                names, scores = [], []
                rows = texts(part.column("text"))
                for start in range(0, len(rows), BATCH):
                    some = rows[start:start + BATCH]
                    if not model.languages:
                        names += [UNKNOWN] * len(some)
                        scores += [0.0] * len(some)
                        continue
                    out = model.scores([presence(t) for t in some])
                    for text, row in zip(some, out):
                        best = int(row.argmax())
                        known = _LETTER.search(text) is not None
                        names.append(model.languages[best] if known else UNKNOWN)
                        scores.append(float(np.clip((row[best] + 1) / 2, 0, 1)) if known else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
