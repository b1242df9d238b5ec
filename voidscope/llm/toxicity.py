"""Toxicity by weak supervision.

1. Voters: a fixed insult lexicon, lexicons mined from the labelled sample (words and word beginnings that
   mark toxic rows), and patterns (shouting, insults addressed to the reader).
2. Label model: a latent toxic/clean variable; each voter's firing rates given the class are its accuracy,
   started from the labelled rows and re-estimated by expectation maximisation over the whole sample.
   Correlations of voters within a class are estimated from the residuals; the evidence of a voter is divided
   by the number of voters it repeats, so a group of copies counts once.
3. A linear classifier over distinct words and word beginnings is trained on the posterior labels and scores
   whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voidscope.llm.common import bounded_sample, row_sums, slices, texts

# Common insults.
INSULTS = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "pathetic", "worthless", "trash",
    "scum", "clown", "disgusting", "garbage", "filthy", "vermin", "hate", "kill", "shut up", "ugly", "retard",
    "bastard", "asshole", "bitch", "fuck", "shit", "crap", "jerk", "fool", "nazi", "whore", "slut",
)
PATTERNS = {
    "you are": re.compile(r"\byou(?:'re| are) (?:an? )?(?:%s)\b" % "|".join(INSULTS), re.I),
    "screams": re.compile(r"\b[A-Z]{3,}(?:\s+[A-Z]{3,}){2,}\s*!"),
    "threat": re.compile(r"\b(?:i will|i'll|going to) (?:kill|hurt|destroy|find) you\b", re.I),
}
PREFIX = 4  # letters of a word beginning
PER_CLASS = 3000  # bound of the labelled sample, rows of each label
UNLABELLED = 3000  # bound of the further sample without labels
MINED = 150  # mined voters
SIGNIFICANT = 30.0  # log-likelihood ratio statistic that a mined voter and a feature of the classifier need
LIFT = 8.0  # and how much more frequent a mined voter must be in toxic rows
SMOOTH = 1.0
ROUNDS, EPOCHS, RATE, RIDGE = 25, 300, 0.3, 0.1
_WORD = re.compile(r"\w+")


def features(text: str) -> list[str]:
    """Distinct lower-case words, and their beginnings marked by ``*``."""
    words = set(_WORD.findall(text.lower()))
    return [*words, *{w[:PREFIX] + "*" for w in words if len(w) > PREFIX}]


@dataclass
class Sample:
    """Rows as sorted feature numbers, pattern votes, labels (NaN: none)."""

    names: list[str]
    rows: list[np.ndarray]
    patterns: np.ndarray
    labels: np.ndarray

    def columns(self, chosen: np.ndarray) -> np.ndarray:
        """Row x feature presence of some features."""
        place = np.full(len(self.names), -1)
        place[chosen] = np.arange(len(chosen))
        out = np.zeros((len(self.rows), len(chosen)), bool)
        for i, row in enumerate(self.rows):
            at = place[row]
            out[i, at[at >= 0]] = True
        return out


def association(on: np.ndarray, rows: np.ndarray, mass: float, total: float) -> np.ndarray:
    """Log-likelihood ratio statistic of each feature with the class, signed by direction.

    ``on``: weight of the class among the rows with the feature, ``rows``: their number, ``mass`` of ``total``
    is the weight of the class among all rows.
    """
    def part(observed, expected):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    share = mass / max(total, 1e-12)
    out, rest = total - rows, mass - on
    g = part(on, rows * share) + part(rows - on, rows * (1 - share)) + part(rest, out * share) + part(out - rest, out * (1 - share))
    return np.where(on >= rows * share, 2 * g, -2 * g)


def mine(sample: Sample) -> np.ndarray:
    """Feature numbers whose presence marks labelled toxic rows, strongest first."""
    known = np.flatnonzero(~np.isnan(sample.labels))
    if not len(known):
        return np.zeros(0, np.int64)
    toxic, rows = np.zeros(len(sample.names)), np.zeros(len(sample.names))
    for i in known:
        rows[sample.rows[i]] += 1
        toxic[sample.rows[i]] += sample.labels[i]
    n = float(len(known))
    mass = float(sample.labels[known].sum())
    strength = association(toxic, rows, mass, n)
    clean_rate = (rows - toxic + 0.5) / (n - mass + 1)
    good = np.flatnonzero((strength > SIGNIFICANT) & ((toxic + 0.5) / (mass + 1) > LIFT * clean_rate))
    return good[np.argsort(-strength[good], kind="stable")][:MINED]


def label_model(votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Posterior of the toxic class for every row of a row x voter matrix of votes."""
    n, m = votes.shape
    known = ~np.isnan(labels)
    fired = votes.astype(float)
    any_vote = votes.any(axis=1)
    posterior = np.where(known, np.nan_to_num(labels), np.where(any_vote, 0.9, 0.02))
    prior = float(np.clip(posterior[known].mean() if known.any() else posterior.mean(), 0.01, 0.5))
    for _ in range(ROUNDS):
        weight = np.stack([1 - posterior, posterior])
        mass = weight.sum(axis=1, keepdims=True)
        rates = (weight @ fired + SMOOTH * np.array([[0.01], [0.2]])) / (mass + SMOOTH)
        rates = np.clip(rates, 1e-4, 1 - 1e-4)
        # correlation within the classes: residuals after the class is known
        repeated = np.zeros(m)
        for c in (0, 1):
            residual = (fired - rates[c]) * np.sqrt(weight[c])[:, None]
            norm = np.sqrt((residual ** 2).sum(axis=0)) + 1e-9
            share = np.abs(residual.T @ residual) / np.outer(norm, norm)
            repeated += 0.5 * np.where(share > 0.2, share, 0).sum(axis=1)
        weight_of = 1 / np.maximum(repeated, 1.0)
        on = (np.log(rates[1]) - np.log(rates[0])) * weight_of
        off = (np.log1p(-rates[1]) - np.log1p(-rates[0])) * weight_of
        odds = fired @ (on - off) + off.sum() + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        new = np.where(known, 0.9 * np.nan_to_num(labels) + 0.1 * new, new)
        if np.abs(new - posterior).max() < 1e-6:
            break
        posterior = new
    return posterior


@dataclass
class ToxicityModel:
    bias: float = -3.0
    weights: dict[str, float] = field(default_factory=dict)

    def margin(self, text: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(text))


def fit(sample: Sample) -> ToxicityModel:
    """Voters, label model, and logistic regression on the posteriors."""
    if not len(sample.rows):
        return ToxicityModel()
    number = {name: i for i, name in enumerate(sample.names)}
    fixed = np.array([number[w] for w in INSULTS if w in number], int)
    voters = np.unique(np.concatenate([fixed, mine(sample)]))
    votes = np.concatenate([sample.columns(voters), sample.patterns.astype(bool)], axis=1)
    posterior = label_model(votes, sample.labels)
    # linear classifier: the features that go with the posterior, and all voters
    sizes = np.array([len(r) for r in sample.rows])
    flat = np.concatenate(sample.rows) if sizes.sum() else np.zeros(0, np.int64)
    seen = np.bincount(flat, minlength=len(sample.names)).astype(float)
    toxic = np.bincount(flat, np.repeat(posterior, sizes), len(sample.names))
    wanted = np.abs(association(toxic, seen, posterior.sum(), float(len(sizes)))) > SIGNIFICANT
    wanted[voters] = True
    vocabulary = np.flatnonzero(wanted)
    place = np.full(len(sample.names), -1)
    place[vocabulary] = np.arange(len(vocabulary))
    at = place[flat]
    rows = np.repeat(np.arange(len(sizes)), sizes)[at >= 0]
    at = at[at >= 0]
    counts = np.bincount(rows, minlength=len(sizes))
    weights, bias = np.zeros(len(vocabulary)), -1.0
    mass, mass_b = np.full(len(vocabulary), 1e-3), 1e-3
    balance = np.where(posterior > 0.5, 0.5 / max((posterior > 0.5).mean(), 1e-3), 0.5 / max((posterior <= 0.5).mean(), 1e-3))
    for _ in range(EPOCHS):
        margin = bias + row_sums(weights[at], counts)
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - posterior) * balance / len(sizes)
        grad = np.bincount(at, error[rows], len(vocabulary)) + RIDGE / len(sizes) * weights
        mass += grad * grad
        weights -= RATE * grad / np.sqrt(mass)
        mass_b += error.sum() ** 2
        bias -= RATE * error.sum() / np.sqrt(mass_b)
    kept = np.abs(weights) > 1e-6
    return ToxicityModel(float(bias), {sample.names[f]: float(w) for f, w in zip(vocabulary[kept], weights[kept])})


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, unlabelled: int = UNLABELLED) -> ToxicityModel:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, label)``.

    Bounded samples: ``per_class`` rows of each label and ``unlabelled`` further rows of ``docs``, whole texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.filter("label in (0, 1) and doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    chosen = bounded_sample(labels, "label", "doc_id", per_class)
    others = bounded_sample(
        docs.filter("doc_id is not null").select("doc_id", F.lit(-1).alias("label")), "label", "doc_id", unlabelled)
    ids = F.broadcast(chosen.union(others))  # bounded by the parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = texts(part.column("text"))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("label"),
                    pa.array([" ".join(sorted(features(t))) for t in rows], pa.string()),
                    pa.array([[bool(p.search(t)) for p in PATTERNS.values()] for t in rows], pa.list_(pa.bool_())),
                ], ["doc_id", "label", "features", "patterns"])

    found = docs.join(ids, "doc_id").select("doc_id", "text", "label").mapInArrow(
        run, "doc_id long, label int, features string, patterns array<boolean>").toLocalIterator()
    number: dict[str, int] = {}
    rows, patterns, marks = [], [], []
    for r in sorted(((r["doc_id"], r["label"], r["features"], r["patterns"]) for r in found), key=lambda r: r[:2]):
        rows.append(np.array([number.setdefault(f, len(number)) for f in r[2].split()], np.int64))
        patterns.append(r[3])
        marks.append(float(r[1]) if r[1] >= 0 else np.nan)
    width = len(PATTERNS)
    return fit(Sample(list(number), rows, np.array(patterns, bool).reshape(-1, width), np.array(marks)))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, predicted`` of every row of ``docs(doc_id, text)``, over whole texts.

    NULL and empty texts have no features and get the score of the bias. Without training rows nothing is
    toxic. Repeated rows give repeated results; further columns of the input are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                margins = np.array([shared.value.margin(t) for t in texts(part.column("text"))])
                scores = 1 / (1 + np.exp(-np.clip(margins, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                    ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
