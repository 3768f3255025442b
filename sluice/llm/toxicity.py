"""Toxicity by a chain of linear classifiers.

Categories are judged in a fixed order. The model of a category sees the
document's word features and the probabilities of the categories before it;
while training, those are out-of-fold predictions, so that a later model learns
from probabilities as unsure as those it will meet. Categories named in
``SEEDS`` take their training labels from the seed words within documents that
people marked toxic; the last, ``toxic``, is the people's own label.

Words are counted over all labelled documents on the executors; the models are
fitted on at most ``SAMPLE`` labelled rows, reduced to ``TERMS`` features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

#: Labelled documents that fit() reads at most, and features that it keeps.
SAMPLE = 8000
TERMS = 400
FOLDS = 5
#: Seed words of the categories before the last one.
SEEDS = {
    "insult": ("idiot", "moron", "loser", "clown", "stupid"),
    "contempt": ("trash", "scum", "worthless", "pathetic", "disgusting"),
}
CHAIN = (*SEEDS, "toxic")
_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are features besides whole words.
_HEADS = (4, 6)


def features(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:n] + "~" for w in words for n in _HEADS if len(w) > n}


@dataclass
class Chain:
    terms: list[str]
    weights: dict[str, np.ndarray]  # for each category: terms, earlier categories, bias
    threshold: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for c in CHAIN:
            w = self.weights[c]
            out = np.hstack([out, sigmoid(np.hstack([x, out, np.ones((len(x), 1))]) @ w)[:, None]])
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 3e-4, steps: int = 200) -> np.ndarray:
    """Regularised logistic regression by accelerated gradient steps, restarted when they point uphill; the last column is the bias."""
    w = v = np.zeros(x.shape[1])
    u = np.ones(x.shape[1])
    for _ in range(12):  # the curvature's bound: a power iteration
        u = x.T @ (x @ u)
        u /= np.linalg.norm(u) or 1.0
    scale = 0.3 * np.square(x @ u).sum() / max(1, len(y)) + l2
    reg = np.full(x.shape[1], l2)
    reg[-1] = 0
    k = 0
    for _ in range(steps):
        g = x.T @ (sigmoid(x @ v) - y) / max(1, len(y)) + reg * v
        new = v - g / scale
        if g @ (new - w) > 0:
            k = 0
        v = new + k / (k + 3) * (new - w)
        w, k = new, k + 1
    return w


def train_chain(x: np.ndarray, labels: dict[str, np.ndarray], terms: list[str], folds: int = FOLDS) -> Chain:
    fold = np.arange(len(x)) % folds
    seen, weights = np.zeros((len(x), 0)), {}
    one = np.ones((len(x), 1))
    for c in CHAIN:
        z, y = np.hstack([x, seen, one]), labels[c].astype(float)
        weights[c] = logistic(z, y)
        out = np.zeros(len(x))
        for f in range(folds):
            if (fold == f).any() and (fold != f).any():
                out[fold == f] = sigmoid(z[fold == f] @ logistic(z[fold != f], y[fold != f]))
        seen = np.hstack([seen, out[:, None]])
    # The threshold of best F1 over out-of-fold predictions.
    best = max(np.linspace(0.1, 0.9, 33), key=lambda t: (_f1(seen[:, -1] > t, labels["toxic"]), -abs(t - 0.5)))
    return Chain(terms, weights, float(best))


def _f1(said: np.ndarray, true: np.ndarray) -> float:
    hit = (said & (true > 0)).sum()
    return 2 * hit / max(1, said.sum() + (true > 0).sum())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> Chain | None:
    """The chain, or None without labelled rows of both kinds. Documents with several labels take the highest."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ys, fs = [], []
            for text, y in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                own = sorted(features(text.as_py()))
                ys += [y] * len(own)
                fs += own
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(fs, pa.string())], names=["y", "term"])

    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Bounded by ``sample`` rows of two numbers.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(marks.withColumn("doc_id", F.col("doc_id").cast("bigint"))), "doc_id").select("doc_id", "text", "y")
    total = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not total.get(0) or not total.get(1):
        return None
    counts = rows.mapInArrow(frugal(tokens), "y int, term string").groupBy("term").agg(F.sum((F.col("y") == 1).cast("long")).alias("p"), F.sum((F.col("y") == 0).cast("long")).alias("n")).where("p + n >= 4")
    # Signed chi: how far a term's toxic count is from what its frequency makes one expect.
    share = total[1] / (total[0] + total[1])
    off = F.abs(F.col("p") - (F.col("p") + F.col("n")) * share) / F.sqrt((F.col("p") + F.col("n")) * share)
    kept = [r["term"] for r in counts.orderBy(off.desc(), "term").limit(terms).select("term").collect()]
    index = {t: i for i, t in enumerate(kept)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = {c: set(s) for c, s in SEEDS.items()}
        for b in batches:
            at, cats = [], []
            for text in b.column(1):
                own = features(text.as_py())
                at.append(sorted(index[t] for t in own if t in index))
                cats.append([int(bool(own & s)) for s in seeds.values()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(cats, pa.list_(pa.int32()))], names=["doc_id", "y", "at", "cats"])

    got = rows.mapInArrow(frugal(vectors), "doc_id bigint, y int, at array<int>, cats array<int>").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    x = np.zeros((len(got), len(kept)))
    for i, r in enumerate(got):
        x[i, r["at"]] = 1
    y = np.array([r["y"] for r in got])
    named = {c: np.array([r["cats"][k] for r in got]) * (y > 0) for k, c in enumerate(SEEDS)}
    return train_chain(x, {**named, "toxic": y}, kept)


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """doc_id, p_<category> for the chain, toxic. A null text is empty. Without a chain nothing is toxic."""
    schema = "doc_id bigint, " + ", ".join(f"p_{c} double" for c in CHAIN) + ", toxic boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {t: i for i, t in enumerate(chain.terms)} if chain else {}
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                p = np.zeros((part.num_rows, len(CHAIN)))
                if chain:
                    x = np.zeros((part.num_rows, len(chain.terms)))
                    for i, text in enumerate(part.column(1)):
                        x[i, [index[t] for t in features(text.as_py()) if t in index]] = 1
                    p = chain.scores(x)
                toxic = p[:, -1] > (chain.threshold if chain else 1)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(p[:, k]) for k in range(len(CHAIN))], pa.array(toxic)], names=["doc_id", *[f"p_{c}" for c in CHAIN], "toxic"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(frugal(run), schema)
