"""Toxicity by a chain of linear classifiers.

Categories are predicted in a fixed order. Each has a logistic model over the presence of words and
over the probabilities of all earlier categories; a later model is trained with the probabilities
that earlier models gave out of fold, so it sees them as it will on new texts. A document is toxic
where the last category's probability reaches the threshold that is best (F-measure weighing
precision twice as high) on the out-of-fold probabilities, and at least twice that of a text without
any of the model's words, so that texts the model knows nothing of are never rejected.

Training takes a bounded sample: the ``sample`` labelled documents of least hashed id. Its word counts
are made by Spark; the words kept (at most ``features`` for each category, by a likelihood-ratio test
whose level falls with the number of words tested) and the sample's rows over them are small enough for the driver.
Every document is scored, whole. The model is a few hundred words, so it travels with the tasks.

Defined results: null and empty texts have the models' base rates; a document whose label rows
disagree counts as positive in a category if one says so; null labels and labels of unknown documents
are left out; of rows that share an id the least text is learned from; without any labelled document nothing is toxic and all probabilities are 0; repeated
rows score alike; other columns are carried along, except that columns named like results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

WORDS = re.compile(r"[^\W\d_]+")
FOLDS = 5
#: A word's likelihood-ratio statistic must exceed this times the logarithm of the number of words.
SIGNIFICANT = 1.7


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    slots: dict[str, int]
    weights: tuple[np.ndarray, ...]  # of the bias, the words, the earlier categories
    threshold: float

    def probabilities(self, words: set[str]) -> list[float]:
        at = [self.slots[w] for w in words if w in self.slots]
        return self._chained(tuple(sorted(at)))

    def _chained(self, at: tuple[int, ...]) -> list[float]:
        out: list[float] = []
        for w in self.weights:
            n = len(w) - len(out)
            z = w[0] + sum(w[1 + i] for i in at) + sum(a * b for a, b in zip(w[n:], out, strict=True))
            out.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; the first column is the bias and not shrunk."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (y - p) - penalty * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights of each category's model and the out-of-fold probabilities (rows x categories)."""
    weights: list[np.ndarray] = []
    outside = np.zeros((len(x), 0))
    for k in range(labels.shape[1]):
        own = np.hstack([np.ones((len(x), 1)), x, outside])
        held = np.zeros(len(x))
        for f in range(FOLDS):
            inside = fold != f
            if inside.any() and (~inside).any():
                w = fit_logistic(own[inside], labels[inside, k])
                held[~inside] = 1 / (1 + np.exp(-np.clip(own[~inside] @ w, -40, 40)))
        weights.append(fit_logistic(own, labels[:, k]))
        outside = np.hstack([outside, held[:, None]])
    return weights, outside


def best_threshold(p: np.ndarray, y: np.ndarray, beta: float = 0.5) -> float:
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits, n = np.cumsum(y), np.arange(1, len(y) + 1)
    last = np.append(p[1:] != p[:-1], True)  # equal probabilities stand or fall together
    gain = np.where(last & (hits > 0), (1 + beta**2) * hits / (n + beta**2 * max(y.sum(), 1)), -1)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return 2.0
    return float((p[best] + p[best + 1]) / 2) if best + 1 < len(p) else float(p[best])


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], doc_id: str = "doc_id", text: str = "text", sample: int = 20_000, features: int = 100, least: int = 3) -> Chain:
    """Fit a chain. ``categories``: name to a 0/1 column of ``labels``, in the chain's order.

    ``sample`` bounds the labelled documents learned from, ``features`` the words of each category (those
    of lesser statistics are no features), ``least`` the documents of the sample that a word must be in
    (rarer words are no features). All three bound the training alone; every document is scored.
    """
    names = list(categories)
    marked = labels.select(labels[doc_id].alias("id"), *[c.cast("int").alias(f"y{k}") for k, c in enumerate(categories.values())]).dropna()
    marked = marked.groupBy("id").agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(len(names))])
    picked = marked.join(docs.select(docs[doc_id].alias("id")).dropna().distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)
    picked = docs.sparkSession.createDataFrame(picked.collect(), picked.schema)
    marks = [f"y{k}" for k in range(len(names))]
    rows = docs.select(docs[doc_id].alias("id"), docs[text].cast("string").alias("text")).join(F.broadcast(picked), "id")
    rows = rows.groupBy("id", *marks).agg(F.min("text").alias("text"))  # one row an id, whatever repeats

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(words_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(m) for m in marks), pa.array(words, pa.list_(pa.string()))], names=["id", *marks, "words"])

    worded = rows.mapInArrow(split, T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField("words", T.ArrayType(T.StringType()))])).cache()
    totals = worded.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"y{k}").alias(f"y{k}") for k in range(len(names))]).first()
    n = totals["n"]
    if not n:
        return Chain(tuple(names), {}, tuple(np.append([-40.0], np.zeros(k)) for k in range(len(names))), 2.0)
    seen = worded.select(F.explode("words").alias("word"), *[f"y{k}" for k in range(len(names))]).groupBy("word").agg(F.count(F.lit(1)).alias("c"), *[F.sum(f"y{k}").alias(f"y{k}") for k in range(len(names))])
    bar = SIGNIFICANT * float(np.log(max(2, seen.count())))
    kept: set[str] = set()
    for k in range(len(names)):
        total, c, a = float(totals[f"y{k}"]), F.col("c").cast("double"), F.col(f"y{k}").cast("double")
        if 0 < total < n:
            cell = lambda o, e: F.when(o > 0, 2 * o * F.log(o / e)).otherwise(0.0)
            ratio = cell(a, c * total / n) + cell(c - a, c * (n - total) / n) + cell(total - a, (n - c) * total / n) + cell(n - c - total + a, (n - c) * (n - total) / n)
            kept |= {r["word"] for r in seen.filter(F.col("c") >= least).select("word", ratio.alias("ratio")).filter(F.col("ratio") > bar).orderBy(F.desc("ratio"), "word").limit(features).collect()}
    slots = {w: i for i, w in enumerate(sorted(kept))}
    allowed = F.array(*[F.lit(w) for w in slots]) if slots else F.array().cast("array<string>")
    got = worded.select("id", *[f"y{k}" for k in range(len(names))], F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)).alias("fold"), F.array_intersect("words", allowed).alias("words")).orderBy("id").collect()
    worded.unpersist()
    x = np.zeros((len(got), len(slots)))
    for i, r in enumerate(got):
        x[i, [slots[w] for w in r["words"]]] = 1
    y = np.array([[r[f"y{k}"] for k in range(len(names))] for r in got], float)
    weights, outside = fit_chain(x, y, np.array([r["fold"] for r in got]))
    ready = Chain(tuple(names), slots, tuple(weights), best_threshold(outside[:, -1], y[:, -1]))
    return replace(ready, threshold=max(ready.threshold, min(0.5, 2 * ready.probabilities(set())[-1])))


def classify(docs: DataFrame, chain: Chain, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``<category>_probability`` for each category and ``is_toxic``."""
    added = [*(f"{c}_probability" for c in chain.categories), "is_toxic"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {a.lower() for a in added}]
    source = docs.select(*kept, docs[text].cast("string").alias(unused(kept)))
    schema = T.StructType(source.schema.fields[:-1] + [T.StructField(a, T.DoubleType()) for a in added[:-1]] + [T.StructField(added[-1], T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(chain.slots)
        for batch in batches:
            p = [chain.probabilities(known.intersection(WORDS.findall(t.lower()))) if t else chain.probabilities(set()) for t in batch.column(len(kept)).to_pylist()]
            columns = [pa.array([row[k] for row in p], pa.float64()) for k in range(len(chain.categories))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *columns, pa.array([row[-1] >= chain.threshold for row in p], pa.bool_())], names=[*kept, *added])

    return source.mapInArrow(run, schema)
