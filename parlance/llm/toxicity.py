"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has the probability s = sigmoid(bias + sum of the
weights of its words and word beginnings), and the document's is the noisy-or 1 - prod(1 - s). Bias and weights are fitted through
that formula from document labels alone, so the sentence scores that follow tell which sentences
made a document toxic.

Defined results: null or empty text counts as one sentence without words; a null doc_id is never
held out and never learned from; repeated rows are scored alike; without any usable label every
weight is 0 and every score is sigmoid(bias) of the prior; very long texts are scored whole;
documents whose hashes tie in the sample go by doc_id; an empty table gives no row. Only doc_id and
text are read, so extra columns don't matter.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import Scratch, small_batches, with_ids
from parlance.llm.textkit import _xx

#: The classifier is fitted on at most so many labelled documents of each class, taken in hash order.
SAMPLE_PER_CLASS = 4000
#: Features of the classifier: those in LEAST_DOCUMENTS documents of the sample at least, whose log odds are over
#: LEAST_DEVIATIONS standard errors from 0, the FEATURES farthest of them.
FEATURES, LEAST_DOCUMENTS, LEAST_DEVIATIONS = 2000, 5, 3
PREFIXES = (3, 4, 5, 6)
FOLDS = 5
_sentence = re.compile(r"[^.!?\n]+[.!?]*")
_word = re.compile(r"\w+")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(text, y) of at most 2 * per_class labelled documents outside the held-out fold; copies of a text count once."""
    known = with_ids(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = known.where("y = 1").orderBy(*order).limit(per_class).unionByName(known.where("y = 0").orderBy(*order).limit(per_class))
    bags = with_ids(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id")
    bags = bags.orderBy(*order, "text").limit(2 * per_class).select(F.coalesce("text", F.lit("")).alias("text"), "y")
    return bags.groupBy("text").agg(F.max("y").alias("y"))


def bag(text: str) -> list[list[str]]:
    return [_word.findall(s) for s in _sentence.findall(text.lower())] or [[]]


def features(word: str) -> list[str]:
    """A word stands for itself and for its beginnings, since forms of one stem share them."""
    return ["=" + word, *(word[:n] for n in PREFIXES if n < len(word))]


class _Sums(dict):
    """Sum of a word's weights, kept for words seen lately."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 100_000:
            self.clear()
        z = self[word] = sum(self.weights.get(_xx(f), 0.0) for f in features(word))
        return z


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class NoisyOr:
    """Weights of features, which go by their hashes, and a bias; scores sentences and bags."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def score_all(self, texts: list[str], sums: _Sums | None = None) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """The noisy-or of each bag, and (start, end, probability) of its sentences of at least 0.5."""
        sums = _Sums(self.weights) if sums is None else sums
        of = sums.__getitem__
        z, spans, sizes = [], [], []
        for text in texts:
            before = len(z)
            for m in _sentence.finditer(text):
                z.append(sum(map(of, _word.findall(m[0].lower()))))
                spans.append(m.span())
            if len(z) == before:
                z.append(0.0)
                spans.append((0, len(text)))
            sizes.append(len(z) - before)
        z = np.clip(np.array(z) + self.bias, -500, 500)
        ends = np.cumsum(sizes)
        p = np.clip(-np.expm1(np.add.reduceat(-np.logaddexp(0, z), ends - sizes)), 0, 1) if sizes else np.empty(0)
        where: list = [[] for _ in texts]
        for i in np.flatnonzero(z >= 0).tolist():
            where[int(np.searchsorted(ends, i, "right"))].append((*spans[i], float(_sigmoid(z[i]))))
        return p, where


SPANS = "array<struct<start: bigint, end: bigint, score: double>>"


def score(docs: DataFrame, model: NoisyOr, keep: list[str], names: tuple[str, str, str] = ("score", "predicted", "offending")) -> DataFrame:
    """docs' columns keep, then score, prediction and the offending sentences' code-point spans under names."""
    small_batches(docs.sparkSession)
    # inside the function columns go by place, as names may hold anything
    kinds = dict(docs.dtypes)
    rows = docs.select("text", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        sums = _Sums(model.weights)
        for b in batches:
            p, where = model.score_all([t or "" for t in b.column(0).to_pylist()], sums)
            spans = pa.array([[{"start": x, "end": y, "score": float(s)} for x, y, s in w] for w in where], span)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i + 1) for i in range(len(keep))], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), spans],
                [*keep, *names],
            )

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, {names[0]} double, {names[1]} int, {names[2]} {SPANS}")


def _chosen(sample: DataFrame, positive: int, negative: int) -> np.ndarray:
    """Hashes, sorted, of the FEATURES features that tell the classes apart best, by counts of documents."""

    def run(batches):
        for b in batches:
            out = []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = {w for s in bag(text) for w in s}
                out.append((y, np.unique(np.array([_xx(f) for w in words for f in features(w)], np.uint64))))
            for y in (0, 1):
                held = [f for label, f in out if label == y]
                if held:
                    f, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(n * (y == 0)), pa.array(n * (y == 1))], ["f", "n", "p"])

    counts = sample.mapInArrow(run, "f long, n long, p long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    top = counts.where(F.col("n") + F.col("p") >= LEAST_DOCUMENTS).toArrow()
    f, n, p = (top.column(c).to_numpy() for c in ("f", "n", "p"))
    f = f.astype(np.int64).view(np.uint64)
    odds = np.log((p + 0.5) / (positive - p + 0.5)) - np.log((n + 0.5) / (negative - n + 0.5))
    rank = np.abs(odds) / np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
    order = np.lexsort((f, -rank))[:FEATURES]
    return np.sort(f[order[rank[order] > LEAST_DEVIATIONS]])


def _found(sample: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(key, y, sentences, sentence, feature): where a document's sentences hold the chosen features."""
    place = {int(f): i for i, f in enumerate(chosen)}

    def run(batches):
        known: dict[str, list[int]] = {}
        for b in batches:
            out = []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sentences, sent, found = bag(text), [], []
                for i, s in enumerate(sentences):
                    for w in s:
                        if w not in known:
                            known[w] = [place[h] for h in map(_xx, features(w)) if h in place]
                        found += known[w]
                        sent += [i] * len(known[w])
                out.append((_xx(text) >> 1, y, len(sentences), sent, found))
                if len(known) > 100_000:
                    known.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], ["key", "y", "sentences", "sentence", "feature"]) if out else pa.RecordBatch.from_arrays([pa.array([], k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))], ["key", "y", "sentences", "sentence", "feature"])

    return sample.mapInArrow(run, "key long, y int, sentences int, sentence array<int>, feature array<int>")


def descend(y: np.ndarray, sentences: np.ndarray, sent: np.ndarray, feature: np.ndarray, n: int, rounds: int = 200, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """n weights and the bias that fit the labels y through the noisy-or, by gradient steps with moments.

    sentences says how many each document has; sent, numbered over all documents, holds feature.
    """
    doc = np.repeat(np.arange(len(y)), sentences)
    theta, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    theta[-1] = -4.0
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum())  # both classes weigh the same
    for t in range(1, rounds + 1):
        z = np.clip(theta[-1] + np.bincount(sent, theta[feature], len(doc)), -500, 500)
        clean = np.bincount(doc, -np.logaddexp(0, z), len(y))  # log of the product of 1 - s
        p = np.clip(-np.expm1(clean), 1e-9, 1)
        pull = np.where(y > 0, -np.exp(clean) / p, 1.0) * share
        dz = pull[doc] * _sigmoid(z)
        g = np.append(np.bincount(feature, dz[sent], n), dz.sum())
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> NoisyOr:
    """Executors turn the sample's texts into sparse features; only these, and counts of features, reach the driver."""
    small_batches(docs.sparkSession)
    sample = Scratch(docs.sparkSession, "toxicity").save(training_sample(docs, labels, per_class))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(sizes) < 2:
        return NoisyOr({}, 3.0 if 1 in sizes else -30.0)  # without toxic documents no number of sentences makes one
    chosen = _chosen(sample, sizes[1], sizes[0])
    rows = _found(sample, chosen).toArrow().combine_chunks().sort_by("key")
    y, sentences = rows.column("y").to_numpy(), rows.column("sentences").to_numpy()
    sent, feature = (rows.column(c).combine_chunks() for c in ("sentence", "feature"))
    starts = np.cumsum(sentences) - sentences
    held = np.repeat(starts, np.diff(sent.offsets.to_numpy()))
    theta = descend(y, sentences, held + sent.flatten().to_numpy(), feature.flatten().to_numpy(), len(chosen))
    return NoisyOr({int(f): float(w) for f, w in zip(chosen, theta, strict=False) if abs(w) > 1e-3}, float(theta[-1]))
