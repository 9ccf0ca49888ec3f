"""Toxicity by a bidirectional gated recurrent network over overlapping windows of a text, one start in 16 words.

A text is cut into windows of ``WINDOW`` words, each ``STEP`` words after the one before; every window is scored and a
document's score is its largest window's, calibrated. The network learns from whole documents: their labels say that
some window is toxic, not which. Training picks a toxic document's window by the network itself (at first by word
odds), leaves out the worst-fitting share of toxic documents as mislabelled, and takes clean documents' windows at
random and where the network errs most.

Training rows are a sample of fixed size: at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled documents of at most
``LONGEST`` characters, by the hash of their id. They are gathered in one task, which returns the weights.

Defined results: a null or wordless text is one empty window and has a score too. Labels that are null, or whose
document is missing, are not learnt from. Without a training row of either class every score is the share of the
class that is there, or 0.5.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import gru
from .common import slices, text_of
from .quality import HELD_OUT, fold

WINDOW, STEP, THRESHOLD = 24, 16, 0.3
TOXIC_ROWS, CLEAN_ROWS, LONGEST = 1500, 2500, 6_000
ROUNDS, EPOCHS, BATCH, RATE, TRIM = 4, 3, 64, 0.003, 0.15
KNOWN = 2  # training documents that hold a word of the vocabulary
REMEMBERED = 300_000
AT_ONCE = 4096  # windows scored in one go

_words = re.compile(r"\w+").findall


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end: positions (n, WINDOW), their mask, and the document of each window."""
    counts = np.maximum(1, -(-np.maximum(lengths - WINDOW, 0) // STEP) + 1)
    owner = np.repeat(np.arange(len(lengths)), counts)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.cumsum(lengths) - lengths
    at = (first[owner] + rank * STEP)[:, None] + np.arange(WINDOW)
    mask = at < (first + lengths)[owner][:, None]
    return np.where(mask, at, 0), mask, owner


class Tokens:
    """Numbers words as they come; ``take`` hands out the network inputs of those added since the last time."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary = vocabulary
        self.number: dict[str, int] = {}
        self.rows: list[int] = []
        self.grams: list[int] = []
        self.owner: list[int] = []

    def add(self, words) -> None:
        for w in words:
            if w not in self.number:
                grams = gru.trigrams(w)
                self.owner += [len(self.rows)] * len(grams)
                self.number[w] = len(self.number)
                self.rows.append(self.vocabulary.get(w, 0))
                self.grams += grams

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = tuple(np.array(x, np.int64) for x in (self.rows, self.grams, self.owner))
        self.rows, self.grams, self.owner = [], [], []
        return out


def fit(texts: list[str], y: np.ndarray, seed: int = 7) -> dict:
    """Trains the network on whole documents with labels ``y`` of both classes."""
    rng = np.random.default_rng(seed)
    found = [_words(t.lower()) for t in texts]
    held = Counter(w for words in found for w in set(words))
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in held.items() if n >= KNOWN), 1)}
    tokens = Tokens(vocabulary)
    for words in found:
        tokens.add(words)
    rows, grams, owner = tokens.take()
    gram_at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))])
    ids = [np.array([tokens.number[w] for w in words], np.int64) for words in found]
    lengths = np.array([len(x) for x in ids])
    flat = np.concatenate([*ids, np.zeros(1, np.int64)])
    at, mask, doc = windows(lengths)
    at = flat[np.minimum(at, len(flat) - 1)]
    # First choice: the window with the word whose documents are toxic at the highest odds.
    pos, neg = (np.zeros(len(rows)), np.zeros(len(rows)))
    for x, label in zip(ids, y):
        (pos if label else neg)[np.unique(x)] += 1
    odds = np.log((pos + 0.1) / (y.sum() + 1)) - np.log((neg + 0.5) / ((1 - y).sum() + 1))
    value = np.where(mask, odds[at], -9).max(axis=1)
    params = gru.start(rng, len(vocabulary))
    adam = gru.Adam(params, RATE)
    label = y[doc]
    clean = np.flatnonzero(label == 0)
    for _ in range(ROUNDS):
        order = np.lexsort((value, doc))
        best = order[np.append(np.flatnonzero(np.diff(doc[order])), len(order) - 1)]  # per document
        toxic = best[y[doc[best]] == 1]
        toxic = toxic[np.argsort(-value[toxic], kind="stable")[:max(1, int(len(toxic) * (1 - TRIM)))]]
        hard = best[y[doc[best]] == 0]
        for _ in range(EPOCHS):
            chosen = np.concatenate([toxic, hard, rng.choice(clean, min(len(clean), 2 * len(hard)))])
            rng.shuffle(chosen)
            for k in range(0, len(chosen), BATCH):
                part = chosen[k:k + BATCH]
                used, local = np.unique(at[part], return_inverse=True)
                sizes = gram_at[used + 1] - gram_at[used]
                g = grams[np.repeat(gram_at[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
                o = np.repeat(np.arange(len(used)), sizes)
                x = gru.inputs(params, rows[used], g, o)
                weight = np.ones(len(part), np.float32)
                _, grads, d_x = gru.gradients(
                    params, x, local.reshape(at[part].shape), mask[part], label[part].astype(np.float32), weight)
                touched = {}
                touched["words"], grads["words"] = gru.gathered(rows[used], d_x, skip=0)
                touched["grams"], grads["grams"] = gru.gathered(g, (d_x / sizes[:, None])[o])
                adam.step(grads, touched)
        table = gru.project(params, gru.inputs(params, rows, grams, owner))
        value = np.concatenate([gru.forward(params, at[i:i + AT_ONCE], mask[i:i + AT_ONCE], table)
                                for i in range(0, len(at), AT_ONCE)])
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, doc, value)
    return params | {"best": best.astype(np.float32), "vocabulary": vocabulary}


def calibrate(best: np.ndarray, y: np.ndarray, share: float, steps: int = 25) -> np.ndarray:
    """Slope and shift that turn a document's largest logit into a probability where ``share`` of all are toxic."""
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    basis, beta = np.stack([best, np.ones_like(best)], axis=1).astype(float), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(basis @ beta, -40, 40)))
        slope = basis.T @ (weight * (y - p)) - 1e-2 * len(y) * np.array([beta[0] - 1, 0])
        curve = (basis * (weight * p * (1 - p))[:, None]).T @ basis + 1e-2 * len(y) * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(curve, slope), -1, 1)
    return np.array([max(beta[0], 0.05), beta[1]])


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> dict | float:
    """Weights with ``calibration``, or a constant score."""
    known = labels.where(F.col(target).isin(0, 1) & (fold("doc_id") != HELD_OUT)).select(
        F.col("doc_id").alias("_id"), F.col(target).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts))) if counts else 0.5
    by_hash = [F.xxhash64("_id"), F.col("_id")]
    sample = known.where("y = 1").orderBy(*by_hash).limit(TOXIC_ROWS).unionByName(
        known.where("y = 0").orderBy(*by_hash).limit(CLEAN_ROWS))
    text = text_of(docs)
    share = counts[1] / sum(counts.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["y"], r["text"]) for b in batches for r in b.to_pylist())
        y = np.array([r[0] for r in rows])
        if len(set(y.tolist())) == 2:
            params = fit([r[1] for r in rows], y)
            params["calibration"] = calibrate(params.pop("best"), y, share)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(params)], pa.binary())], ["model"])

    # The sample is of fixed size, so it is broadcast and its documents fit in one task.
    rows = docs.select("doc_id", text.alias("text")).where(F.length("text") <= LONGEST).join(
        F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    # Of rows that repeat an id one is taken, so that the bound holds whatever the table.
    rows = rows.groupBy("_id", "y").agg(F.min("text").alias("text")).select("y", "text")
    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else share


class Scorer:
    def __init__(self, params: dict):
        self.params, self.slope, self.shift = params, *params["calibration"]
        self._forget()

    def _forget(self) -> None:
        self.tokens, self.filled = Tokens(self.params["vocabulary"]), 0
        self.table = {s: np.zeros((REMEMBERED, 3 * gru.HIDDEN), np.float32) for s in ("f", "b")}

    def _numbers(self, found: list[list[str]]) -> np.ndarray:
        new = set().union(*found).difference(self.tokens.number)
        if self.filled + len(new) > REMEMBERED:
            self._forget()
            new = set().union(*found)
        if len(new) > REMEMBERED:  # one slice with very many different words
            self.table = {s: np.zeros((len(new), 3 * gru.HIDDEN), np.float32) for s in ("f", "b")}
        if new:
            self.tokens.add(new)
            for s, v in gru.project(self.params, gru.inputs(self.params, *self.tokens.take())).items():
                self.table[s][self.filled:self.filled + len(new)] = v
            self.filled += len(new)
        number = self.tokens.number.__getitem__
        return np.fromiter(chain.from_iterable(map(number, words) for words in found), np.int64, sum(map(len, found)))

    def score(self, texts: list[str]) -> np.ndarray:
        found = [_words(t.lower()) for t in texts]
        flat = np.append(self._numbers(found), 0)
        at, mask, doc = windows(np.array([len(w) for w in found]))
        best = np.full(len(texts), -np.inf)
        for i in range(0, len(at), AT_ONCE):
            part = slice(i, i + AT_ONCE)
            np.maximum.at(best, doc[part], gru.forward(self.params, flat[at[part]], mask[part], self.table))
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -500, 500)))


_last: list[Scorer] = []


def _scorer(params: dict) -> Scorer:
    """The worker's scorer, kept from task to task while the model is the same."""
    if not _last or not np.array_equal(_last[0].params["out"], params["out"]):
        _last[:] = [Scorer(params)]
    return _last[0]


def classify(docs: DataFrame, labels: DataFrame, target: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """Learns from the labels and scores every row: (doc_id, held_out, score, predicted)."""
    model = train(docs, labels, target)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if isinstance(shared.value, float) else _scorer(shared.value)
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            score = np.full(len(texts), shared.value) if scorer is None else scorer.score(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["doc_id", "score"])

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", (F.coalesce(fold("doc_id"), F.lit(0)) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
