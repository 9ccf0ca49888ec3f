"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of a text are brought to a log or log-odds scale and standardised. Each class has its own covariance,
shrunk towards the pooled one and a multiple of the identity; the Cholesky factors are computed once and kept in the
model. A score is the difference of the two Mahalanobis log-densities plus the log prior, scaled by a one-parameter
calibration. Means and covariances are sums over *all* labelled training rows, added up by Spark; the driver sees two
classes times a fixed number of sums.

Defined results: a null text is an empty one and gets a score too. Labels that are null or whose document is missing
are not learnt from; a document with several labels counts once for each. With a class missing from the training rows
every score is the share of the class that is there, or 0.5 without any.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import row_keys, slices, stage, text_of, without

HELD_OUT, FOLDS, THRESHOLD = 2, 4, 0.7
SHRINK_POOLED, SHRINK_IDENTITY = 0.2, 0.05
CLIP = 6.0  # standard deviations

_CLASSES = np.zeros((256, 11))
for _i, _members in enumerate((
        b".?!", b",;:", b"'\"()-", b"|", b"#$%*&@", b"/\\<>=+~^_[]{}`", bytes(range(48, 58)), bytes(range(65, 91)),
        bytes(range(97, 123)), b" \t\r\n", bytes(range(128, 256)))):
    _CLASSES[list(_members), _i] = 1
N_STATS = 11 + 11


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of one text: shares of byte classes, lengths, repetition."""
    raw = (text or "").encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float) @ _CLASSES
    shares = np.log((counts + 0.5) / (len(raw) - counts + 20.0))
    words, lines = raw.split(), raw.split(b"\n")
    n = len(words)
    seen = Counter(words)
    top = seen.most_common(4)
    bare = len(set(raw.lower().split()))
    repeats = sum(map(eq, words[1:], words))
    pairs = len(set(pairwise(words)))
    sizes = np.fromiter(map(len, words), float, n)
    odds = lambda k, m: np.log((k + 0.5) / (max(m - k, 0) + 0.5))
    rest = [
        np.log1p(n), np.log1p(len(lines)), np.log1p(n / len(lines)), np.log1p(sizes.mean() if n else 0),
        np.log1p(sizes.std() if n else 0), np.log1p(len(seen)) - np.log1p(n) * 0.8, odds(top[0][1] if n else 0, n),
        odds(sum(c for _, c in top), n), odds(repeats, n), odds(n - 1 - pairs if n else 0, n), np.log1p(n - bare) - np.log1p(n),
    ]
    return np.concatenate([shares, rest])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows = np.array([statistics(t) for t in part.column(1).to_pylist()]).ravel()
        stats = pa.FixedSizeListArray.from_arrays(pa.array(rows), N_STATS).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([part.column(0), stats, part.column(2), part.column(3)], ["doc_id", "stats", "k1", "k2"])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, stats, k1, k2), one row per input row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = text_of(docs)
    rows = docs.select("doc_id", text.alias("text"), *row_keys(docs["doc_id"], text))
    return rows.mapInArrow(_measure, f"doc_id {kind}, stats array<double>, k1 bigint, k2 bigint")


def fold(doc_id: Column | str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(FOLDS))


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians with cached Cholesky factors; ``slope`` and ``shift`` calibrate their log-density difference."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.centre) / self.scale, -CLIP, CLIP)
        logs = []
        for mean, factor in zip(self.means, self.factors):
            y = np.linalg.solve(factor, (z - mean).T)
            logs.append(-0.5 * (y * y).sum(axis=0) - np.log(np.diag(factor)).sum())
        return logs[1] - logs[0] + self.prior

    def score(self, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(stats) + self.shift, -500, 500)))


def fit(n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Discriminant:
    """From per-class counts (2), sums (2, d) and sums of outer products (2, d, d)."""
    total = n.sum()
    centre = sums.sum(0) / total
    spread = np.diag(squares.sum(0)) / total - centre ** 2
    scale = np.sqrt(np.maximum(spread, 1e-8))
    means = (sums / n[:, None] - centre) / scale
    own = []
    for k in range(2):
        raw = squares[k] / n[k] - np.outer(sums[k] / n[k], sums[k] / n[k])
        own.append(raw / np.outer(scale, scale))
    pooled = (n[0] * own[0] + n[1] * own[1]) / total
    d = len(centre)
    factors = []
    for k in range(2):
        weight = SHRINK_POOLED + (1 - SHRINK_POOLED) * d / (d + n[k])  # more for classes with few rows
        mixed = (1 - weight) * own[k] + weight * pooled
        level = max(np.trace(mixed) / d, 1e-6)
        factors.append(np.linalg.cholesky((1 - SHRINK_IDENTITY) * mixed + SHRINK_IDENTITY * level * np.eye(d)))
    return Discriminant(centre, scale, means, np.array(factors), float(np.log(n[1] / n[0])))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class and task: count, sums and outer products, flattened to (label, at, value)."""
    d = N_STATS
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        stats = batch.column(0).flatten().to_numpy().reshape(-1, d)
        for k in (0, 1):
            x = stats[label == k]
            total[k] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
    label = np.repeat([0, 1], total.shape[1])
    at = np.tile(np.arange(total.shape[1]), 2)
    yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(at), pa.array(total.ravel())], ["label", "at", "value"])


def train(stats: DataFrame, labels: DataFrame, target: str = "quality") -> Discriminant | float:
    """The model learnt from all labelled rows outside the held-out fold, or the constant score of a lone class."""
    known = labels.where(F.col(target).isin(0, 1) & (fold("doc_id") != HELD_OUT)).select(
        F.col("doc_id").alias("_id"), F.col(target).cast("int").alias("label"))
    rows = stage(stats.join(known, F.col("doc_id") == F.col("_id")).select("stats", "label"))
    sums = rows.mapInArrow(_sums, "label bigint, at bigint, value double").groupBy("label", "at").agg(
        F.sum("value").alias("value")).toPandas()
    d = N_STATS
    total = np.zeros((2, 1 + d + d * d))
    total[sums["label"], sums["at"]] = sums["value"]
    n = total[:, 0]
    if n.min() < 2:
        return float(n[1] / n.sum()) if n.sum() else 0.5
    model = fit(n, total[:, 1:1 + d], total[:, 1 + d:].reshape(2, d, d))
    return _calibrated(model, rows)


def _calibrated(model: Discriminant, rows: DataFrame, rounds: int = 12) -> Discriminant:
    """Slope and shift of the log-density difference by Newton steps; every step sums over all training rows."""
    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = model.difference(batch.column(0).flatten().to_numpy().reshape(-1, N_STATS))
                # Cells of a fixed grid with their counts hold all that the steps need.
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.clip(np.round(x * 4), -400, 400).astype(np.int64)), batch.column(1)], ["cell", "label"])

    cells = rows.mapInArrow(differ, "cell bigint, label int").groupBy("cell", "label").count().toPandas()
    x, y, w = cells["cell"].to_numpy() / 4, cells["label"].to_numpy(), cells["count"].to_numpy(float)
    w_sum, beta = w.sum(), np.array([1.0, 0.0])
    basis = np.stack([x, np.ones_like(x)], axis=1)
    start = beta.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(basis @ beta, -50, 50)))
        slope = basis.T @ (w * (y - p)) - 1e-3 * w_sum * (beta - start)
        curve = (basis * (w * p * (1 - p))[:, None]).T @ basis + 1e-3 * w_sum * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(curve, slope), -1, 1)
    return Discriminant(model.centre, model.scale, model.means, model.factors, model.prior, max(float(beta[0]), 1e-3), float(beta[1]))


def scored(stats: DataFrame, model: Discriminant | float, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, k1, k2)."""
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(-1, N_STATS)
                score = np.full(len(x), model) if isinstance(model, float) else model.score(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(score), batch.column(2), batch.column(3)], ["doc_id", "score", "k1", "k2"])

    return stats.mapInArrow(run, f"doc_id {kind}, score double, k1 bigint, k2 bigint").select(
        "doc_id", (F.coalesce(fold("doc_id"), F.lit(0)) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "k1", "k2")


def classify(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Learns from the labels and scores every row: (doc_id, held_out, score, predicted, k1, k2)."""
    stats = stage(measured(docs))
    return scored(stats, train(stats, labels, target), threshold)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, unchanged."""
    return without(docs, stage(classify(docs, labels).where("predicted = 0").select("k1", "k2").distinct()))
