"""Target-distribution importance resampling: hashed features, array-scored weights, ranks by regular sampling.

Every text becomes an array of feature buckets, once. Bucket counts of corpus and target give a gain per bucket, and the
sum of gains over a text's array is its weight; with a Gumbel number from its id, the highest scores are a draw without
replacement in proportion to the exponential of the weight. Exact ranks come from parallel sorting by regular sampling:
runs of the scored rows are sorted locally and yield rows at regular distance, these yield regular splitters, rows are
exchanged by splitter and sorted in their segment, and counts of the segments before turn places into ranks. Rows differ
in a last key, their number, so no splitter falls into a tie and a segment holds at most about twice its share.

Defined results: a null text has no words and no features, weight 0; a null id enters the hash as nothing and ranks last among
ties. Rows that repeat id and text have one score each and ranks of their own. Without rows of enough words no row has a
rank. Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window as W

from .common import Remembered, pieces, slices, stage, text_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BUCKETS, LONGEST, SEED = 10_000, 1, "2024:"
SHARE, WORDS = 10, 20  # per cent that are drawn, of texts with so many words
RUN, FEWEST, MOST = 1 << 16, 32, 1024  # rows of a run, and the number of runs


def bucket_array(text: str | None, buckets: int, longest: int, known: Remembered) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of up to ``longest`` words."""
    words, arrays, last = 0, [], []
    for part in pieces((text or "").encode().lower(), WORD):
        found = WORD.findall(part)
        words += len(found)
        arrays.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
        row = last + found
        for n in range(2, longest + 1):
            first = max(0, len(last) - n + 1)  # runs that end in an earlier piece are counted there
            runs = [b" ".join(row[i:i + n]) for i in range(first, len(row) - n + 1)]
            arrays.append(np.fromiter((zlib.crc32(r) % buckets for r in runs), np.uint32, len(runs)))
        last = row[len(row) - min(len(row), longest - 1):]
    return words, np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)


def features(texts: DataFrame, key: str, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(key, n_words, n_features, buckets): the buckets as little-endian 32-bit integers."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(lambda w: zlib.crc32(w) % buckets)
        for part in slices(batches):
            found = []
            for text in part.column(1).to_pylist():
                found.append(bucket_array(text, buckets, longest, known))
                known.trim()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([len(a) for _, a in found], pa.int64()),
                 pa.array([a.astype("<u4").tobytes() for _, a in found], pa.binary())], [key, "n_words", "n_features", "buckets"])
    return texts.select(key, text_of(texts).alias("text")).mapInArrow(
        run, f"{key} {kind}, n_words bigint, n_features bigint, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall in each bucket; tasks pass on sums, so the driver gets one number a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                total += np.bincount(np.frombuffer(cell.as_buffer(), "<u4"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])
    rows = found.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of target and corpus, in thousandths, rounded down."""
    s, t, k = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def scored(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score)."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gain[np.frombuffer(cell.as_buffer(), "<u4")].sum()) for cell in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())],
                                             ["doc_id", "n_words", "n_features", "weight"])
    rows = found.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")
    name = F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")
    return rows.withColumn("score", F.col("weight") + gumbel)


def _every(stride: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows at regular distance; runs begin at different offsets, so that no part of short runs is passed over by all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = int(TaskContext.get().partitionId() * 0.6180339887 % 1 * stride)
        for batch in batches:
            at = np.arange((stride - 1 - seen) % stride, batch.num_rows, stride)
            seen += batch.num_rows
            if len(at):
                yield batch.take(pa.array(at))
    return run


def _order(score: int, doc_id: object, tie: int) -> tuple:
    return -score, doc_id is None, doc_id, tie


def _segments(splitters: list[tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the number of splitters before each row."""
    scores = np.array([s[0] for s in splitters], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            down = -batch.column(0).to_numpy(zero_copy_only=False)
            at, end = np.searchsorted(scores, down, "left"), np.searchsorted(scores, down, "right")
            for i in np.flatnonzero(at < end).tolist():  # the splitters around have the row's own score
                at[i] = bisect_left(splitters, _order(*(batch.column(c)[i].as_py() for c in range(3))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], [*batch.schema.names, "segment"])
    return run


def ranked(rows: DataFrame, fewest: int = FEWEST, run_rows: int = RUN) -> DataFrame:
    """Adds ``rank`` to staged rows (score, doc_id, tie, ...): 1, 2, 3 by falling score, then id, then ``tie``, which is unique."""
    total = rows.count()
    runs = min(MOST, max(fewest, -(-total // run_rows)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "tie"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    key = rows.select("score", "doc_id", "tie")
    # Regular sampling: every run gives a row at each runs-th part of its share, so the driver gets runs * runs rows at most.
    sample = key.repartition(runs, "tie").sortWithinPartitions(*order).mapInArrow(
        _every(max(1, total // (runs * runs))), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key.schema))
    picked = sorted(_order(*r) for r in sample.collect())
    splitters = picked[max(1, len(picked) // runs)::max(1, len(picked) // runs)]
    cut = stage(rows.mapInArrow(_segments(splitters), kinds + ", segment int"))
    sizes = {r["segment"]: r["count"] for r in cut.groupBy("segment").count().collect()}
    before = np.cumsum([0, *(sizes.get(i, 0) for i in range(len(splitters)))]).tolist()
    offset = F.array(*[F.lit(n).cast("bigint") for n in before])[F.col("segment")]
    place = F.row_number().over(W.partitionBy("segment").orderBy(*order))
    return cut.withColumn("rank", offset + place).drop("segment")


def resample(docs: DataFrame, target: DataFrame, target_key: str = "item_id", buckets: int = BUCKETS, longest: int = LONGEST,
             share: int = SHARE, words: int = WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per document; ``rank`` only for those drawn."""
    found = stage(features(docs, "doc_id", buckets, longest))
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(target, target_key, buckets, longest), buckets))
    rows = stage(scored(found, gain).withColumn("tie", F.monotonically_increasing_id()))
    enough = rows.where(F.col("n_words") >= words).select("score", "doc_id", "tie", "n_features", "weight")
    drawn = enough.count() * share // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("bigint").alias("rank")
    short = rows.where(F.col("n_words") < words).withColumn("rank", F.lit(None).cast("bigint"))
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked(enough).select(*out, rank).unionByName(short.select(*out, "rank"))
