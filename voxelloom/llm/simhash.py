"""Near-duplicates by SimHash: a byte-position inverted index with count filtering, then verification.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of their 8 positional bytes. Postings are kept
for sets of 4 byte positions, chosen so that any 5 positions hold one of the sets whole: every linked pair meets in a
posting list, and 32 equal bits make chance meetings rare. For each pair the shared positional bytes are tallied,
pairs below 5 are dropped and the rest verified bit by bit.

Equal fingerprints are one class, whatever their number. A posting list of up to ``LIST`` classes yields its pairs.
Longer lists do not: their classes meet over flipped bits instead. Two fingerprints at distance 3 or less share a
value reached from one by at most 1 flip and from the other by at most 2, and all classes that meet at such a value
within 1 + 2 flips are linked through one of those with at most 1 flip; rows grow linearly with the classes.

No join is broadcast: staged tables of sorted keys shrink so much in their files that Spark takes them for small.

Defined results: a null or wordless text has fingerprint zero and is linked like any other. Rows without an id are
grouped too, and a component without any id has a null component_id. Repeated rows fall in one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.components import contract
from .common import join_few, row_keys, salted_join, slices, stage, text_of, without

WORDS, SEED, BITS, LIST = 3, 42, 3, 64
NEED = 8 - BITS  # positional bytes that a linked pair shares at least


def position_sets(size: int = 4, need: int = NEED) -> list[tuple[int, ...]]:
    """Sets of byte positions of which any ``need`` positions hold one whole, chosen greedily."""
    open_ = set(combinations(range(8), need))
    sets = list(combinations(range(8), size))
    chosen = []
    while open_:
        best = max(sets, key=lambda s: sum(set(s) <= set(o) for o in open_))
        chosen.append(best)
        open_ = {o for o in open_ if not set(best) <= set(o)}
    return chosen


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(line, SEED)
    starts = [0, *(ends[:-WORDS] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1:].tolist())), np.uint64, len(starts))
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = np.array([fingerprint(t) for t in part.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(found)], ["doc_id", "k1", "k2", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, fp): the fingerprint as a signed 64-bit integer, with the row's keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = text_of(docs)
    rows = docs.select("doc_id", text.alias("text"), *row_keys(docs["doc_id"], text))
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, k1 bigint, k2 bigint, fp bigint")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _postings(fps: DataFrame) -> DataFrame:
    """(key, fp): the number of the position set above the values of its bytes."""
    def key(no: int, positions: tuple[int, ...]) -> Column:
        value = F.lit(no).cast("bigint")
        for p in positions:
            value = value * 256 + _byte(F.col("fp"), p)
        return value
    return fps.select(F.explode(F.array(*[key(i, s) for i, s in enumerate(position_sets())])).alias("key"), "fp")


def _short_lists(rows: DataFrame) -> DataFrame:
    """Candidate pairs a < b out of short posting lists, by count filtering and verification."""
    a = rows.select("key", F.col("fp").alias("a"))
    b = rows.select("key", F.col("fp").alias("b"))
    pairs = a.join(b.hint("merge"), "key").where("a < b").select("a", "b")
    shared = sum(((_byte(F.col("a"), p) == _byte(F.col("b"), p)).cast("int") for p in range(8)), F.lit(0))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS
    return pairs.where(shared >= NEED).where(near).distinct()


def _long_lists(fps: DataFrame) -> DataFrame:
    """Links among classes of long lists: one row per flipped value, joined to a class at most one flip away."""
    one = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    few = F.array(F.lit(0).cast("bigint"), *[F.lit(x).cast("bigint") for x in one])
    near = fps.select("fp", F.explode(few).alias("_m")).select("fp", F.col("fp").bitwiseXOR(F.col("_m")).alias("value"))
    heads = near.groupBy("value").agg(F.min("fp").alias("head"))
    two = F.array(*[F.lit(x ^ y).cast("bigint") for x, y in combinations(one, 2)])
    far = fps.select("fp", F.explode(two).alias("_m")).select("fp", F.col("fp").bitwiseXOR(F.col("_m")).alias("value"))
    met = near.unionByName(far).join(heads.hint("merge"), "value").where("fp <> head")
    return met.select(F.least("fp", "head").alias("a"), F.greatest("fp", "head").alias("b")).distinct()


def links(fps: DataFrame, longest: int = LIST) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that hold every component together; each is a true link."""
    posted = stage(_postings(fps))
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stage(salted_join(posted, sizes, ["key"], ["fp"], salts=8))
    short = _short_lists(met.where(F.col("n") <= longest))
    hot = met.where(F.col("n") > longest).select("fp").distinct()
    hot = stage(hot)
    return short if hot.isEmpty() else short.unionByName(_long_lists(hot)).distinct()


def near_dedup(docs: DataFrame, longest: int = LIST) -> DataFrame:
    """(doc_id, fingerprint, component_id, first, k1, k2), one row per input row.

    ``first`` marks the row of a component with the smallest (doc_id, k1, k2), ids before nulls.
    """
    found = stage(fingerprints(docs))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    classes = stage(found.groupBy("fp").agg(F.min(order).alias("low"), F.count(F.lit(1)).alias("n")))
    edges = stage(links(classes.select("fp"), longest).select(F.col("b").alias("a"), F.col("a").alias("b")))
    if edges.isEmpty():
        named = classes.withColumn("root", F.col("fp"))
    else:
        roots = contract(edges, []).withColumnRenamed("node", "fp")
        named = classes.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # A class that is alone in its component has the lowest row itself; a component may hold most classes.
    lowest = named.groupBy("root").agg(F.min("low").alias("lowest"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    grouped = join_few(named, lowest, ["root"], ["fp"]).where("n > 1 or _c > 1").select(
        "fp", F.coalesce("lowest", "low").alias("lowest"))
    out = join_few(found, grouped, ["fp"], ["k1"])
    alone = F.col("lowest").isNull()
    return out.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("lowest.doc_id")).alias("component_id"),
        (alone | ((F.col("k1") == F.col("lowest.k1")) & (F.col("k2") == F.col("lowest.k2")))).alias("first"), "k1", "k2")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their component, unchanged."""
    return without(docs, stage(near_dedup(docs).where("not first").select("k1", "k2")))
