"""Removal of long repeated byte strings: sampled suffixes in q-gram buckets, refined by bucket identifiers.

Which ``SPAN``-byte strings start in two places? Sorting all suffixes would move the corpus many times over. Every
string of that length holds a q-gram whose hash is smallest in it, at the same offset wherever the string occurs, so
only suffixes at such anchors are bucketed; each start position belongs to the one anchor that is smallest in its
window.

1. Buckets: anchors by the identifier of their q-gram. Anchors alone in their bucket are done.
2. The starts of an anchor in a shared bucket are cut into blocks of ``STEP``, at the same offsets from every anchor of
   the bucket. What all windows of a block share refines its bucket: a block alone in it holds no repeated start.
3. Equal blocks in two places are repeated as a whole and are not looked at again; one of them stands for all.
4. Where a refined bucket holds different blocks, those that stand for themselves are refined start by start, by the
   identifiers at the offsets 0, q, ... of the window, together with one of each block already settled.

An identifier is a hash of the bytes and of where they stand from the anchor (two hashes where it decides), so that the
identifier at a later offset is known without a look-up. Rows per bucket grow with its members, never with their pairs.

Defined results: a null text is empty; texts shorter than ``SPAN`` bytes have no removal. Repeated rows are places of
their own, so all their long strings are repeated. Rows without an id are treated like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, row_keys, salted_join, slices, stage, text_of

SPAN, Q, STEP = 400, 160, 64
BLOCK = 1 << 19  # starts handled at once

_rng = np.random.default_rng(20240)
_TABLE = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = [int(x) | 5 for x in _rng.integers(1 << 60, 1 << 62, 2)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo 2^64 and of its inverse."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        base = _BASE[which] | 1
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, b, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _POWERS[which] = tuple(out)
    up, down = _POWERS[which]
    return up[:n], down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hash of any substring of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.up, down = _powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[which][data] * down[:-1], dtype=np.uint64, out=self.sums[1:])
        self.top = len(data)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        # Times a power that makes equal strings equal wherever they stand.
        shifted = (self.sums[end] - self.sums[start]) * self.up[start]
        return _mix(shifted + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def anchors(data: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Anchors (position, lowest and highest start, gram identifier) over documents laid end to end.

    ``first`` and ``last``: bounds of the documents. Starts are positions of whole windows inside one document.
    """
    width = SPAN - Q + 1
    for block in range(0, max(len(data) - SPAN + 1, 0), BLOCK):
        piece = data[block:block + BLOCK + SPAN - 1]
        n = len(piece) - SPAN + 1
        at = np.arange(len(piece) - Q + 1)
        h = Hashes(piece)
        gram = h.of(at, at + Q)
        # The value orders by hash, then by position: the lower bits hold the place in the block.
        value = (gram & ~np.uint64((1 << 21) - 1)) | at.astype(np.uint64)
        pad = -len(value) % width
        padded = np.append(value, np.full(pad, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()[:len(value)]
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()[:len(value)]
        low = np.minimum(behind[:n], ahead[width - 1:width - 1 + n])
        pick = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
        starts = np.arange(n)
        doc = np.searchsorted(first, starts + block, side="right") - 1
        good = starts + block + SPAN <= last[doc]
        starts, pick, doc = starts[good], pick[good], doc[good]
        if not len(starts):
            continue
        new = np.flatnonzero(np.concatenate([[True], (np.diff(pick) != 0) | (np.diff(starts) != 1) | (np.diff(doc) != 0)]))
        end = np.append(new[1:], len(starts)) - 1
        p = pick[new]
        yield p + block, starts[new] + block, starts[end] + block, gram[p].view(np.int64), doc[new]


def _laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    last = np.cumsum([len(r) for r in raw])
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], last[:-1]]), last


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, h, n): gram identifiers of a document's anchors."""
    for part in slices(batches):
        k1, k2 = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        data, first, last = _laid(part.column(2).to_pylist())
        for _, _, _, gram, doc in anchors(data, first, last):
            pairs = np.stack([doc, gram], axis=1)
            pairs, n = np.unique(pairs, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[pairs[:, 0]]), pa.array(k2[pairs[:, 0]]), pa.array(pairs[:, 1]), pa.array(n)], ["k1", "k2", "h", "n"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of starts at anchors in shared buckets: (k1, k2, core, f1, f2, size, firsts), equal ones of a text in one row."""
    for part in slices(batches):
        k1, k2 = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        data, first, last = _laid(part.column(2).to_pylist())
        lists = part.column(3)
        owner = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
        wanted = _pair(owner, lists.flatten().to_numpy())
        for p, lo, hi, gram, doc in anchors(data, first, last):
            keep = np.isin(_pair(doc, gram), wanted)
            p, lo, hi, gram, doc = (x[keep] for x in (p, lo, hi, gram, doc))
            if not len(p):
                continue
            low, high = (lo - p) // STEP, (hi - p) // STEP
            of = np.repeat(np.arange(len(p)), high - low + 1)
            no = np.arange(len(of)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[of]
            begin, end = np.maximum(p[of] + no * STEP, lo[of]), np.minimum(p[of] + no * STEP + STEP - 1, hi[of])
            base = int(lo.min())
            piece = data[base:int(hi.max()) + SPAN]
            one, two = Hashes(piece, 0), Hashes(piece, 1)
            place = gram[of].view(np.uint64) * np.uint64(0x9FB21C651E98DF25) + no.astype(np.uint64)
            inner = p[of] + no * STEP - base  # the windows of a block share [inner + STEP - 1, inner + SPAN)
            core = _mix(one.of(inner + STEP - 1, inner + SPAN) + place).view(np.int64)
            exact = place + ((begin - p[of]) * 1024 + (end - p[of])).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
            full = [_mix(x.of(begin - base, end - base + SPAN) + exact).view(np.int64) for x in (one, two)]
            order = np.lexsort((full[0], doc[of]))
            d, f = doc[of][order], full[0][order]
            head = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 0) | (np.diff(f) != 0)]))
            at = order[head]
            firsts = pa.ListArray.from_arrays(
                pa.array(np.append(head, len(order)).astype(np.int32)), pa.array((begin - first[doc[of]])[order]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[doc[of][at]]), pa.array(k2[doc[of][at]]), pa.array(core[at]), pa.array(full[0][at]), pa.array(full[1][at]),
                 pa.array((end - begin + 1)[at]), firsts], ["k1", "k2", "core", "f1", "f2", "size", "firsts"])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(b.view(np.uint64) ^ (a.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per start of the blocks that stand for themselves: the window's identifier, from those at 0, q, ... of it."""
    offsets = [*range(0, SPAN - Q, Q), SPAN - Q]
    for part in slices(batches):
        k1, k2 = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        for i, text in enumerate(part.column(2).to_pylist()):
            data = np.frombuffer(text.encode(), np.uint8)
            blocks = part.column(3)[i].values
            core, begin, size, n = (blocks.field(x).to_numpy(zero_copy_only=False) for x in ("core", "first", "size", "n"))
            of = np.repeat(np.arange(len(size)), size)
            rel = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            at = begin[of] + rel
            found = [_pair(np.zeros(len(at)), core[of]) for _ in (0, 1)]
            for w in (0, 1):
                hashes = Hashes(data, w)
                for o in offsets:
                    found[w] = _mix(found[w] * np.uint64(31) + hashes.of(at + o, at + o + Q))
            for cell, value in zip(out, (np.full(len(at), k1[i]), np.full(len(at), k2[i]), at, found[0].view(np.int64), found[1].view(np.int64), n[of] == 1)):
                cell.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["k1", "k2", "at", "w1", "w2", "open"])


def _prepared(docs: DataFrame) -> DataFrame:
    """Every row with its size and digest, and its text where it holds a gram that is found elsewhere."""
    text = text_of(docs)
    rows = docs.select("doc_id", *row_keys(docs["doc_id"], text), text.alias("text"))
    grams = stage(rows.where(F.octet_length("text") >= SPAN).select("k1", "k2", "text").mapInArrow(
        _buckets, "k1 bigint, k2 bigint, h bigint, n bigint"))
    shared = grams.groupBy("h").agg(F.sum("n").alias("total")).where("total > 1").select("h")
    # A gram shared by very many documents is spread over salted keys.
    met = salted_join(grams, shared, ["h"], ["k1"], salts=4).groupBy("k1", "k2").agg(F.collect_set("h").alias("hs"))
    out = stage(rows.join(met, ["k1", "k2"], "left").select(
        "doc_id", "k1", "k2", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha"),
        F.when(F.col("hs").isNotNull(), F.col("text")).alias("text"), "hs"))
    discard(grams)
    return out


def repeated_starts(held: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(k1, k2, firsts, size): runs of ``size`` starts whose ``SPAN``-byte strings also start elsewhere.

    And the staged tables that they are read from.
    """
    key, full, window = ["k1", "k2"], ["core", "f1", "f2"], ["w1", "w2"]
    blocks = stage(held.select("k1", "k2", "text", "hs").mapInArrow(
        _blocks, "k1 bigint, k2 bigint, core bigint, f1 bigint, f2 bigint, size bigint, firsts array<bigint>"))
    rep = F.struct("k1", "k2", F.col("firsts")[0].alias("first"), "size")
    distinct = stage(blocks.groupBy(*full).agg(F.sum(F.size("firsts")).alias("n"), F.min(rep).alias("rep")))
    whole = salted_join(blocks, distinct.where("n > 1").select(*full), full, ["k1"], salts=4).select(*key, "firsts", "size")
    mixed = distinct.groupBy("core").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
    alone = distinct.join(mixed.select("core"), "core").select("rep.*", "core", "n").groupBy(*key).agg(
        F.collect_list(F.struct("core", "first", "size", "n")).alias("blocks"))
    # Repeated rows hold the same blocks; one of them is read.
    one = held.select("k1", "k2", "text").join(alone, key).dropDuplicates(key)
    starts = stage(one.select(*key, "text", "blocks").mapInArrow(
        _starts, "k1 bigint, k2 bigint, at bigint, w1 bigint, w2 bigint, open boolean"))
    twice = starts.groupBy(*window).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*window)
    single = salted_join(starts.where("open"), twice, window, ["k1", "at"], salts=4).groupBy(*key).agg(
        F.collect_list("at").alias("firsts")).select(*key, "firsts", F.lit(1).cast("bigint").alias("size"))
    return whole.unionByName(single), [blocks, distinct, starts]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        out: list[list] = [[], [], [], [], []]
        for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
            raw = np.frombuffer(text.encode(), np.uint8)
            edge = np.zeros(len(raw) + 1, np.int64)
            for r in ranges:
                first = np.array(r["firsts"], np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + r["size"] - 1 + SPAN, -1)
            gone = np.cumsum(edge)[:-1] > 0
            turns = np.flatnonzero(np.diff(gone, prepend=False, append=False))
            removed = ",".join(f"{a}:{b}" for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()))
            left = raw[~gone].tobytes()
            for cell, value in zip(out, (int(gone.sum()), len(turns) // 2, hashlib.sha256(left).hexdigest(), left, removed)):
                cell.append(value)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
             pa.array(out[3], pa.binary()), pa.array(out[4], pa.string())], ["doc_id", "n_removed", "n_spans", "kept_sha256", "kept", "removed"])


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, removed), one row per input row.

    ``kept``: the bytes left, null where nothing is removed; ``removed``: the runs cut out as start:end, in bytes, end exclusive.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _prepared(docs)
    held = rows.where("text is not null")
    found, used = repeated_starts(held)
    ranges = stage(found.groupBy("k1", "k2").agg(F.collect_list(F.struct("firsts", "size")).alias("ranges")))
    for step in used:
        discard(step)
    cut = held.join(ranges, ["k1", "k2"]).select("doc_id", "text", "ranges").mapInArrow(
        _cut, f"doc_id {kind}, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, removed string").select(
        "doc_id", (F.octet_length("kept") + F.col("n_removed")).alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", "kept", "removed")
    none = F.lit(0).cast("bigint")
    whole = rows.join(ranges.select("k1", "k2"), ["k1", "k2"], "left_anti").select(
        "doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.col("sha").alias("kept_sha256"),
        F.lit(None).cast("binary").alias("kept"), F.lit("").alias("removed"))
    return whole.unionByName(cut)
