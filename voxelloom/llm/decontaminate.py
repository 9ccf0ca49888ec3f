"""Benchmark decontamination by spaced-seed hashing.

Masks fix which positions of a short window of tokens must agree; the others are ignored. The masked windows of the
benchmark are hashed, documents are searched for the same hashes, and every hit is verified along its diagonal. A
document is contaminated by an item if any stretch of ``LEAST`` tokens or more (or the whole item, if that is shorter)
has at least ``IDENTITY`` of them equal. The stretch reported is the best-scoring one, a match +1 and a substitution -3,
where that is long and equal enough; else the one with the most equal tokens.

The masks lose no such stretch: one of 26 tokens or more has a part of 13 to 25 that is equal enough, and each pattern of
substitutions in 13 to 25 tokens leaves a window of one of ``MASKS`` untouched. Shorter items have masks of their own,
which travel only if there are items of that length.

A filter of a fixed number of bits, made from all benchmark hashes, travels to the tasks that read documents. Only
windows that pass it are joined with the benchmark's hashes, so document text itself is never shuffled. The join is over
distinct hashes of a region and distinct hashes of an item, so repeated words make no pairs of positions; a hash that very
many regions hold is salted. Which diagonals a region and an item share is then found where both lie side by side.

Defined results: tokens are runs of word characters in lower case; a null or empty text has none. Repeated documents are reported each under their id; rows without an id are
searched too and reported with a null id. Repeated items are reported each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  registers pa.compute
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Remembered, row_keys, salted_join, slices, stage, text_of, without

MASKS = ("11101011", "1101001011", "1110010101", "1011000110011", "111111")
LEAST, IDENTITY, MISMATCH = 13, 0.8, 3
FILTER_BITS = 25  # each hash sets two of 2^25 bits
NEAR = 64  # hits closer than this share a region; regions keep as many tokens on either side, at least
MEETINGS = 1 << 20  # pairs of positions looked at together
SALTS = 8
FACTORS = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0x9E3779B97F4A7C14) | np.uint64(1)

_WORD = re.compile(r"\w+").findall
_known = Remembered(lambda word: xxhash.xxh3_64_intdigest(word.encode()))


def tokens(text: str) -> np.ndarray:
    """One 64-bit number per token."""
    words = _WORD(text.lower())
    _known.trim()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def short_masks(n: int) -> set[str]:
    """Masks of which one fits any alignment of a whole item of ``n`` < ``LEAST`` tokens that is equal enough.

    The item is cut into more parts than it may have substitutions; a mask leaves out as many parts as those can spoil.
    """
    spoilt = sum(k < n and n - k >= IDENTITY * n for k in range(1, LEAST))
    parts = {0: 1, 1: 3 if n > 5 else n}.get(spoilt, spoilt + 2)
    part = [i * parts // n for i in range(n)] if n else []
    return {"".join("01"[p not in gone] for p in part).strip("0") for gone in combinations(range(parts), spoilt)} - {""}


def masks_for(lengths: Iterable[int]) -> tuple[str, ...]:
    """``MASKS``, and those of items of the given lengths below ``LEAST``."""
    return MASKS + tuple(sorted(set().union(*map(short_masks, lengths)) - set(MASKS)))


def masked(ids: np.ndarray, masks: tuple[str, ...] = MASKS) -> list[np.ndarray]:
    """Per mask the hash of the window at every position: a sum of the tokens, each times an odd factor of its place."""
    out = []
    for mask in masks:
        n = max(len(ids) - len(mask) + 1, 0)
        h = np.full(n, int(mask, 2), dtype=np.uint64)
        for i, bit in enumerate(mask):
            if bit == "1":
                h += ids[i:i + n] * FACTORS[i]
        h *= FACTORS[63]
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


def seeds_of(item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of an item's masked windows."""
    found = masked(item, masks_for([len(item)] if len(item) < LEAST else []))
    return np.concatenate(found), np.concatenate([np.arange(len(h)) for h in found])


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, row, ids, seeds): tokens and distinct hashes of masked windows of each benchmark row."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = [tokens(t) for t in part.column(2).to_pylist()]
            seeds = [np.unique(seeds_of(x)[0]) for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(ids), _lists(seeds)],
                                             ["item_id", "row", "ids", "seeds"])

    rows = benchmark.select("item_id", F.monotonically_increasing_id().alias("row"), text_of(benchmark).alias("text"))
    return rows.mapInArrow(run, f"item_id {kind}, row bigint, ids array<bigint>, seeds array<bigint>")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.view(np.int64) for x in arrays], pa.list_(pa.int64()))


def _filter(seeds: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bit map over two parts of all hashes: 2^bits bits, however many hashes there are."""
    one = F.shiftrightunsigned("h", 64 - bits)
    two = F.shiftrightunsigned("h", 64 - 2 * bits).bitwiseAND(F.lit((1 << bits) - 1))
    words = seeds.select(F.explode(F.array(one, two)).alias("place")).select(
        F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bit"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _regions(docs: DataFrame, passing, reach: int, masks: tuple[str, ...], bits: int = FILTER_BITS) -> DataFrame:
    """Stretches of documents around windows that pass the filter: (doc_id, k1, k2, hit, start, ids, hashes, places).

    The documents of a slice are hashed as one array; windows that reach over a document's end are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = np.unpackbits(passing.value, bitorder="little").astype(bool)
        for part in slices(batches):
            texts = [tokens(t) for t in part.column(3).to_pylist()]
            ends = np.cumsum([len(x) for x in texts])
            ids = np.concatenate(texts)
            at, hashes = [], []
            for mask, h in zip(masks, masked(ids, masks)):
                hit = np.flatnonzero(present[(h >> np.uint64(64 - bits)).astype(np.int64)])
                hit = hit[present[((h[hit] >> np.uint64(64 - 2 * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)]]
                hit = hit[hit + len(mask) <= ends[np.searchsorted(ends, hit, "right")]]
                at.append(hit)
                hashes.append(h[hit])
            pos, h = np.concatenate(at), np.concatenate(hashes)
            order = np.argsort(pos, kind="stable")
            pos, h = pos[order], h[order]
            doc = np.searchsorted(ends, pos, "right")
            fresh = np.flatnonzero((np.diff(pos) > NEAR) | (np.diff(doc) > 0)) + 1
            cells: list[list] = [[], [], [], [], [], []]
            for cut in np.split(np.arange(len(pos)), fresh) if len(pos) else []:
                of = int(doc[cut[0]])
                base = int(ends[of]) - len(texts[of])
                start = max(int(pos[cut[0]]) - reach, base)
                stop = min(int(pos[cut[-1]]) + reach + NEAR, int(ends[of]))
                for cell, value in zip(cells, (of, int(pos[cut[0]]) - base, start - base, ids[start:stop], h[cut],
                                               (pos[cut] - start).astype(np.int64))):
                    cell.append(value)
            row = pa.array(cells[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i).take(row) for i in range(3)), pa.array(cells[1], pa.int64()), pa.array(cells[2], pa.int64()),
                 *map(_lists, cells[3:])],
                ["doc_id", "k1", "k2", "hit", "start", "ids", "hashes", "places"])

    text = text_of(docs)
    return docs.select("doc_id", *row_keys(docs["doc_id"], text), text.alias("text")).mapInArrow(
        run, f"doc_id {kind}, k1 bigint, k2 bigint, hit bigint, start bigint, ids array<bigint>, hashes array<bigint>, places array<bigint>")


def diagonals(hashes: np.ndarray, places: np.ndarray, item: np.ndarray, size: int) -> np.ndarray:
    """Offsets, ascending, at which a region of ``size`` tokens shares a masked window with an item.

    Memory follows the two lengths; pairs of positions are looked at ``MEETINGS`` at a time.
    """
    known, at = seeds_of(item)
    order = np.argsort(known, kind="stable")
    known, at = known[order], at[order]
    left = np.searchsorted(known, hashes, "left")
    many = np.searchsorted(known, hashes, "right") - left
    seen = np.zeros(size + len(item) + 1, dtype=bool)
    total = np.cumsum(many)
    for cut in np.split(np.arange(len(many)), np.flatnonzero(np.diff(total // MEETINGS)) + 1):
        n = many[cut]
        place = np.arange(n.sum()) + np.repeat(left[cut] - (np.cumsum(n) - n), n)
        seen[np.repeat(places[cut], n) - at[place] + len(item)] = True
    return np.flatnonzero(seen) - len(item)


def stretch(a: np.ndarray, b: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """Best-scoring stretch of ``a[i]`` against ``b[i - diagonal]``: (start in a, tokens, equal tokens)."""
    low, high = max(diagonal, 0), min(len(a), len(b) + diagonal)
    same = a[low:high] == b[low - diagonal:high - diagonal]
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH))])
    gain = score - np.minimum.accumulate(score)
    end = int(gain.argmax())
    floor = score[:end + 1]
    begin = int(np.flatnonzero(floor == floor.min())[-1])
    return low + begin, end - begin, int(same[begin:end].sum())


def accepted(a: np.ndarray, b: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """A stretch like ``stretch``'s that is long and equal enough, or None if the diagonal has none."""
    least = min(LEAST, len(b))
    at, n, equal = stretch(a, b, diagonal)
    if n and n >= least and equal >= IDENTITY * n:
        return at, n, equal
    low, high = max(diagonal, 0), min(len(a), len(b) + diagonal)
    if not 0 < least <= high - low:
        return None
    same = a[low:high] == b[low - diagonal:high - diagonal]
    count = np.concatenate([[0], np.cumsum(same)])
    over = 5 * count - 4 * np.arange(len(count))  # does not fall from begin to end where 4 of 5 tokens are equal
    begin = np.searchsorted(-np.minimum.accumulate(over), -over[least:])  # the first place from which it does not
    end = np.arange(least, len(over))
    begin, end = begin[begin <= end - least], end[begin <= end - least]
    if not len(end):
        return None
    # Leading substitutions are left out as far as the length allows.
    first = np.append(np.flatnonzero(same), len(same))
    begin = np.minimum(first[np.searchsorted(first, begin)], end - least)
    equal = count[end] - count[begin]
    best = np.lexsort((begin, end - begin, -equal))[0]
    return low + int(begin[best]), int(end[best] - begin[best]), int(equal[best])


def best_overlap(a: np.ndarray, b: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> tuple[int, int, int] | None:
    """The stretch with the most equal tokens over all diagonals; of equal ones the shorter, then the earlier."""
    best = None
    for diagonal in diagonals(hashes, places, b, len(a)).tolist():
        if found := accepted(a, b, diagonal):
            at, n, equal = found
            if best is None or (equal, -n, -at) > (best[2], -best[1], -best[0]):
                best = found
            if equal == len(b) == n:  # later diagonals have no more, and start later
                break
    return best


def _verified(pairs: DataFrame, doc_kind: str, item_kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            ids, hashes, places, items = (batch.column(c) for c in ("ids", "hashes", "places", "item_ids"))
            for i in range(batch.num_rows):
                a, h, p, b = (column[i].values.to_numpy() for column in (ids, hashes, places, items))
                if best := best_overlap(a.view(np.uint64), b.view(np.uint64), h.view(np.uint64), p):
                    rows.append(i)
                    found.append((*best, len(b)))
            if rows:
                kept = batch.take(pa.array(rows))
                at, n, equal, size = (pa.array(c, pa.int64()) for c in zip(*found))
                first = pa.compute.add(kept.column("start"), at)
                yield pa.RecordBatch.from_arrays(
                    [*(kept.column(c) for c in ("doc_id", "k1", "k2", "item_id")), first, n, equal, size], NAMES)

    return pairs.mapInArrow(run, f"doc_id {doc_kind}, k1 bigint, k2 bigint, item_id {item_kind}, first_token bigint, "
                                 "n_tokens bigint, n_equal bigint, item_tokens bigint")


NAMES = ["doc_id", "k1", "k2", "item_id", "first_token", "n_tokens", "n_equal", "item_tokens"]


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every verified overlap: (doc_id, k1, k2, item_id, first_token, n_tokens, n_equal, item_tokens), best per item."""
    spark = docs.sparkSession
    items = stage(_items(benchmark))
    seeds = items.select("row", F.explode("seeds").alias("h"))
    size = F.size("ids")
    longest, short = items.agg(F.max(size), F.collect_set(F.when(size < LEAST, size))).first()
    longest = longest or 0
    passing = spark.sparkContext.broadcast(np.packbits(_filter(seeds), bitorder="little"))
    regions = stage(_regions(docs, passing, longest + NEAR, masks_for(short)))
    region = ["k1", "k2", "hit"]  # its first hit names a region of a text
    hits = regions.select(*region, F.explode(F.array_distinct("hashes")).alias("h"))
    # Few of the benchmark's hashes occur in documents at all; only these are repeated for the salts.
    met = stage(seeds.join(hits.select("h").distinct(), "h", "left_semi"))
    lines = salted_join(hits, met, ["h"], region, salts=SALTS).select(*region, "row").distinct()
    known = items.select("row", "item_id", F.col("ids").alias("item_ids")).join(met.select("row").distinct(), "row", "left_semi")
    pairs = salted_join(lines, known, ["row"], region, salts=SALTS).join(regions.dropDuplicates(region), region)
    doc_kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (items, "item_id")))
    found = _verified(pairs.select("doc_id", "k1", "k2", "start", "ids", "hashes", "places", "item_id", "item_ids"), doc_kind, item_kind)
    best = found.groupBy("doc_id", "k1", "k2", "item_id").agg(
        F.max(F.struct(
            "n_equal", (-F.col("n_tokens")).alias("shorter"), (-F.col("first_token")).alias("earlier"), "item_tokens")).alias("b"))
    return best.select("doc_id", "k1", "k2", "item_id", (-F.col("b.earlier")).alias("first_token"),
                       (-F.col("b.shorter")).alias("n_tokens"), "b.n_equal", "b.item_tokens")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_token, n_tokens, n_equal, item_tokens, identity): one row per document and item."""
    return overlaps(docs, benchmark).drop("k1", "k2").withColumn("identity", F.col("n_equal") / F.col("n_tokens"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any verified overlap, unchanged."""
    return without(docs, stage(overlaps(docs, benchmark).select("k1", "k2").distinct()))
