"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

Words of the vocabulary are put into blocked Bloom filters, one per word length. Every word's deletions and replacements
are probed against the filters of the next shorter and of its own length; an insertion is the other word's deletion, and
of two words that differ in one place only the smaller is replaced. What passes a filter is shuffled to an exact join with
the vocabulary, which removes false positives. Edits are hashed without being built: a word's hash is a sum over its
positions, so that an edit changes it by prefix and suffix sums.

Filters are broadcast in rounds of at most ``FILTER_BYTES``: a vocabulary of any size is probed, filter part by filter part.

Defined results: a null text has no words, a null id enters the hash as nothing. Repeated rows count again. Words are
compared by code points; À to ÿ keep their case. A word without a near one has n_near 0, no form, and is its own root.
Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import pieces, slices, stage, text_of

LETTER = "[a-zÀ-ÿ]"  # after A-Z have become a-z
RUN = re.compile(LETTER + "+")
DROPPED = 31  # one run in so many loses a code point
SHORTEST, LEAST, RATIO = 7, 2, 10
LONG = 64  # longer words share one filter
BITS, LANES = 16, 8  # of a filter: bits for a word, 64-bit words in a block
FILTER_BYTES = 32 << 20
PROBES = 1 << 19  # edits that are hashed at a time
PENDING = 16 << 20  # characters of words that a task counts before it passes them on
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
    return h ^ (h >> np.uint64(33))


CODE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)  # of each code point up to ÿ
_SALTS = mix(np.arange(257, 257 + LANES, dtype=np.uint64) * _ODD) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _ODD)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


# ---- words -----------------------------------------------------------------------------------

def kept_word(prefix: int, run: str) -> str:
    """A run's word; ``prefix`` is the checksum of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), prefix)
    at = h % len(run)
    return run[:at] + run[at + 1:] if h % DROPPED == 0 else run


def _counted(shortest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    runs = re.compile(f"{LETTER}{{{shortest},}}")  # a run's word is no longer than the run

    def rows(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for part in slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                own: Counter[str] = Counter()
                for piece in pieces(text.encode().lower().decode(), RUN):
                    own.update(runs.findall(piece))
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found, n in own.items():
                    word = kept_word(prefix, found)
                    if len(word) >= shortest:
                        total[word] += n
            if sum(map(len, total)) > PENDING:
                yield rows(total)
                total.clear()
        yield rows(total)
    return run


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n)"""
    rows = docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(_counted(shortest), "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---- filters ---------------------------------------------------------------------------------

def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words of one length, and their code points as a matrix."""
    sizes = np.array([len(w) for w in words], np.int64)
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        step = max(1, PROBES // n)
        for i in range(0, len(at), step):
            some = at[i:i + step]
            raw = "".join(words[j] for j in some).encode("latin-1")
            yield some, np.frombuffer(raw, np.uint8).reshape(len(some), n)


def hashes(codes: np.ndarray) -> np.ndarray:
    return (CODE[codes] * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def block_of(mixed: np.ndarray, blocks: int) -> np.ndarray:
    return ((mixed >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def lane_bit(mixed: np.ndarray, lane: int) -> np.ndarray:
    """The bit of a lane that a hash sets, as a mask."""
    return np.uint64(1) << ((mixed * _SALTS[lane]) >> np.uint64(58))


def shard(length: int) -> int:
    return min(length, LONG)


def _set_bits(blocks: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, codes in by_length(batch.column(0).to_pylist()):
                h, of = mix(hashes(codes)), shard(codes.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), of)), pa.array(block_of(h, blocks[of]).view(np.int64)),
                     *(pa.array(lane_bit(h, i).view(np.int64)) for i in range(LANES))], ["shard", "block", *_LANES])
    return run


_LANES = [f"lane{i}" for i in range(LANES)]


def rounds(sizes: dict[int, int], most: int = FILTER_BYTES) -> tuple[dict[int, int], list[list[tuple[int, int, int]]]]:
    """Blocks of each shard of so many words, and per round the (shard, first block, end) whose bytes fit ``most`` together."""
    blocks = {of: max(1, -(-n * BITS // (64 * LANES))) for of, n in sizes.items()}
    out, room, each = [], 0, max(1, most // (8 * LANES))
    for of, n in sorted(blocks.items()):
        first = 0
        while first < n:
            if not room:
                out.append([])
                room = each
            take = min(room, n - first)
            out[-1].append((of, first, first + take))
            first, room = first + take, room - take
    return blocks, out


class Filter:
    """A range of blocks of one shard's filter."""

    def __init__(self, blocks: int, first: int, end: int) -> None:
        self.blocks, self.first, self.lanes = blocks, first, np.zeros((end - first, LANES), np.uint64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be in it."""
        mixed = mix(h)
        block = block_of(mixed, self.blocks).astype(np.int64) - self.first
        at = np.flatnonzero((block >= 0) & (block < len(self.lanes)))
        for lane in range(LANES):
            at = at[(self.lanes[block[at], lane] & lane_bit(mixed[at], lane)) != 0]
        return at


def filters(bits: DataFrame, blocks: dict[int, int], parts: list[tuple[int, int, int]]) -> dict[int, Filter]:
    """The filters of one round, gathered at the driver: no more bytes than the round's bound."""
    wanted = F.lit(False)
    for of, first, end in parts:
        wanted = wanted | ((F.col("shard") == of) & F.col("block").between(first, end - 1))
    made = {of: Filter(blocks[of], first, end) for of, first, end in parts}
    found = bits.where(wanted).groupBy("shard", "block").agg(*[F.bit_or(c).alias(c) for c in _LANES]).toArrow()
    of, at = (found.column(c).to_numpy() for c in ("shard", "block"))
    lanes = np.stack([found.column(c).to_numpy().view(np.uint64) for c in _LANES], axis=1) if len(of) else None
    for k, f in made.items():
        mine = np.flatnonzero(of == k)
        if len(mine):
            f.lanes[at[mine] - f.first] = lanes[mine]
    return made


# ---- edits -----------------------------------------------------------------------------------

def replaced(codes: np.ndarray, alphabet: np.ndarray, own: Filter) -> Iterator[tuple[int, bytes]]:
    """(row, edit) for replacements by a greater code point that pass the filter."""
    n, size = codes.shape
    power, h = _powers(size), hashes(codes)
    step = max(1, PROBES // max(1, n * len(alphabet)))
    for p in range(0, size, step):
        part = codes[:, p:p + step]
        row, at, new = np.nonzero(alphabet[None, None, :] > part[:, :, None])
        old, by = part[row, at], alphabet[new]
        for i in own.holds(h[row] + (CODE[by] - CODE[old]) * power[p + at]).tolist():
            edit = bytearray(codes[row[i]])
            edit[p + at[i]] = by[i]
            yield int(row[i]), bytes(edit)


def shortened(codes: np.ndarray, below: Filter) -> Iterator[tuple[int, bytes]]:
    """(row, edit) for deletions that pass the filter; of equal neighbours only the first is deleted."""
    size = codes.shape[1]
    term, power = CODE[codes], _powers(size)
    before = np.cumsum(term * power, axis=1, dtype=np.uint64)
    # What follows a deletion moves one place down: its sum runs over powers that are one less.
    after = np.cumsum((term[:, 1:] * power[:-1])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    h = np.zeros_like(before)
    h[:, 1:] += before[:, :-1]
    h[:, :-1] += after
    fresh = np.ones(codes.shape, bool)
    fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, at = np.nonzero(fresh)
    for i in below.holds(h[row, at]).tolist():
        word = codes[row[i]].tobytes()
        yield int(row[i]), word[:at[i]] + word[at[i] + 1:]


def _probe(alphabet: np.ndarray, made: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = made.value
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for some, codes in by_length(words):
                own, below = have.get(shard(codes.shape[1])), have.get(shard(codes.shape[1] - 1))
                found = [*(replaced(codes, alphabet, own) if own else ()), *(shortened(codes, below) if below else ())]
                rows = [some[i] for i, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[i] for i in rows], pa.string()), pa.array(counts[rows] if rows else [], pa.int64()),
                     pa.array([e.decode("latin-1") for _, e in found], pa.string())], ["word", "n", "near"])
    return run


def near_words(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, near, near_n) of staged words (word, n): every ordered pair of words one edit apart."""
    spark = words.sparkSession
    of = F.least(F.length("word"), F.lit(LONG))
    sizes = {r["of"]: r["count"] for r in words.groupBy(of.alias("of")).count().collect()}
    blocks, parts = rounds(sizes, filter_bytes)
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint8)
    lanes = ", ".join(f"{c} bigint" for c in _LANES)
    bits = stage(words.select("word").mapInArrow(_set_bits(blocks), f"shard bigint, block bigint, {lanes}"))
    passed = None
    for part in parts:
        made = spark.sparkContext.broadcast(filters(bits, blocks, part))
        held = sorted({k for k, *_ in part})
        probed = words.where(of.isin(held) | F.least(F.length("word") - 1, F.lit(LONG)).isin(held)).mapInArrow(
            _probe(alphabet, made), "word string, n bigint, near string")
        found = stage(probed)
        made.destroy()
        passed = found if passed is None else passed.unionByName(found)
    if passed is None:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    exact = stage(passed.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near"))
    back = exact.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return exact.select("word", "near", "near_n").unionByName(back)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of staged rows (word, form): forms followed to the last, in doubled steps.

    Counts grow at least by the ratio from word to form, so a chain of 64-bit counts ends within a few rounds.
    """
    hops = forms.select("word", F.col("form").alias("root"))
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stage(hops.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        hops = step.select("word", "root")
        if step.where("next is not null").isEmpty():
            return hops


def group_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO,
                   filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word."""
    words = stage(vocabulary(docs, shortest, least))
    best = near_words(words, filter_bytes).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    rows = words.join(best, "word", "left")
    ahead = -F.col("best.n") >= ratio * F.col("n")
    named = stage(rows.select(
        "word", F.when(ahead, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(ahead, -F.col("best.n")).alias("form_n")))
    last = roots(named.where("form is not null").select("word", "form"))
    return named.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
