"""Byte-level BPE with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary gives each pre-token one slot; if the bytes in that slot are
the pre-token's, its rank is the answer. Second tier: all other pre-tokens are merged over a linked list of byte
pieces with a heap of candidate merges, in n log n. Pre-tokens that repeat within a task are remembered up to a
fixed number, which changes no result.

Defined results: a null text is an empty one and has no tokens; both digests are then those of no bytes. Repeated
rows and rows without an id are encoded like any other; further columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import slices, text_of

RANKS = "byte_bpe_multi_50k.tiktoken"
REMEMBERED = 200_000
SEEDS = 256  # tried at once for a bucket of the perfect hash


class PerfectHash:
    """Minimal perfect hash by displacement: keys fall in buckets, each bucket has a seed that spreads its keys.

    Buckets are placed from the largest down; a bucket of one key stores its slot, as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        hashes = self._hashes(keys)
        if len(np.unique(hashes)) != n:
            raise ValueError("keys must differ")
        self.buckets = max(1, n // 4)
        self.seeds = np.zeros(self.buckets, dtype=np.int64)
        slot = np.full(n, -1, dtype=np.int64)
        order = np.argsort(hashes % np.uint64(self.buckets), kind="stable")
        number, first, size = np.unique(hashes[order] % np.uint64(self.buckets), return_index=True, return_counts=True)
        for i in np.argsort(-size, kind="stable"):
            inside = order[first[i]:first[i] + size[i]]
            if size[i] == 1:
                break
            seeds = np.arange(SEEDS, dtype=np.int64)[:, None]
            while True:
                tried = self._spread(hashes[inside][None, :], seeds)
                row = np.sort(tried, axis=1)
                good = np.flatnonzero((slot[tried] < 0).all(axis=1) & (row[:, 1:] != row[:, :-1]).all(axis=1))
                if len(good):
                    break
                seeds = seeds + SEEDS
            places, seed = tried[good[0]], seeds[good[0], 0]
            slot[places], self.seeds[number[i]] = inside, seed
        single = np.sort(order[first[size == 1]])
        free = np.flatnonzero(slot < 0)
        slot[free] = single
        self.seeds[(hashes[single] % np.uint64(self.buckets)).astype(np.int64)] = -1 - free
        self.rank_of_slot = slot
        self.key_of_slot = [keys[i] for i in slot]

    @staticmethod
    def _hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _spread(self, hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ (seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> list[int]:
        """Index of each key in the list given at the start, or -1; the stored bytes are compared."""
        if not keys:
            return []
        hashes = self._hashes(keys)
        seeds = self.seeds[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(seeds < 0, -1 - seeds, self._spread(hashes, seeds)).tolist()
        stored, rank = self.key_of_slot, self.rank_of_slot
        return [int(rank[s]) if stored[s] == k else -1 for s, k in zip(slots, keys)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Merges neighbours of lowest rank first, leftmost among equals."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = after[i] if end[i] else n
        if not end[i] or j >= n or end[j] != stop:
            continue  # one of its parts has been merged since
        end[i], end[j], after[i] = stop, 0, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get(piece[i:end[after[j]]])) is not None:
                heappush(heap, (r, i, end[after[j]]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heappush(heap, (r, p, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = after[i]
    return tuple(ids)


class Codec:
    """Encodes and decodes with the ranks of one vocabulary file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.vocabulary = [base64.b64decode(a) for a, _ in pairs]
        self.ids = [int(b) for _, b in pairs]
        self.ranks = dict(zip(self.vocabulary, self.ids))
        self.bytes_of = {i: v for v, i in self.ranks.items()}
        self.words = PerfectHash(self.vocabulary)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, tokens: list[str]) -> None:
        """Resolves the pre-tokens that are not remembered."""
        known = self.known
        new = [t for t in set(tokens) if t not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list(set(tokens))
        raw = [t.encode() for t in new]
        for token, piece, place in zip(new, raw, self.words.find(raw)):
            known[token] = (self.ids[place],) if place >= 0 else merge(piece, self.ranks)

    def encode(self, text: str) -> list[int]:
        tokens = self.split(text)
        self.learn(tokens)
        return list(chain.from_iterable(map(self.known.__getitem__, tokens)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256, exact) per row; ``exact``: decoding gave the text's bytes.

    ``path`` names the vocabulary file, present on every executor.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in slices(batches, limit=1_000_000):
            cells: list[list] = [[], [], [], [], []]
            for text in part.column(1).to_pylist():
                ids = own.encode(text)
                back = own.decode(ids)
                packed = np.array(ids, dtype="<u4").tobytes()
                row = (packed, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest(), back == text.encode())
                for cell, value in zip(cells, row):
                    cell.append(value)
            raw = pa.array(cells[0], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), raw, pa.array(cells[1], pa.int64()), pa.array(cells[2], pa.string()),
                 pa.array(cells[3], pa.string()), pa.array(cells[4], pa.bool_())],
                ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from the packed ids that ``encode`` made."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in slices(batches, text="ids"):
            texts = [own.decode(np.frombuffer(x or b"", dtype="<u4").tolist()).decode() for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
