"""What the corpus operators share: table access, row keys, bounded slices of Arrow batches, staged joins."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import AnyStr

import pyarrow as pa
import pyarrow.compute  # noqa: F401  registers pa.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..scale import discard, salted_join, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(docs[column], F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """128 bits that name a row by id and text, so that null or repeated ids do not mix different texts."""
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, doc_id, F.lit(1)).alias("k2")]


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose keys are not among those of ``gone`` (k1, k2), all columns unchanged."""
    rows, one, two = _keyed(docs)
    same = (rows[one] == gone["k1"]) & (rows[two] == gone["k2"])
    # Always over sorted shuffles: the plan is the same at every size, and nothing grows into a broadcast.
    return rows.join(gone.hint("merge"), same, "left_anti").select(*_names(docs))


def once(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with a single row for each of the keys in ``repeated`` (k1, k2)."""
    rows, one, two = _keyed(docs)
    kept = rows.join(repeated, (rows[one] == repeated["k1"]) & (rows[two] == repeated["k2"]), "left_semi")
    return without(docs, repeated).unionByName(kept.dropDuplicates([one, two]).select(*_names(docs)))


def _names(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with its keys, and their names, which no column of ``docs`` has in any case."""
    taken = {c.lower() for c in docs.columns}
    end = next(e for e in map(str, range(1, len(taken) + 2)) if not {f"_key{e}a", f"_key{e}b"} & taken)
    k1, k2 = row_keys(docs["doc_id"], text_of(docs))
    return docs.select("*", k1.alias(f"_key{end}a"), k2.alias(f"_key{end}b")), f"_key{end}a", f"_key{end}b"


def join_few(big: DataFrame, few: DataFrame, on: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Left join with a table, unique on ``on``, that holds only keys which matter; hot keys are salted."""
    return salted_join(big, few, on, spread, "left", salts=8)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows with about ``limit`` bytes of text, so that memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.binary_length(column).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            total += n or 0
            if total >= limit:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def pieces(text: AnyStr, word: re.Pattern[AnyStr], size: int = 1 << 20) -> Iterator[AnyStr]:
    """Parts of a text of about ``size``, cut where no word is cut; ``word`` matches runs of a set of characters."""
    at = 0
    while len(text) - at > size:
        inside = word.match(text, at + size)
        end = inside.end() if inside else at + size
        yield text[at:end]
        at = end
    yield text[at:]


class Remembered(dict):
    """Values of a function of words; ``trim`` forgets them once they hold more than ``limit`` characters."""

    def __init__(self, function: Callable[[AnyStr], int], limit: int = 16_000_000) -> None:
        super().__init__()
        self.function, self.limit, self.held = function, limit, 0

    def __missing__(self, word: AnyStr) -> int:
        self.held += len(word)
        value = self[word] = self.function(word)
        return value

    def trim(self) -> None:
        if self.held > self.limit:
            self.clear()
            self.held = 0


__all__ = ["discard", "join_few", "lower_ascii", "once", "pieces", "Remembered", "row_keys", "salted_join", "slices", "stage", "table", "text_of", "without"]
