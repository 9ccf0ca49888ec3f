"""Union, difference and intersection of voxel sets that are given as runs, without expanding them.

A set is a table of runs (keys, st, len), disjoint within a key and a set. The ends of all runs are swept in order: two running
sums tell which of the sets cover the stretch up to an end, and where the answer changes a run of the result begins or
ends. The sweep goes block by block through ``scale.scan``, so a key may have any number of runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import SCAN_BLOCK, scan, stage

Holds = Callable[[Column, Column], Column]


def combine(a: DataFrame, b: DataFrame, keys: Sequence[str], holds: Holds, block: int = SCAN_BLOCK) -> DataFrame:
    """Maximal runs (keys, st, len) of the positions for which ``holds(in a, in b)``; it must be false for neither."""
    keys = list(keys)

    def ends(runs: DataFrame, mine: str, other: str) -> DataFrame:
        at = F.array(F.struct(F.col("st").alias("pos"), F.lit(1).alias("n")), F.struct((F.col("st") + F.col("len")).alias("pos"), F.lit(-1).alias("n")))
        return runs.where(F.col("len") > 0).select(*keys, F.explode(at).alias("e")).select(
            *keys, F.col("e.pos").cast("bigint").alias("pos"), F.col("e.n").alias(mine), F.lit(0).alias(other))

    moves = ends(a, "_a", "_b").unionByName(ends(b, "_b", "_a")).groupBy(*keys, "pos").agg(
        F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).where("_a <> 0 or _b <> 0")
    swept = scan(stage(moves), keys, "pos", {"_in_a": F.col("_a"), "_in_b": F.col("_b")}, block=block)
    now = holds(F.col("_in_a") > 0, F.col("_in_b") > 0)
    until = holds(F.col("_in_a") - F.col("_a") > 0, F.col("_in_b") - F.col("_b") > 0)
    # Starts and ends of the result alternate; two make a run.
    edges = stage(swept.where(now != until).select(*keys, "pos"))
    pairs = scan(edges, keys, "pos", {"_k": F.lit(1)}, block=block)
    return pairs.groupBy(*keys, F.expr("(_k - 1) div 2").alias("_run")).agg(
        F.min("pos").alias("st"), (F.max("pos") - F.min("pos")).alias("len")).drop("_run")


def union(a: DataFrame, b: DataFrame, keys: Sequence[str], block: int = SCAN_BLOCK) -> DataFrame:
    return combine(a, b, keys, lambda x, y: x | y, block)


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str], block: int = SCAN_BLOCK) -> DataFrame:
    return combine(a, b, keys, lambda x, y: x & ~y, block)


def intersection(a: DataFrame, b: DataFrame, keys: Sequence[str], block: int = SCAN_BLOCK) -> DataFrame:
    return combine(a, b, keys, lambda x, y: x & y, block)
