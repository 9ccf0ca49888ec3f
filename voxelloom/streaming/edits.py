"""Edits that arrive as a stream: per-voxel state, change rows, running statistics per class.

Rows are (mask_id, seq, z, y, x, after_class). State is kept per brick, packed; a late edit, with a smaller
``seq`` than the last one applied to its voxel, changes nothing. What a voxel held before the stream comes from a
snapshot of the mask, joined to the last edit of each voxel; the state knows only voxels that were edited.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import MASK_KEY
from ..operators.measure import moments_delta
from .sink import read_batches, write_batches

BRICK = 16
DELTAS = "mask_id string, z int, y int, x int, before_class int, after_class int"
MOMENTS = "mask_id string, volume_id string, class_id int, voxels bigint, samples bigint, total double, total_sq double"
_EDITS = "mask_id string, seq bigint, z int, y int, x int, after_class int"


def _last_per_voxel(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keeps the last edit of a voxel within a batch, before anything is shuffled."""
    for part in parts:
        if len(part):
            yield part.sort_values("seq").drop_duplicates(["mask_id", "z", "y", "x"], keep="last")


def _pack(at: np.ndarray, classes: np.ndarray, seqs: np.ndarray) -> bytes:
    return struct.pack("<I", len(at)) + zlib.compress(
        at.astype("<i4").tobytes() + classes.astype("<i4").tobytes() + seqs.astype("<i8").tobytes(), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", data)
    raw = zlib.decompress(data[4:])
    return (np.frombuffer(raw, "<i4", n), np.frombuffer(raw, "<i4", n, 4 * n), np.frombuffer(raw, "<i8", n, 8 * n))


def _with_base(edits: DataFrame, fill_value: int, mask: DataFrame | None, masks: DataFrame | None,
               volumes: DataFrame | None) -> DataFrame:
    """Adds the class before the stream as ``base``; with ``masks``, only edits inside the grid of a listed mask stay."""
    base = F.lit(fill_value)
    if masks is not None:
        grids = masks.join(volumes.select("volume_id", "nx", "ny", "nz"), "volume_id").select(
            "mask_id", F.col("fill_value").alias("_fill"), "nx", "ny", "nz")
        edits = edits.join(grids, "mask_id").where(
            F.col("z").between(0, F.col("nz") - 1) & F.col("y").between(0, F.col("ny") - 1) & F.col("x").between(0, F.col("nx") - 1))
        base = F.col("_fill")
    if mask is not None:
        edits = edits.join(mask.select(*MASK_KEY, F.col("class_id").alias("_held")), list(MASK_KEY), "left")
        base = F.coalesce(F.col("_held"), base)
    return edits.select(*[c.split()[0] for c in _EDITS.split(", ")], base.cast("int").alias("base"))


def deltas(edits: DataFrame, fill_value: int = 0, brick: int = BRICK, mask: DataFrame | None = None,
           masks: DataFrame | None = None, volumes: DataFrame | None = None) -> DataFrame:
    """Change rows of a stream of edits, one per voxel and micro-batch chunk that changes it.

    ``mask`` is a snapshot that stays as it is while the stream runs; voxels without a row hold the ``fill_value`` of
    ``masks``, or the argument's. With ``masks`` and ``volumes``, edits outside the grid are refused.
    """
    size = brick ** 3

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mask_id, bz, by, bx = key
        classes = np.zeros(size, np.int64)
        seen = np.full(size, -1, np.int64)
        if state.exists:
            at, old, seqs = _unpack(state.get[0])
            classes[at], seen[at] = old, seqs
        for part in parts:
            part = part.sort_values("seq")
            at = ((part["z"] - bz * brick) * brick + (part["y"] - by * brick)) * brick + (part["x"] - bx * brick)
            part = part.assign(_at=at).drop_duplicates("_at", keep="last")
            spot, seq = part["_at"].to_numpy(np.int64), part["seq"].to_numpy(np.int64)
            fresh = seq > seen[spot]
            part, spot, seq = part[fresh], spot[fresh], seq[fresh]
            after = part["after_class"].to_numpy(np.int64)
            before = np.where(seen[spot] >= 0, classes[spot], part["base"].to_numpy(np.int64))
            classes[spot], seen[spot] = after, seq
            moved = before != after
            if moved.any():
                out = part.loc[moved, ["z", "y", "x"]]
                yield pd.DataFrame({
                    "mask_id": mask_id, "z": out["z"].to_numpy(), "y": out["y"].to_numpy(), "x": out["x"].to_numpy(),
                    "before_class": before[moved], "after_class": after[moved]})
        known = np.flatnonzero(seen >= 0)
        state.update((_pack(known, classes[known], seen[known]),))

    slim = edits.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in _EDITS.split(", ")])
    keyed = _with_base(slim.mapInPandas(_last_per_voxel, _EDITS), fill_value, mask, masks, volumes).withColumns(
        {f"b{c}": F.expr(f"cast({c} div {brick} as int)") for c in ("z", "y", "x")})
    return keyed.groupBy("mask_id", "bz", "by", "bx").applyInPandasWithState(
        step, DELTAS, "packed binary", "update", GroupStateTimeout.NoTimeout)


def follow(edits: DataFrame, path: str, checkpoint: str, once: bool = True, mask: DataFrame | None = None,
           masks: DataFrame | None = None, volumes: DataFrame | None = None) -> StreamingQuery:
    """Appends the change rows of a stream of edits to a table."""
    return write_batches(deltas(edits, mask=mask, masks=masks, volumes=volumes), path, checkpoint, once=once)


def follow_stats(edits: DataFrame, masks: DataFrame, voxels: DataFrame, path: str, checkpoint: str,
                 once: bool = True, mask: DataFrame | None = None, volumes: DataFrame | None = None) -> StreamingQuery:
    """Appends what every micro-batch adds to the moments of each class.

    Their sum is the current state; with a snapshot ``mask``, what has been added to the snapshot's own moments.
    """
    changes = deltas(edits, mask=mask, masks=None if volumes is None else masks, volumes=volumes)
    return write_batches(changes, path, checkpoint, once=once,
                         transform=lambda batch: moments_delta(batch, masks, voxels))


def change_log(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path, DELTAS)


def current_moments(spark: SparkSession, path: str) -> DataFrame:
    """Running count, sum and sum of squares per class."""
    return read_batches(spark, path, MOMENTS).groupBy("mask_id", "volume_id", "class_id").agg(
        *[F.sum(c).alias(c) for c in ("voxels", "samples", "total", "total_sq")])
