"""Edits that arrive as a stream, with one state entry per voxel that was touched.

Rows are (mask_id, seq, z, y, x, after_class). State is a map per (mask, brick) from the voxel's place to its class and the
``seq`` of the edit that set it, kept in RocksDB: a batch reads and writes the entries of its own voxels only, whatever
else the brick holds. An edit that is late (a smaller ``seq`` than the last one applied to its voxel) or repeated (the same
``seq``) changes nothing, so a source may deliver twice. Of edits with equal ``seq`` in a batch one is applied.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.measure import moments_delta
from .edits import _EDITS, _last_per_voxel, _with_base, BRICK, DELTAS
from .sink import write_batches

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTING = "spark.sql.streaming.stateStore.providerClass"


class VoxelEdits(StatefulProcessor):
    """State and output of one brick of a mask."""

    def __init__(self, brick: int) -> None:
        self.brick = brick

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.voxels = handle.getMapState("voxels", "place int", "class_id int, seq bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        mask_id = key[0]
        size = self.brick
        for part in rows:
            out = []
            last = part.sort_values("seq").drop_duplicates(["z", "y", "x"], keep="last")
            for seq, z, y, x, after, base in zip(*(last[c].tolist() for c in ("seq", "z", "y", "x", "after_class", "base"))):
                place = (z % size * size + y % size) * size + x % size
                known = self.voxels.getValue((place,))
                if known is not None and seq <= known[1]:
                    continue
                before = base if known is None else known[0]
                self.voxels.updateValue((place,), (after, seq))
                if before != after:
                    out.append((mask_id, z, y, x, before, after))
            if out:
                yield pd.DataFrame(out, columns=["mask_id", "z", "y", "x", "before_class", "after_class"])

    def close(self) -> None:
        pass


def deltas(edits: DataFrame, fill_value: int = 0, brick: int = BRICK, mask: DataFrame | None = None,
           masks: DataFrame | None = None, volumes: DataFrame | None = None) -> DataFrame:
    """Change rows of a stream of edits; the arguments are those of ``edits.deltas``."""
    slim = edits.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in _EDITS.split(", ")])
    keyed = _with_base(slim.mapInPandas(_last_per_voxel, _EDITS), fill_value, mask, masks, volumes).withColumns(
        {f"b{c}": F.expr(f"cast({c} div {brick} as int)") for c in ("z", "y", "x")})
    return keyed.groupBy("mask_id", "bz", "by", "bx").transformWithStateInPandas(
        VoxelEdits(brick), outputStructType=DELTAS, outputMode="Update", timeMode="None")


def _start(changes: DataFrame, path: str, checkpoint: str, once: bool, transform=None) -> StreamingQuery:
    """A query keeps the state store that its session names when it starts; the setting is put back afterwards."""
    conf = changes.sparkSession.conf
    before = conf.get(_SETTING, None)
    conf.set(_SETTING, PROVIDER)
    try:
        return write_batches(changes, path, checkpoint, once=once, transform=transform)
    finally:
        conf.unset(_SETTING) if before is None else conf.set(_SETTING, before)


def follow(edits: DataFrame, path: str, checkpoint: str, once: bool = True, mask: DataFrame | None = None,
           masks: DataFrame | None = None, volumes: DataFrame | None = None) -> StreamingQuery:
    """Appends the change rows of a stream of edits to a table."""
    return _start(deltas(edits, mask=mask, masks=masks, volumes=volumes), path, checkpoint, once)


def follow_stats(edits: DataFrame, masks: DataFrame, voxels: DataFrame, path: str, checkpoint: str, once: bool = True,
                 mask: DataFrame | None = None, volumes: DataFrame | None = None) -> StreamingQuery:
    """Appends what every micro-batch adds to the moments of each class."""
    changes = deltas(edits, mask=mask, masks=None if volumes is None else masks, volumes=volumes)
    return _start(changes, path, checkpoint, once, lambda batch: moments_delta(batch, masks, voxels))
