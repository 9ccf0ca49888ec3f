"""Front-to-back compositing as an associative merge of brick segments.

Within a brick every ray is one segment: the colour that it adds if all light reaches it, and the light that it lets
through. Segments of a ray merge in order, (c, t) before (d, u) being (c + t d, t u), so only one row per brick and
ray is shuffled instead of every voxel. A sample counts while the opacity in front of it is below 0.95: segments behind that
point are dropped, segments wholly before it count as they are, and the one in which it lies is opened again.

NaN is transparent. Rays of a volume whose bricks are all given have a row each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..model import axis_coords
from .projection import OPAQUE

CHANNELS = ("r", "g", "b")
Shade = Callable[[np.ndarray], np.ndarray]
_BRICK = "volume_id string, bz int, by int, bx int"
_SUMS = "r double, g double, b double, alpha double"


def tf_shade(lut: DataFrame, low: float, high: float) -> Shade:
    """Colours and opacity of values by ``appearance.tf_lut``, as ``appearance.tf_lookup`` reads it; 256 rows are fetched."""
    table = np.array([[r[c] for c in "rgba"] for r in lut.orderBy("i").collect()], float) / 255.0

    def shade(v: np.ndarray) -> np.ndarray:
        spot = np.clip((v - low) / max(high - low, 0.001), 0.0, 1.0) * 256.0 - 0.5
        known = np.where(np.isnan(spot), 0.0, spot)
        below = np.floor(known)
        part = (known - below)[..., None]
        first, second = np.maximum(below, 0).astype(int), np.minimum(below + 1, 255).astype(int)
        out = table[first] * (1.0 - part) + table[second] * part
        out[np.isnan(spot)] = 0.0
        return out
    return shade


def _rays(row: dict, axis: str) -> np.ndarray:
    """A brick's values as (row, column, depth)."""
    cube = np.asarray(row["vals"], float).reshape(row["size_z"], row["size_y"], row["size_x"])
    return {"xy": cube.transpose(1, 2, 0), "xz": cube.transpose(0, 2, 1), "yz": cube.transpose(0, 1, 2)}[axis]


def _places(row: dict, axis: str, size: int) -> tuple[int, int, int]:
    """First row and column of a brick on the picture, and its number along the ray."""
    fixed, u, v = axis_coords(axis)
    return row[f"b{v}"] * size, row[f"b{u}"] * size, row[f"b{fixed}"]


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _segments(axis: str, size: int, shade: Shade) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for brick in batch.to_pylist():
                lit = shade(_rays(brick, axis))
                a = np.clip(lit[..., 3], 0.0, 1.0)
                left = np.cumprod(1.0 - a, axis=2)
                weight = np.concatenate([np.ones_like(a[..., :1]), left[..., :-1]], axis=2) * a
                rows, cols = (g.ravel() for g in np.indices(a.shape[:2], dtype=np.int32))
                row0, col0, along = _places(brick, axis, size)
                n = len(rows)
                sums = [(weight * lit[..., k]).sum(axis=2).ravel() for k in range(3)] + [weight.sum(axis=2).ravel()]
                yield _batch(
                    [[brick["volume_id"]] * n, *(np.full(n, brick[c], np.int32) for c in ("bz", "by", "bx")), np.full(n, along, np.int32),
                     rows + np.int32(row0), cols + np.int32(col0), *sums, left[..., -1].ravel()],
                    ["volume_id", "bz", "by", "bx", "along", "row", "col", *CHANNELS, "alpha", "left"])
    return run


def _opened(axis: str, size: int, shade: Shade) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of the samples of listed rays (row, col, front) that still count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for brick in batch.to_pylist():
                row0, col0, _ = _places(brick, axis, size)
                at = np.array([(r["row"], r["col"]) for r in brick["rays"]])
                lit = shade(_rays(brick, axis)[at[:, 0] - row0, at[:, 1] - col0])
                a = np.clip(lit[..., 3], 0.0, 1.0)
                front = np.array([r["front"] for r in brick["rays"]])[:, None] * np.concatenate(
                    [np.ones_like(a[:, :1]), np.cumprod(1.0 - a, axis=1)[:, :-1]], axis=1)
                weight = np.where(1.0 - front < OPAQUE, front * a, 0.0)
                yield _batch([[brick["volume_id"]] * len(at), at[:, 0].astype(np.int32), at[:, 1].astype(np.int32),
                              *((weight * lit[..., k]).sum(axis=1) for k in range(3)), weight.sum(axis=1)],
                             ["volume_id", "row", "col", *CHANNELS, "alpha"])
    return run


def composite(bricks: DataFrame, axis: str, shade: Shade, size: int) -> DataFrame:
    """(volume_id, row, col, r, g, b, alpha) from bricks (volume_id, bz, by, bx, size_z, size_y, size_x, vals)."""
    cubes = bricks.select("volume_id", "bz", "by", "bx", "size_z", "size_y", "size_x", "vals")
    parts = cubes.mapInArrow(_segments(axis, size, shade),
                             f"{_BRICK}, along int, row int, col int, {_SUMS}, left double")
    ray = ["volume_id", "row", "col"]
    before = W.partitionBy(*ray).orderBy("along").rowsBetween(W.unboundedPreceding, -1)  # as many rows as bricks along a ray
    merged = parts.withColumn("front", F.coalesce(F.product("left").over(before), F.lit(1.0))).where(
        F.lit(1.0) - F.col("front") < F.lit(OPAQUE))
    # A segment counts as it is if even its last sample does.
    whole = F.lit(1.0) - F.col("front") * F.col("left") < F.lit(OPAQUE)
    closed = merged.where(whole).select(*ray, *[(F.col("front") * F.col(c)).alias(c) for c in (*CHANNELS, "alpha")])
    key = ["volume_id", "bz", "by", "bx"]
    crossing = merged.where(~whole).groupBy(*key).agg(F.collect_list(F.struct("row", "col", "front")).alias("rays"))  # of one brick
    opened = cubes.join(crossing, key).mapInArrow(_opened(axis, size, shade), f"volume_id string, row int, col int, {_SUMS}")
    return closed.unionByName(opened).groupBy(*ray).agg(*[F.sum(c).alias(c) for c in (*CHANNELS, "alpha")])
