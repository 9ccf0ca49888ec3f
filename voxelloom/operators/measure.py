"""Measurements: rectangle ranges, statistics per region of interest, class counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import auto_tolerance, clamp, dbl, number_or_null
from ..model import VOXEL_KEY, axis_dims
from ..scale import attach, is_small
from .catalog import voxel_count
from .slicing import slices

TILE = 64


def clipped(rects: DataFrame, volumes: DataFrame, axis: str) -> DataFrame:
    """Rectangles with their cells from (_v0, _u0) to (_v1, _u1): corners are floored and clipped to the slice.

    Rectangles without area are left out.
    """
    _, nu, nv = axis_dims(axis)
    at = attach(rects, volumes.select("volume_id", F.col(nu).alias("_w"), F.col(nv).alias("_h")),
                ["volume_id"], ["rect_id"])

    def corner(a: str, b: str, n: str, low: bool) -> Column:
        pick = F.least(dbl(a), dbl(b)) if low else F.greatest(dbl(a), dbl(b))
        return clamp(F.floor(pick), 0, F.col(n) - 1).cast("int")

    return at.withColumns({
        "_u0": corner("x1", "x2", "_w", True), "_u1": corner("x1", "x2", "_w", False),
        "_v0": corner("y1", "y2", "_h", True), "_v1": corner("y1", "y2", "_h", False),
    }).where((F.col("_u1") > F.col("_u0")) & (F.col("_v1") > F.col("_v0")))


def rect_range(rects: DataFrame, voxels: DataFrame, volumes: DataFrame, axis: str) -> DataFrame:
    """Value range in each rectangle (rect_id, volume_id, idx, x1, y1, x2, y2), corners inclusive.

    Flat rectangles give no row. The range join becomes an equi-join on the tiles a rectangle covers; for many or large
    rectangles see ``rectindex``.
    """
    at = clipped(rects, volumes, axis)
    tiles = at.select(
        "rect_id", "volume_id", "idx", "_u0", "_u1", "_v0", "_v1",
        F.explode(F.expr(f"sequence(_v0 div {TILE}, _v1 div {TILE})")).alias("_tv"),
    ).withColumn("_tu", F.explode(F.expr(f"sequence(_u0 div {TILE}, _u1 div {TILE})")))
    cells = slices(voxels, axis).withColumns({
        "_tv": F.expr(f"v div {TILE}"), "_tu": F.expr(f"u div {TILE}")})
    if is_small(tiles):
        tiles = F.broadcast(tiles)
    hit = cells.join(tiles, ["volume_id", "idx", "_tv", "_tu"]).where(
        F.col("u").between(F.col("_u0"), F.col("_u1")) & F.col("v").between(F.col("_v0"), F.col("_v1")))
    found = hit.groupBy("rect_id", "volume_id", "idx").agg(
        F.min(number_or_null("value")).alias("vmin"), F.max(number_or_null("value")).alias("vmax"))
    return found.where(F.col("vmax") > F.col("vmin"))


def tolerance(ranges: DataFrame) -> DataFrame:
    """Suggested region-growing tolerance per volume."""
    return ranges.select("volume_id", auto_tolerance(F.col("vmin"), F.col("vmax")).alias("tolerance"))


def _moments(v: Column) -> list[Column]:
    return [
        F.count(v).alias("samples"), F.sum(dbl(v)).alias("total"), F.sum(dbl(v) * dbl(v)).alias("total_sq"),
    ]


def class_moments(mask: DataFrame, masks: DataFrame, voxels: DataFrame) -> DataFrame:
    """Count, sum and sum of squares per (mask_id, class_id), the form that deltas add up to."""
    marked = attach(mask, masks.select("mask_id", "volume_id"), ["mask_id"], ["z", "y", "x"])
    both = marked.join(voxels.select(*VOXEL_KEY, "v"), VOXEL_KEY, "left")
    return both.groupBy("mask_id", "volume_id", "class_id").agg(F.count(F.lit(1)).alias("voxels"), *_moments(F.col("v")))


def stats_of(moments: DataFrame, volumes: DataFrame) -> DataFrame:
    """Voxel count, physical volume, mean and population deviation from moments."""
    at = attach(moments, volumes.select("volume_id", "sx", "sy", "sz"), ["volume_id"], ["mask_id", "class_id"])
    some = F.col("samples") > 0
    mean = F.when(some, F.col("total") / F.col("samples")).otherwise(0.0)
    spread = F.when(some, F.col("total_sq") / F.col("samples") - mean * mean).otherwise(0.0)
    return at.select(
        "mask_id", "class_id", "voxels",
        (F.col("voxels") * F.col("sx") * F.col("sy") * F.col("sz")).alias("volume"),
        mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), spread)).alias("std"))


def roi_stats(mask: DataFrame, masks: DataFrame, voxels: DataFrame, volumes: DataFrame,
              rois: DataFrame) -> DataFrame:
    """Statistics of every region of interest; a region without voxels has zeros."""
    found = stats_of(class_moments(mask, masks, voxels), volumes)
    return rois.select("mask_id", "roi_id", "class_id").join(found, ["mask_id", "class_id"], "left").fillna(
        0, ["voxels", "volume", "mean", "std"])


def moments_delta(deltas: DataFrame, masks: DataFrame, voxels: DataFrame) -> DataFrame:
    """What voxel changes (mask_id, z, y, x, before_class, after_class) add to or take from each class."""
    at = attach(deltas.where(F.col("before_class") != F.col("after_class")),
                masks.select("mask_id", "volume_id"), ["mask_id"], ["z", "y", "x"])
    valued = at.join(voxels.select(*VOXEL_KEY, "v"), VOXEL_KEY, "left")
    moves = valued.select("mask_id", "volume_id", "v", F.explode(F.array(
        F.struct(F.col("before_class").alias("class_id"), F.lit(-1).alias("sign")),
        F.struct(F.col("after_class").alias("class_id"), F.lit(1).alias("sign")))).alias("m"))
    sign = F.col("m.sign")
    known = F.when(F.col("v").isNotNull(), sign).otherwise(0)
    v = F.coalesce(dbl("v"), F.lit(0.0))
    return moves.groupBy("mask_id", "volume_id", F.col("m.class_id").alias("class_id")).agg(
        F.sum(sign).alias("voxels"), F.sum(known).alias("samples"),
        F.sum(v * sign).alias("total"), F.sum(v * v * sign).alias("total_sq"))


def apply_delta(moments: DataFrame, delta: DataFrame) -> DataFrame:
    """Adds deltas to prior moments without reading the grid again."""
    return moments.unionByName(delta).groupBy("mask_id", "volume_id", "class_id").agg(
        *[F.sum(c).alias(c) for c in ("voxels", "samples", "total", "total_sq")])


def class_counts(mask: DataFrame, masks: DataFrame, volumes: DataFrame) -> DataFrame:
    """Voxels per class, the fill class included as the rest of the grid."""
    seen = mask.groupBy("mask_id", "class_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = masks.join(volumes.select("volume_id", voxel_count().alias("_all")), "volume_id")
    listed = seen.groupBy("mask_id").agg(F.sum("n").alias("_listed"))
    rest = sizes.join(listed, "mask_id", "left").select(
        "mask_id", F.col("fill_value").cast("int").alias("class_id"),
        (F.col("_all") - F.coalesce("_listed", F.lit(0))).cast("bigint").alias("n"))
    return seen.unionByName(rest).groupBy("mask_id", "class_id").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def nonzero_count(counts: DataFrame) -> DataFrame:
    return counts.groupBy("mask_id").agg(
        F.coalesce(F.sum(F.when(F.col("class_id") != 0, F.col("n"))), F.lit(0)).alias("nonzero"))
