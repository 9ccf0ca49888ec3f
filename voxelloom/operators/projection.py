"""Projections along an axis and front-to-back compositing; one sample per voxel, axis-aligned rays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import clamp, number_or_null
from ..model import axis_coords
from ..scale import attach
from .catalog import brick_of

OPAQUE = 0.95  # Fixed value: a ray ends once this alpha is reached.


def _ray(axis: str) -> list[str]:
    _, u, v = axis_coords(axis)
    return ["volume_id", v, u]


def project(voxels: DataFrame, axis: str) -> DataFrame:
    """Maximum, minimum and average along each ray: (volume_id, v, u, vmax, vmin, vavg).

    Sum and count aggregate map-side, so a shuffle carries one row per ray and task. NaN is left out; a ray of
    nothing else has nulls.
    """
    _, u, v = axis_coords(axis)
    value = number_or_null("v")
    return voxels.groupBy(*_ray(axis)).agg(
        F.max(value).alias("vmax"), F.min(value).alias("vmin"), F.avg(value).alias("vavg"),
    ).select("volume_id", F.col(v).alias("row"), F.col(u).alias("col"), "vmax", "vmin", "vavg")


def project_visible(voxels: DataFrame, axis: str, display_min, size: int = 8) -> DataFrame:
    """Like ``project`` but bricks whose maximum lies below the display minimum contribute nothing.

    Voxels first shrink to one partial row per brick and ray; the brick maximum is a window over at most
    size x size of these rows. NaN is left out. Rays without a sample give 0.
    """
    _, u, v = axis_coords(axis)
    brick, value = ["volume_id", "bz", "by", "bx"], number_or_null("v")
    parts = voxels.withColumns(brick_of(size)).groupBy(*brick, v, u).agg(
        F.max(value).alias("hi"), F.min(value).alias("lo"), F.sum(value).alias("total"), F.count(value).alias("n"))
    seen = parts.withColumn("_shown", F.max("hi").over(W.partitionBy(*brick)) >= F.lit(display_min))

    def shown(c: str):
        return F.when(F.col("_shown"), F.col(c))

    return seen.groupBy(*_ray(axis)).agg(
        F.max(shown("hi")).alias("vmax"), F.min(shown("lo")).alias("vmin"),
        (F.sum(shown("total")) / F.sum(shown("n"))).alias("vavg"),
    ).select(
        "volume_id", F.col(v).alias("row"), F.col(u).alias("col"),
        F.coalesce("vmax", F.lit(0)).alias("vmax"), F.coalesce("vmin", F.lit(0)).alias("vmin"),
        F.coalesce("vavg", F.lit(0.0)).alias("vavg"))


def composite(samples: DataFrame, axis: str, channels: list[str], alpha: str = "alpha") -> DataFrame:
    """Front-to-back accumulation of ``channels`` weighted by ``alpha`` along each ray.

    The light left before a sample is the product of (1 - alpha) of the samples in front of it, kept as a
    sum of logarithms; a fully opaque sample leaves none. A sample counts while the alpha in front of it is
    below 0.95. A window holds one ray, whose length is the extent of the grid.
    """
    fixed, u, v = axis_coords(axis)
    key = [c for c in samples.columns if c in ("volume_id", "mask_id")] + [v, u]
    front = W.partitionBy(*key).orderBy(fixed).rowsBetween(W.unboundedPreceding, -1)
    a = clamp(F.col(alpha), 0.0, 1.0)
    lit = samples.withColumn("_a", a).withColumn(
        "_log", F.when(F.col("_a") < 1.0, F.log(F.lit(1.0) - F.col("_a"))).otherwise(0.0))
    lit = lit.withColumn("_left", F.when(
        F.coalesce(F.max("_a").over(front), F.lit(0.0)) >= 1.0, F.lit(0.0),
    ).otherwise(F.exp(F.coalesce(F.sum("_log").over(front), F.lit(0.0)))))
    lit = lit.where(F.lit(1.0) - F.col("_left") < F.lit(OPAQUE))
    weight = F.col("_left") * F.col("_a")
    return lit.groupBy(*key).agg(
        *[F.sum(weight * F.col(c)).alias(c) for c in channels], F.sum(weight).alias("alpha"),
    ).withColumnsRenamed({v: "row", u: "col"})


def blend(base: DataFrame, masks: DataFrame, overlay: DataFrame, channels: list[str]) -> DataFrame:
    """Mixes accumulated overlays (mask_id, row, col, r, g, b, alpha) into the base picture of their volume.

    A picture for every mask of ``masks`` (mask_id, volume_id): volumes with several masks have several.
    """
    top = overlay.select("mask_id", "row", "col", *[F.col(c).alias(f"_{c}") for c in channels],
                         F.col("alpha").alias("_alpha"))
    per_volume = masks.groupBy("volume_id").agg(F.collect_set("mask_id").alias("_masks"))
    below = attach(base, per_volume, ["volume_id"], ["row", "col"]).withColumn("mask_id", F.explode("_masks"))
    a = F.coalesce("_alpha", F.lit(0.0))
    mixed = below.join(top, ["mask_id", "row", "col"], "left")
    return mixed.select(
        "mask_id", "volume_id", "row", "col",
        *[(F.col(c) * (F.lit(1.0) - a) + F.coalesce(F.col(f"_{c}"), F.lit(0.0)) * a).alias(c) for c in channels])
