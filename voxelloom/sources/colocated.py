"""Grids and masks stored in buckets of the same brick key, so that they meet without being shuffled.

A grid's brick holds its values, x fastest; a mask's brick holds the places in that order of the voxels that differ from the
fill value, and their classes. Both tables are bucketed and sorted by (volume_id, bz, by, bx), so statistics per region read
matching buckets side by side and shuffle only one row per class and task. Bricks spread a large volume over all buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.measure import stats_of
from ..scale import attach
from .bricks import BRICK, to_bricks

SIZE, BUCKETS = 16, 256


def _save(df: DataFrame, name: str, buckets: int) -> None:
    # Dealt like the buckets, so that every bucket is one file.
    df.repartition(buckets, *BRICK).write.bucketBy(buckets, *BRICK).sortBy(*BRICK).mode("overwrite").saveAsTable(name)


def mask_bricks(mask: DataFrame, masks: DataFrame, volumes: DataFrame, size: int = SIZE) -> DataFrame:
    """(mask_id, volume_id, bz, by, bx, places, classes); places are those of the values of a grid's brick."""
    grids = masks.join(volumes.select("volume_id", "nx", "ny", "nz"), "volume_id").select("mask_id", "volume_id", "nx", "ny")
    at = attach(mask, grids, ["mask_id"], ["z", "y", "x"])
    at = at.withColumns({f"b{c}": F.expr(f"cast({c} div {size} as int)") for c in ("z", "y", "x")})
    wide, deep = (F.least(F.lit(size), F.col(f"n{c}") - F.col(f"b{c}") * size) for c in ("x", "y"))
    place = F.expr(f"x % {size}") + F.expr(f"y % {size}") * wide + F.expr(f"z % {size}") * wide * deep
    packed = at.groupBy("mask_id", *BRICK).agg(F.array_sort(F.collect_list(F.struct(place.cast("int").alias("p"), F.col("class_id").alias("c")))).alias("_m"))
    return packed.select("mask_id", *BRICK, F.col("_m.p").alias("places"), F.col("_m.c").alias("classes"))


def write_grid(voxels: DataFrame, volumes: DataFrame, name: str, size: int = SIZE, buckets: int = BUCKETS) -> None:
    _save(to_bricks(voxels, volumes, size).select(*BRICK, "vals"), name, buckets)


def write_mask(mask: DataFrame, masks: DataFrame, volumes: DataFrame, name: str, size: int = SIZE, buckets: int = BUCKETS) -> None:
    _save(mask_bricks(mask, masks, volumes, size), name, buckets)


def class_moments(spark: SparkSession, grid_name: str, mask_name: str) -> DataFrame:
    """As ``measure.class_moments``, from two tables with the same bricks and buckets."""
    both = spark.table(mask_name).join(spark.table(grid_name).hint("merge"), BRICK, "left")
    cells = both.select("mask_id", "volume_id", F.explode(F.zip_with(
        "places", "classes", lambda p, c: F.struct(c.alias("class_id"), F.get("vals", p).alias("v")))).alias("m"))
    v = F.col("m.v")
    return cells.groupBy("mask_id", "volume_id", F.col("m.class_id").alias("class_id")).agg(
        F.count(F.lit(1)).alias("voxels"), F.count(v).alias("samples"), F.sum(v).alias("total"), F.sum(v * v).alias("total_sq"))


def roi_stats(spark: SparkSession, grid_name: str, mask_name: str, volumes: DataFrame, rois: DataFrame) -> DataFrame:
    """As ``measure.roi_stats``."""
    found = stats_of(class_moments(spark, grid_name, mask_name), volumes)
    return rois.select("mask_id", "roi_id", "class_id").join(found, ["mask_id", "class_id"], "left").fillna(
        0, ["voxels", "volume", "mean", "std"])
