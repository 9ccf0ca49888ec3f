"""Storage form of grids: cubic bricks with their value range, in Parquet.

Files are clustered by brick, so row-group statistics prune slices on all three axes alike, and vmin/vmax
skip empty space. Values are doubles, which hold every value of all data types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import number_or_null
from ..model import VOXELS
from ..scale import attach

SIZE = 32
BRICK = ["volume_id", "bz", "by", "bx"]


def to_bricks(voxels: DataFrame, volumes: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per brick: its extents, range and values, x fastest. A brick holds at most size^3 voxels."""
    at = attach(voxels, volumes.select("volume_id", "nx", "ny", "nz"), ["volume_id"], ["z", "y", "x"])
    for c in ("z", "y", "x"):
        at = at.withColumn(f"b{c}", F.expr(f"cast({c} div {size} as int)")).withColumn(
            f"size_{c}", F.expr(f"cast(least({size}, n{c} - ({c} div {size}) * {size}) as int)"))
    pos = F.expr(f"x % {size} + (y % {size}) * size_x + (z % {size}) * size_x * size_y").alias("p")
    packed = at.select(*BRICK, "size_z", "size_y", "size_x", F.struct(pos, F.col("v").cast("double").alias("v")).alias("c"))
    return packed.groupBy(*BRICK, "size_z", "size_y", "size_x").agg(
        F.min(number_or_null("c.v")).alias("vmin"), F.max(number_or_null("c.v")).alias("vmax"), F.array_sort(F.collect_list("c")).alias("_c"),
    ).select(*BRICK, "size_z", "size_y", "size_x", "vmin", "vmax", F.col("_c.v").alias("vals"))


def write_bricks(voxels: DataFrame, volumes: DataFrame, path: str, size: int = SIZE) -> None:
    """Writes bricks and, beside them, the catalogue of their volumes."""
    packed = to_bricks(voxels, volumes, size).repartitionByRange(*BRICK).sortWithinPartitions(*BRICK)
    packed.withColumn("brick_size", F.lit(size)).write.partitionBy("brick_size").mode("overwrite").parquet(f"{path}/bricks")
    volumes.write.mode("overwrite").parquet(f"{path}/volumes")


def read_bricks(spark: SparkSession, path: str, volume_ids: list[str] | None = None, size: int = SIZE,
                display_min: float | None = None, **ranges: tuple[int, int]) -> DataFrame:
    """Bricks that can hold the wanted voxels: ``z=(first, last)``, likewise y and x, both ends included.

    A coordinate range becomes a range of brick keys, which Parquet prunes; Catalyst could not derive it.
    """
    bricks = spark.read.parquet(f"{path}/bricks").where(F.col("brick_size") == size)
    if volume_ids is not None:
        bricks = bricks.where(F.col("volume_id").isin(*volume_ids))
    for c, (first, last) in ranges.items():
        bricks = bricks.where(F.col(f"b{c}").between(first // size, last // size))
    if display_min is not None:
        bricks = bricks.where(F.col("vmax") >= F.lit(float(display_min)))
    return bricks


def voxels_of(bricks: DataFrame, size: int = SIZE, **ranges: tuple[int, int]) -> DataFrame:
    """Voxel rows of bricks, cut to the wanted coordinate ranges."""
    cells = bricks.select(*BRICK, "size_y", "size_x", F.posexplode("vals").alias("p", "v")).select(
        "volume_id",
        F.expr(f"cast(bz * {size} + p div (size_x * size_y) as int)").alias("z"),
        F.expr(f"cast(by * {size} + (p div size_x) % size_y as int)").alias("y"),
        F.expr(f"cast(bx * {size} + p % size_x as int)").alias("x"),
        F.col("v").cast("double").alias("v"))
    for c, (first, last) in ranges.items():
        cells = cells.where(F.col(c).between(first, last))
    return cells.select(*VOXELS.fieldNames())
