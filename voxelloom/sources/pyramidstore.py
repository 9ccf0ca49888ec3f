"""Stored resolution pyramids that are kept up by their changed bricks.

A brick of the grid and its blocks on every coarser level share one key, since a brick's side is a multiple of all
factors. Every part (the bricks themselves and each level) is a Parquet table of versions: an update finds the bricks that its
changes touch, reads those alone, and writes them anew on all levels under the next version. The list of touched bricks is
written last and is what makes a version valid, so an update that is lost midway leaves the pyramid as it was. A reader takes each
brick from its newest version. ``compact`` writes what is current as one version.

Of several changes to a voxel the one with the largest ``seq`` counts; changes outside the grid touch nothing, and one
without a value leaves what was stored.
One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.catalog import LEVELS
from ..operators.resample import downsample, downsampled_volumes
from ..scale import attach, is_small, stage
from .bricks import BRICK, to_bricks, voxels_of
from .bricktree import NODES, morton, ranges_of, within

SIZE = 32
COARSE = tuple((name, k) for name, k in LEVELS if k > 1)
FILE_BYTES = 64 << 20


def _write_parts(voxels: DataFrame, volumes: DataFrame, path: str, version: int, size: int, file_bytes: int) -> None:
    if any(size % k for _, k in COARSE):
        raise ValueError("the side of a brick must be a multiple of all factors")
    for name, k in (("full", 1), *COARSE):
        grid, heads = (voxels, volumes) if k == 1 else (downsample(voxels, volumes, k), downsampled_volumes(volumes, k))
        packed = to_bricks(grid, heads, size // k).withColumn("code", morton())
        packed.repartitionByRange("volume_id", "code").sortWithinPartitions("volume_id", "code").write.mode("overwrite").option(
            "maxRecordsPerFile", max(1, file_bytes * k ** 3 // (8 * size ** 3))).parquet(f"{path}/{name}/version={version}")


def write_pyramid(voxels: DataFrame, volumes: DataFrame, path: str, size: int = SIZE, file_bytes: int = FILE_BYTES) -> None:
    """Writes all levels of a grid as version 0."""
    volumes.write.mode("overwrite").parquet(f"{path}/volumes")
    _write_parts(voxels, volumes, path, 0, size, file_bytes)
    none = voxels.sparkSession.createDataFrame([], voxels.select("volume_id").schema)
    none.select("volume_id", *[F.lit(0).alias(c) for c in BRICK[1:]], F.lit(0).cast("bigint").alias("code")).write.mode("overwrite").parquet(
        f"{path}/touched/version=0")


def _touched(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Newest version of every brick that was ever changed, and the newest of all."""
    spark.catalog.refreshByPath(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/touched")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName().split("=")[1]) for s in files.listStatus(folder)
            if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    rows = spark.read.parquet(f"{path}/touched").where(F.col("version").isin(done))
    return rows.groupBy(*BRICK, "code").agg(F.max("version").alias("newest")), max(done)


def read_level(spark: SparkSession, path: str, level: str = "full") -> DataFrame:
    """Current bricks of a level ("full", "mid", "low")."""
    touched, newest = _touched(spark, path)
    rows = spark.read.parquet(f"{path}/{level}").where(F.col("version") <= newest)
    at = attach(rows, touched.select(*BRICK, "newest"), BRICK, BRICK, "left")
    return at.where(F.col("version") == F.coalesce("newest", F.lit(0))).drop("newest", "version")


def read_voxels(spark: SparkSession, path: str, level: str = "full", size: int = SIZE) -> DataFrame:
    return voxels_of(read_level(spark, path, level), size // dict(LEVELS)[level])


def read_touched(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Current bricks of the grid with one of the keys; where these are few, other ranges of codes are not read."""
    rows = read_level(spark, path)
    if is_small(keys, NODES):
        rows = rows.where(within(ranges_of([(r[0], r[1]) for r in keys.select("volume_id", "code").collect()]), 0))
    return rows.join(keys.select(*BRICK), BRICK, "left_semi")


def update(spark: SparkSession, path: str, changes: DataFrame, size: int = SIZE, file_bytes: int = FILE_BYTES) -> int:
    """Applies changes (volume_id, z, y, x, v, seq) to all levels; returns the new version."""
    volumes = spark.read.parquet(f"{path}/volumes")
    last = changes.groupBy("volume_id", "z", "y", "x").agg(F.max_by(F.col("v").cast("double"), "seq").alias("_new"))
    within_grid = " and ".join(f"{c} >= 0 and {c} < n{c}" for c in "zyx")
    last = stage(attach(last, volumes.select("volume_id", "nx", "ny", "nz"), ["volume_id"], ["z", "y", "x"]).where(within_grid).select(
        "volume_id", "z", "y", "x", "_new"))
    keys = stage(last.select("volume_id", *[F.expr(f"cast({c} div {size} as int)").alias(f"b{c}") for c in "zyx"]).distinct().withColumn(
        "code", morton()))
    version = _touched(spark, path)[1] + 1
    old = voxels_of(read_touched(spark, path, keys), size)
    # Within touched bricks most voxels are as they were; the new values are joined once and read again for each level.
    fresh = stage(old.join(last, ["volume_id", "z", "y", "x"], "left").select(
        "volume_id", "z", "y", "x", F.when(F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("v")).alias("v")))
    _write_parts(fresh, volumes, path, version, size, file_bytes)
    keys.write.mode("overwrite").parquet(f"{path}/touched/version={version}")
    return version


def compact(spark: SparkSession, path: str, to: str, size: int = SIZE, file_bytes: int = FILE_BYTES) -> None:
    """Writes the current bricks of all levels as version 0 of another pyramid."""
    spark.read.parquet(f"{path}/volumes").write.mode("overwrite").parquet(f"{to}/volumes")
    for name, k in (("full", 1), *COARSE):
        read_level(spark, path, name).repartitionByRange("volume_id", "code").sortWithinPartitions("volume_id", "code").write.mode(
            "overwrite").option("maxRecordsPerFile", max(1, file_bytes * k ** 3 // (8 * size ** 3))).parquet(f"{to}/{name}/version=0")
    _touched(spark, path)[0].limit(0).drop("newest").write.mode("overwrite").parquet(f"{to}/touched/version=0")
