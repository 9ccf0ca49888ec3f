"""RAW volumes: headerless grids described by side files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import bytes_per_voxel
from . import files, meta, slabs


def kind_of():
    """Numpy type of the stored voxels; the declared byte order is honoured."""
    order = F.when(F.col("byte_order") == "big-endian", ">").otherwise("<")
    code = F.when(F.col("data_type") == "uint8", "u1").when(F.col("data_type") == "uint16", "u2").otherwise("f4")
    return F.concat(order, code)


def raw_files(volumes: DataFrame) -> DataFrame:
    """RAW files (volume_id, path, length and metadata) in the form the slab planner takes."""
    return volumes.select(
        "volume_id", "path", F.lit(None).cast("binary").alias("content"), F.lit(False).alias("gzip"),
        F.lit(0).cast("bigint").alias("offset"), kind_of().alias("kind"), "nx", "ny", "nz",
        F.lit(1.0).alias("slope"), F.lit(0.0).alias("intercept"), bytes_per_voxel(F.col("data_type")).alias("bpv"))


def size_problems(volumes: DataFrame) -> DataFrame:
    """RAW files that are shorter than their metadata says; longer ones are fine."""
    need = F.col("nx").cast("bigint") * F.col("ny") * F.col("nz") * bytes_per_voxel(F.col("data_type"))
    return volumes.where(F.col("length") < need).select(
        "volume_id", "path", F.lit("file is shorter than its metadata says").alias("reject_reason"))


def read_raw(volumes: DataFrame, z_from: int | None = None, z_to: int | None = None) -> DataFrame:
    """Voxels of RAW volumes (volume_id, path, nx, ny, nz, data_type, byte_order), slab by slab."""
    return slabs.read_slabs(slabs.plan_slabs(raw_files(volumes), z_from, z_to))


def catalogue(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """RAW volumes below a folder with their metadata, and what was refused and why."""
    listed = files.list_files(spark, folder)
    named = listed.select(
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("selection"), "path", "length", F.col("path").alias("file_no"))
    groups, unpaired = files.group_files(named)
    groups = groups.where(F.col("type") == "3d-raw")
    good, bad = meta.split_meta(meta.load_meta(meta.read_side_files(spark, folder)))
    sized = groups.join(listed, "path")
    both = sized.join(good.withColumnRenamed("path", "metadata_path"), "metadata_path").withColumn(
        "volume_id", F.concat("selection", F.lit("/"), "name"))
    short = size_problems(both)
    refused = bad.unionByName(short.select("path", "reject_reason")).unionByName(unpaired.select(
        F.concat("selection", F.lit("/"), "base").alias("path"), F.col("problem").alias("reject_reason")))
    return both.join(short.select("volume_id"), "volume_id", "left_anti"), refused
