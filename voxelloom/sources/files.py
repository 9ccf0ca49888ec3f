"""Grouping of files into loadable units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..scale import is_small

# File extensions per kind.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "bmp")
TIFF_EXTENSIONS = ("tif", "tiff")
META_EXTENSIONS = ("json", "volumeinfo", "dat")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths and lengths below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(name: Column) -> Column:
    """Lower-case extension; ``nii.gz`` counts as one, a name without a dot has none."""
    lower = F.lower(name)
    return F.when(lower.endswith(".nii.gz"), F.lit("nii.gz")).otherwise(F.regexp_extract(lower, r"\.([^.]*)$", 1))


def classify(files: DataFrame) -> DataFrame:
    """Adds name, ext, kind and base to files (selection, file_no, path)."""
    ext = F.col("ext")
    kind = (
        F.when(ext == "raw", "raw").when(ext.isin(*META_EXTENSIONS), "meta")
        .when(ext.isin("nii", "nii.gz"), "nifti").when(ext == "dcm", "dicom")
        .when(ext.isin(*TIFF_EXTENSIONS), "tiff").when(ext.isin(*IMAGE_EXTENSIONS), "2d-image"))
    suffix = F.when(ext == "volumeinfo", F.lit(r"(?i)\.raw\.volumeinfo$")).otherwise(
        F.concat(F.lit(r"(?i)\."), ext, F.lit("$")))
    return files.withColumn("name", file_name(F.col("path"))).withColumn("ext", extension(F.col("name"))).withColumns({
        "kind": kind, "base": F.regexp_replace(F.col("name"), suffix, F.lit(""))})


def group_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loadable units, one row per file, and the files left without a partner.

    A RAW file pairs with the side file of the same base name: the last ``json``, else the first of the other
    kinds. All DICOM files of a selection form one unit, every other file its own. Nothing is collected: a
    unit of many files is many rows with the same name.
    """
    known = classify(files)
    pairs = known.where(F.col("kind").isin("raw", "meta")).groupBy("selection", "base").agg(
        F.max_by(F.when(F.col("kind") == "raw", F.col("path")), F.when(F.col("kind") == "raw", F.col("file_no"))).alias("path"),
        F.max_by(F.when(F.col("ext") == "json", F.col("path")), F.when(F.col("ext") == "json", F.col("file_no"))).alias("_json"),
        F.min_by(F.when(F.col("ext").isin("volumeinfo", "dat"), F.col("path")),
                 F.when(F.col("ext").isin("volumeinfo", "dat"), F.col("file_no"))).alias("_other"),
    ).withColumn("metadata_path", F.coalesce("_json", "_other"))
    volumes = pairs.where(F.col("path").isNotNull() & F.col("metadata_path").isNotNull()).select(
        "selection", F.lit("3d-raw").alias("type"), F.col("base").alias("name"), "path", "metadata_path")
    single = known.where(F.col("kind").isin("nifti", "tiff", "2d-image", "dicom"))
    size = known.where(F.col("kind") == "dicom").groupBy("selection").agg(F.count(F.lit(1)).alias("_n"))
    single = single.join(F.broadcast(size) if is_small(size) else size, "selection", "left")
    name = F.when(F.col("kind") == "dicom", F.format_string("DICOM series (%d files)", F.col("_n"))).otherwise(F.col("name"))
    others = single.select("selection", F.col("kind").alias("type"), name.alias("name"), "path",
                           F.lit(None).cast("string").alias("metadata_path"))
    unpaired = pairs.where(F.col("path").isNull() | F.col("metadata_path").isNull()).select(
        "selection", "base", F.when(F.col("path").isNull(), "metadata without RAW").otherwise("RAW without metadata").alias("problem"))
    return volumes.unionByName(others), unpaired
