"""2D images and page stacks, as tables of decoded pixels.

Pixels are rows (path, y, x, r, g, b); pages add (stack_id, page_no). Decoding is left to Spark's image source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..scale import ORDER_BLOCK, attach, scan, stage, with_order

PIXELS = "path string, y int, x int, r int, g int, b int"
_ARROW = pa.schema([("path", pa.string())] + [(c, pa.int32()) for c in ("y", "x", "r", "g", "b")])
BATCH_PIXELS = 1 << 18


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", "true").load(folder)


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rec in batch.to_pylist():
            h, w, n = rec["height"], rec["width"], rec["channels"]
            data = np.frombuffer(rec["data"], np.uint8).reshape(h, w, n)
            step = max(1, BATCH_PIXELS // max(1, w))
            for top in range(0, h, step):
                part = data[top:top + step].astype(np.int32)
                rows = part.shape[0]
                # Bytes come as blue, green, red; one channel means grey.
                b, g, r = (part[:, :, min(c, n - 1)].ravel() if n >= 3 else part[:, :, 0].ravel() for c in (0, 1, 2))
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(pa.scalar(rec["path"]), rows * w),
                    pa.array(np.repeat(np.arange(top, top + rows, dtype=np.int32), w)),
                    pa.array(np.tile(np.arange(w, dtype=np.int32), rows)),
                    pa.array(r), pa.array(g), pa.array(b)], schema=_ARROW)


def image_pixels(images: DataFrame) -> DataFrame:
    """Pixel rows of Spark's image source."""
    return images.select(
        F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data")).mapInArrow(_pixels, PIXELS)


def is_grayscale(pixels: DataFrame) -> DataFrame:
    """One row per image: true iff all its pixels have equal channels."""
    return pixels.groupBy("path").agg(
        F.bool_and((F.col("r") == F.col("g")) & (F.col("r") == F.col("b"))).alias("is_gray"),
        (F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny"))


def image_to_voxels(pixels: DataFrame, shapes: DataFrame) -> DataFrame:
    """A grey image becomes one slice, a colour image three: red, green, blue. ``shapes`` as of ``is_grayscale``."""
    at = attach(pixels, stage(shapes.select("path", "is_gray")), ["path"], ["y", "x"])
    one = F.array(F.struct(F.lit(0).alias("z"), F.col("r").alias("v")))
    three = F.array(*[F.struct(F.lit(i).alias("z"), F.col(c).alias("v")) for i, c in enumerate("rgb")])
    return at.select(F.col("path").alias("volume_id"), "y", "x", F.explode(
        F.when(F.col("is_gray"), one).otherwise(three)).alias("s")).select("volume_id", "s.z", "y", "x", F.col("s.v").cast("double").alias("v"))


def image_volumes(shapes: DataFrame) -> DataFrame:
    return shapes.select(
        F.col("path").alias("volume_id"), "nx", "ny", F.when(F.col("is_gray"), 1).otherwise(3).alias("nz"),
        F.lit("uint8").alias("data_type"), *[F.lit(1.0).alias(s) for s in ("sx", "sy", "sz")],
        (~F.col("is_gray")).alias("is_rgb"))


def natural_key(name: Column) -> Column:
    """Sort key in which digit runs compare as numbers; compared without case and accents."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))

    def number(run: Column) -> Column:
        bare = F.regexp_replace(run, r"^0+(?=\d)", "")
        return F.concat(F.lpad(F.length(bare).cast("string"), 10, "0"), bare)  # longer numbers are larger ones

    padded = F.transform(runs, lambda s: F.when(s.rlike(r"^\d"), number(s)).otherwise(s))
    return F.collate(F.concat_ws("", padded), "UNICODE_CI_AI")


def _numbered(pages: DataFrame, order: list) -> DataFrame:
    ordered = with_order(pages, order)
    return scan(ordered, ["stack_id"], "_pos", {"_z": F.lit(1)}, block=ORDER_BLOCK).withColumn(
        "z", (F.col("_z") - 1).cast("int")).drop("_z", "_pos")


def natural_sort_stack(files: DataFrame) -> DataFrame:
    """TIFF files (stack_id, name, ...) of a folder in natural order, as slices z = 0, 1, ..."""
    tiffs = files.where(F.lower("name").rlike(r"\.(tif|tiff)$"))
    return _numbered(tiffs, [F.col("stack_id"), natural_key(F.col("name")), F.col("name")])


def stack_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slices of page stacks and the refused stacks.

    ``pages`` (stack_id, page_no, width, height, bits, samples, photometric) in page order. All pages must have
    the size of the first; that page also decides whether 16-bit grey values are kept (``uint16``) or the red
    channel of 8-bit pixels is taken.
    """
    first = pages.groupBy("stack_id").agg(F.min_by(F.struct("width", "height", "bits", "samples", "photometric"), "page_no").alias("f"),
                                          F.count(F.lit(1)).alias("nz"))
    at = attach(pages, first, ["stack_id"], ["page_no"])
    odd = (F.col("width") != F.col("f.width")) | (F.col("height") != F.col("f.height"))
    refused = at.where(odd).groupBy("stack_id").agg(F.min("page_no").alias("page_no"), F.count(F.lit(1)).alias("pages"))
    deep = (F.col("f.samples") == 1) & F.col("f.photometric").isin(0, 1) & (F.col("f.bits") == 16)
    kept = attach(at.withColumn("data_type", F.when(deep, "uint16").otherwise("uint8")).drop("f"),
                  refused.select("stack_id"), ["stack_id"], ["page_no"], "left_anti")
    return _numbered(kept, [F.col("stack_id"), F.col("page_no")]), refused


def stack_problems(files: DataFrame) -> DataFrame:
    """Why a converted stack is refused: ``files`` of ``natural_sort_stack`` with width, height, bits, samples, photometric.

    The first slice must be grey with 8 or 16 bits, and every slice must have its size.
    """
    first = files.where(F.col("z") == 0).select("stack_id", *[F.col(c).alias(f"_{c}") for c in ("width", "height", "bits", "samples", "photometric")])
    at = attach(files, first, ["stack_id"], ["z"])
    grey = (F.col("_samples") == 1) & F.col("_photometric").isin(0, 1) & F.col("_bits").isin(8, 16)
    reason = F.when(~grey, "unsupported format in first slice").when(
        (F.col("width") != F.col("_width")) | (F.col("height") != F.col("_height")), "dimension mismatch")
    return at.withColumn("reject_reason", reason).where(F.col("reject_reason").isNotNull()).groupBy("stack_id", "reject_reason").agg(
        F.min("z").alias("first_z"), F.count(F.lit(1)).alias("slices"))


def page_voxels(pixels: DataFrame, slices: DataFrame) -> DataFrame:
    """Voxels of stacked pages: ``pixels`` (stack_id, page_no, y, x, r[, gray16]) on the slices of ``stack_pages``."""
    at = attach(pixels, slices.select("stack_id", "page_no", "z", "data_type"), ["stack_id", "page_no"], ["y", "x"])
    deep = F.col("gray16") if "gray16" in pixels.columns else F.lit(None).cast("int")
    value = F.when(F.col("data_type") == "uint16", F.coalesce(deep, F.col("r"))).otherwise(F.col("r"))
    return at.select(F.col("stack_id").alias("volume_id"), "z", "y", "x", value.cast("double").alias("v"))
