"""Slabs of volumes that arrive in any order; a volume is complete once all were seen.

Until then its slices come from the low-resolution grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..scale import attach
from .sink import read_batches, write_batches

SEEN = "volume_id string, bucket bigint, seen bigint"


def seen_slabs(arrivals: DataFrame) -> DataFrame:
    """Distinct slabs (volume_id, slab_no) per volume and bucket of 32768 slab numbers.

    A repeated slab sets the same bit again. The bitmap merges map-side, so state and shuffle stay small for a
    volume with many slabs.
    """
    number = F.col("slab_no").cast("bigint") + 1
    return arrivals.groupBy("volume_id", F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(number))).alias("seen"))


def follow(arrivals: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    return write_batches(seen_slabs(arrivals), path, checkpoint, once=once)


def progress(spark: SparkSession, path: str, volumes: DataFrame) -> DataFrame:
    """Arrived and expected slabs per volume (volumes: volume_id, slabs)."""
    newest = read_batches(spark, path, SEEN).groupBy("volume_id", "bucket").agg(F.max("seen").alias("seen"))
    got = newest.groupBy("volume_id").agg(F.sum("seen").alias("seen"))
    return volumes.select("volume_id", F.col("slabs").cast("bigint").alias("slabs")).join(got, "volume_id", "left").select(
        "volume_id", "slabs", F.coalesce("seen", F.lit(0)).alias("seen"),
        (F.coalesce("seen", F.lit(0)) >= F.col("slabs")).alias("complete"))


def best_available(full: DataFrame, low: DataFrame, state: DataFrame) -> DataFrame:
    """Slice cells of complete volumes from the full grid, of the others from the low-resolution one."""
    ready = state.where("complete").select("volume_id")
    key = ["volume_id"]
    exact = attach(full, ready, key, ["v", "u"], "left_semi").withColumn("is_low_res", F.lit(False))
    rough = attach(low, ready, key, ["v", "u"], "left_anti").withColumn("is_low_res", F.lit(True))
    return exact.unionByName(rough)
