"""Registry of regions of interest. A mask has at most 65535 of them, one per class id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.color import roi_color
from ..functions.numeric import dbl
from ..model import ROIS
from ..scale import is_small, stage
from .mask import Remapped, Written, _max_class, remap, set_voxels

NO_FREE_CLASS = "no free class id"


def class_limit(max_class: int | None = None):
    """Highest class id of a mask: the given one, else that of its data type."""
    return _max_class() if max_class is None else F.lit(max_class)


def free_class_ids(masks: DataFrame, rois: DataFrame, max_class: int | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Unused class ids of every mask, ranked from the smallest; only those up to rank ``n`` of ``asked`` (mask_id, n)."""
    last = masks.select("mask_id", class_limit(max_class).alias("_last"))
    if asked is not None:
        # The nth free id is at most n above the number of ids that are taken.
        taken = rois.groupBy("mask_id").agg(F.count_distinct("class_id").alias("_taken"))
        last = last.join(asked, "mask_id").join(taken, "mask_id", "left").where("n >= 1").select(
            "mask_id", F.least("_last", F.col("n") + F.coalesce("_taken", F.lit(0))).cast("int").alias("_last"))
    slots = last.select("mask_id", F.explode(F.sequence(F.lit(1), F.col("_last"))).alias("class_id"))
    free = slots.join(rois.select("mask_id", "class_id").distinct(), ["mask_id", "class_id"], "left_anti")
    return free.withColumn("rank", F.row_number().over(W.partitionBy("mask_id").orderBy("class_id")))


def next_class_id(masks: DataFrame, rois: DataFrame, max_class: int | None = None) -> DataFrame:
    """Smallest unused id per mask, null when all are taken."""
    first = masks.select("mask_id", F.lit(1).alias("n"))
    free = free_class_ids(masks, rois, max_class, first).groupBy("mask_id").agg(F.min("class_id").alias("next_class_id"))
    return masks.select("mask_id").join(free, "mask_id", "left")


def id_number():
    """Number of an automatic id ``roi-n``, null for other ids."""
    digits = F.regexp_extract("roi_id", r"(?i)^roi-(\d+)$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def _counters(masks: DataFrame, rois: DataFrame) -> DataFrame:
    """Next automatic id number and ordinal of every mask."""
    seen = rois.groupBy("mask_id").agg(
        F.coalesce(F.max(id_number()), F.lit(0)).alias("_ids"), F.coalesce(F.max("ordinal"), F.lit(0)).alias("_ord"))
    return masks.select("mask_id").join(seen, "mask_id", "left").fillna(0, ["_ids", "_ord"])


def _asked(wanted: DataFrame) -> DataFrame:
    return wanted.groupBy("mask_id").agg(F.max("nth").alias("n"))


def refused_rois(masks: DataFrame, rois: DataFrame, wanted: DataFrame, max_class: int | None = None) -> DataFrame:
    """The requests that ``add_rois`` has no entry for, with a reject_reason."""
    free = free_class_ids(masks, rois, max_class, _asked(wanted)).select("mask_id", F.col("rank").alias("nth"))
    known = masks.select("mask_id", F.lit(True).alias("_known"))
    reason = F.when(F.col("_known").isNull(), "no such mask").when(F.col("nth") < 1, "not a request number").otherwise(NO_FREE_CLASS)
    return wanted.join(free, ["mask_id", "nth"], "left_anti").join(known, "mask_id", "left").withColumn(
        "reject_reason", reason).drop("_known")


def add_rois(masks: DataFrame, rois: DataFrame, wanted: DataFrame, max_class: int | None = None) -> DataFrame:
    """New entries for requests (mask_id, nth[, name, color_hex]), nth = 1, 2, ... per mask.

    The nth request takes the nth free class id; those beyond the last free id are in ``refused_rois``.
    """
    free = free_class_ids(masks, rois, max_class, _asked(wanted)).withColumnRenamed("rank", "nth")
    at = wanted.join(free, ["mask_id", "nth"]).join(_counters(masks, rois), "mask_id")
    ordinal = F.col("_ord") + F.col("nth")
    name = F.concat(F.lit("ROI "), ordinal.cast("string"))
    color = roi_color(ordinal - 1)
    if "name" in wanted.columns:
        name = F.coalesce(F.col("name"), name)
    if "color_hex" in wanted.columns:
        color = F.coalesce(F.col("color_hex"), color)
    return at.select(
        "mask_id", F.concat(F.lit("roi-"), (F.col("_ids") + F.col("nth")).cast("string")).alias("roi_id"), "class_id",
        name.alias("name"), color.alias("color_hex"), F.lit(True).alias("visible"), F.lit(False).alias("locked"),
        ordinal.cast("int").alias("ordinal"))


def add_rois_with_class(candidates: DataFrame) -> DataFrame:
    """Registry built from candidates (mask_id, nth, class_id, roi_id, name, color_hex, visible, locked).

    Candidates are taken in the order ``nth``; one whose class or id is already registered is refused. Each
    round settles the candidates that come first for both their class and their id, so nothing is processed
    one by one; blank ids then get automatic numbers. Every round registers a class in each mask that still has
    candidates, so there are at most as many rounds as the mask with the most classes has classes; only an order in which each
    candidate waits for the one before takes as many.
    """
    blank = F.trim(F.coalesce("roi_id", F.lit(""))) == ""
    left = (candidates.where(F.col("class_id").isNotNull() & ~F.isnan(dbl("class_id"))).withColumns({
        "class_id": F.greatest(F.lit(1), F.floor("class_id")).cast("int"),
        "roi_id": F.when(~blank, F.trim("roi_id")),
    }))
    # A later candidate for the same class and id is refused whatever becomes of the first.
    left = left.withColumn("_first", F.struct("nth", *[c for c in left.columns if c != "nth"])).groupBy("mask_id", "class_id", "roi_id").agg(
        F.min_by("_first", "nth").alias("_first")).select(*[F.col(f"_first.{c}").alias(c) for c in left.columns])
    left = stage(left)
    taken = None
    while True:
        by_class = left.groupBy("mask_id", "class_id").agg(F.min("nth").alias("_c"))
        by_id = left.where(F.col("roi_id").isNotNull()).groupBy("mask_id", "roi_id").agg(F.min("nth").alias("_i"))
        first = left.join(by_class, ["mask_id", "class_id"]).join(by_id, ["mask_id", "roi_id"], "left").where(
            (F.col("nth") == F.col("_c")) & (F.col("_i").isNull() | (F.col("nth") == F.col("_i"))))
        first = stage(first.select(*left.columns))
        if first.isEmpty():
            break
        taken = first if taken is None else taken.unionByName(first)
        left = stage(left.join(first.select("mask_id", "class_id"), ["mask_id", "class_id"], "left_anti").join(
            first.select("mask_id", "roi_id"), ["mask_id", "roi_id"], "left_anti"))
    taken = first if taken is None else taken
    run = W.partitionBy("mask_id").orderBy("nth")  # at most one row per class id
    before = run.rowsBetween(W.unboundedPreceding, -1)
    auto = F.when(F.col("roi_id").isNull(), 1).otherwise(0)
    numbered = taken.withColumns({"ordinal": F.row_number().over(run), "_a": F.coalesce(F.sum(auto).over(before), F.lit(0))})
    own = F.coalesce(id_number() + 1 - F.col("_a"), F.lit(1))
    numbered = numbered.withColumn("_n", F.greatest(F.lit(1), F.coalesce(F.max(own).over(before), F.lit(1))) + F.col("_a"))
    return numbered.select(
        "mask_id", F.coalesce("roi_id", F.concat(F.lit("roi-"), F.col("_n").cast("string"))).alias("roi_id"), "class_id",
        F.coalesce(F.when(F.col("name") != "", F.col("name")), F.concat(F.lit("ROI "), F.col("ordinal").cast("string"))).alias("name"),
        F.coalesce(F.when(F.col("color_hex") != "", F.col("color_hex")), roi_color(F.col("ordinal") - 1)).alias("color_hex"),
        F.coalesce("visible", F.lit(True)).alias("visible"), F.coalesce("locked", F.lit(False)).alias("locked"), "ordinal")


def find_roi(rois: DataFrame, roi_id: str | None = None, class_id: int | None = None) -> DataFrame:
    if roi_id is not None:
        rois = rois.where(F.col("roi_id") == roi_id)
    if class_id is not None:
        rois = rois.where(F.col("class_id") == class_id)
    return rois


def delete_rois(mask: DataFrame, masks: DataFrame, volumes: DataFrame, rois: DataFrame,
                doomed: DataFrame) -> tuple[Remapped, DataFrame, DataFrame]:
    """Removes entries (mask_id, roi_id): their classes become 0, the first one left is active next."""
    key = ["mask_id", "roi_id"]
    gone = rois.join(doomed.select(*key), key, "left_semi")
    pairs = gone.select("mask_id", F.col("class_id").alias("source"), F.lit(0).alias("target"))
    left = rois.join(doomed.select(*key), key, "left_anti")
    active = left.groupBy("mask_id").agg(F.min_by("roi_id", "ordinal").alias("active_roi_id"))
    return remap(mask, masks, volumes, pairs), left, active


def duplicate_roi(mask: DataFrame, masks: DataFrame, volumes: DataFrame, rois: DataFrame,
                  sources: DataFrame, max_class: int | None = None) -> tuple[Written, DataFrame]:
    """Copies one region per mask (mask_id, roi_id). A voxel has one class, so the copy takes the voxels over.

    A mask without a free class id, as ``next_class_id`` tells, stays as it is.
    """
    origin = rois.join(sources.select("mask_id", "roi_id"), ["mask_id", "roi_id"], "left_semi")
    wanted = origin.select("mask_id", F.lit(1).alias("nth"), F.concat("name", F.lit(" Copy")).alias("name"), "color_hex",
                           F.col("class_id").alias("source"))
    new = add_rois(masks, rois, wanted.drop("source"), max_class)
    move = wanted.select("mask_id", F.col("source").alias("class_id")).join(
        new.select("mask_id", F.col("class_id").alias("_to")), "mask_id")
    rows = mask.join(F.broadcast(move) if is_small(move) else move, ["mask_id", "class_id"])
    written = set_voxels(mask, masks, volumes, rows.select("mask_id", "z", "y", "x", F.col("_to").alias("class_id")))
    return written, rois.select(*ROIS.fieldNames()).unionByName(new)
