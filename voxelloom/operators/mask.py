"""Label masks: look-up, writes, remapping, slices and set operations on sparse rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import to_class_id
from ..model import MASK_KEY, MAX_CLASS, axis_coords, coords_of_linear, inside, linear_index
from ..scale import BROADCAST_ROWS, attach, is_small, lookup, stage
from .slicing import slice_grid, slice_to_voxel


class Written(NamedTuple):
    """A new mask snapshot and the voxels that changed (mask_id, z, y, x, before_class, after_class)."""

    mask: DataFrame
    changes: DataFrame


class Remapped(NamedTuple):
    mask: DataFrame
    masks: DataFrame
    changed: DataFrame


def mask_at(points: DataFrame, mask: DataFrame, masks: DataFrame, volumes: DataFrame) -> DataFrame:
    """Class at each point (mask_id, z, y, x, ...); 0 outside the grid."""
    at = attach(points, _grids(masks, volumes), ["mask_id"], ["z", "y", "x"], "left")
    found = stage(lookup(mask, points.select(*MASK_KEY).distinct(), MASK_KEY))
    return attach(at, found, MASK_KEY, points.columns, "left").select(
        *points.columns,
        F.when(inside(), F.coalesce("class_id", "fill_value")).otherwise(0).cast("int").alias("class_id"))


def _grids(masks: DataFrame, volumes: DataFrame) -> DataFrame:
    return masks.join(volumes.select("volume_id", "nx", "ny", "nz"), "volume_id").select(
        "mask_id", "fill_value", "class_data_type", "nx", "ny", "nz")


def _max_class():
    return F.when(F.col("class_data_type") == "uint16", MAX_CLASS["uint16"]).otherwise(MAX_CLASS["uint8"])


def set_voxels(mask: DataFrame, masks: DataFrame, volumes: DataFrame, updates: DataFrame,
               limit: int = BROADCAST_ROWS) -> Written:
    """Writes class ids (mask_id, z, y, x, class_id and, for an order, seq); the last write of a voxel stays.

    Ids are rounded and clamped, voxels outside the grid ignored. Repeated writes to one voxel shrink before
    the join, so a voxel that is hit very often is no hot key. Up to ``limit`` written voxels travel to the
    mask, whose other rows are passed on without a shuffle; more are joined over shuffles.
    """
    grids = _grids(masks, volumes)
    fills = grids.select("mask_id", "fill_value")
    at = attach(updates, grids, ["mask_id"], ["z", "y", "x"]).where(inside())
    after = to_class_id(F.col("class_id"), _max_class())
    if "seq" in updates.columns:
        last = at.groupBy(*MASK_KEY).agg(F.max_by(after, F.col("seq")).alias("after_class"))
    else:
        last = at.groupBy(*MASK_KEY).agg(F.max(after).alias("after_class"))
    last = stage(last)
    old = mask.withColumnRenamed("class_id", "_old")
    few = is_small(last, limit)
    if few:
        written = F.broadcast(last.select(*MASK_KEY))
        both = last.join(stage(old.join(written, MASK_KEY, "left_semi")), MASK_KEY, "left")
    else:
        both = old.join(last, MASK_KEY, "full_outer")
    both = attach(both, fills, ["mask_id"], ["z", "y", "x"])
    both = both.withColumn("before_class", F.coalesce("_old", "fill_value"))
    both = both.withColumn("_new", F.coalesce("after_class", "before_class"))
    new = both.where(F.col("_new") != F.col("fill_value")).select(*MASK_KEY, F.col("_new").cast("int").alias("class_id"))
    if few:
        rest = attach(mask.join(written, MASK_KEY, "left_anti"), fills, ["mask_id"], ["z", "y", "x"])
        new = rest.where(F.col("class_id") != F.col("fill_value")).select(
            *MASK_KEY, F.col("class_id").cast("int").alias("class_id")).unionByName(new)
    changes = both.where(F.col("_new") != F.col("before_class")).select(
        *MASK_KEY, F.col("before_class").cast("int").alias("before_class"), F.col("_new").cast("int").alias("after_class"))
    return Written(new, changes)


def mask_slice(mask: DataFrame, masks: DataFrame, volumes: DataFrame, axis: str, idx: int) -> DataFrame:
    """Every cell of one slice with its class, the fill value where the mask has no row."""
    fixed, u, v = axis_coords(axis)
    wanted = masks.select("mask_id", "volume_id", "fill_value", F.lit(idx).alias("idx"))
    n = volumes.select("volume_id", F.col(f"n{fixed}").alias("_n"))
    wanted = wanted.join(n, "volume_id").where(F.col("idx").between(0, F.col("_n") - 1)).drop("_n")
    grid = slice_grid(volumes, axis, wanted)
    cells = attach(grid, wanted.drop("idx"), ["volume_id"], ["v", "u"])
    rows = mask.where(F.col(fixed) == idx).select("mask_id", F.col(v).alias("v"), F.col(u).alias("u"), "class_id")
    return cells.join(rows, ["mask_id", "v", "u"], "left").select(
        "mask_id", "axis", "idx", "v", "u", F.coalesce("class_id", "fill_value").cast("int").alias("class_id"))


def voxels_of_class(mask: DataFrame, masks: DataFrame, volumes: DataFrame, class_id: int) -> DataFrame:
    """Voxels of a listed class with their linear index; an id outside the mask's range has none."""
    rows = mask.where(F.col("class_id") == class_id)
    at = attach(rows, _grids(masks, volumes), ["mask_id"], ["z", "y", "x"])
    return at.where(F.lit(class_id).between(0, _max_class())).select(*MASK_KEY, linear_index().alias("linear"))


def remap(mask: DataFrame, masks: DataFrame, volumes: DataFrame, mapping: DataFrame) -> Remapped:
    """Replaces classes by a mapping (mask_id, source, target); ``changed`` counts voxels per source.

    A mapped fill value moves with it, so the rest of the grid is never materialised.
    """
    limit = masks.select("mask_id", _max_class().alias("_max"))
    good = attach(mapping, limit, ["mask_id"], ["source"]).where(
        F.col("source").between(0, F.col("_max")) & F.col("target").between(0, F.col("_max"))
        & (F.col("source") != F.col("target"))).drop("_max")
    new_masks = masks.join(
        good.withColumnRenamed("source", "fill_value"), ["mask_id", "fill_value"], "left",
    ).withColumn("_fill", F.coalesce("target", "fill_value")).withColumnRenamed("fill_value", "_old_fill")
    rule = good.withColumnsRenamed({"source": "class_id"})
    at = attach(mask, rule, ["mask_id", "class_id"], ["z", "y", "x"], "left")
    at = at.withColumn("_new", F.coalesce("target", "class_id").cast("int"))
    fills = new_masks.select("mask_id", "_fill")
    kept = attach(at, fills, ["mask_id"], ["z", "y", "x"]).where(F.col("_new") != F.col("_fill"))
    listed = at.where(F.col("target").isNotNull()).groupBy("mask_id", F.col("class_id").alias("source")).agg(
        F.count(F.lit(1)).alias("changed"))
    total = mask.groupBy("mask_id").agg(F.count(F.lit(1)).alias("_listed"))
    filled = new_masks.where(F.col("target").isNotNull()).join(total, "mask_id", "left").join(
        volumes.select("volume_id", (F.col("nx").cast("bigint") * F.col("ny") * F.col("nz")).alias("_all")), "volume_id",
    ).select("mask_id", F.col("_old_fill").alias("source"),
             (F.col("_all") - F.coalesce("_listed", F.lit(0))).alias("changed"))
    return Remapped(
        kept.select(*MASK_KEY, F.col("_new").alias("class_id")),
        new_masks.withColumn("fill_value", F.col("_fill").cast("int")).select(*masks.columns),
        listed.unionByName(filled).groupBy("mask_id", "source").agg(F.sum("changed").alias("changed")))


def remap_class(mask: DataFrame, masks: DataFrame, volumes: DataFrame, source: int, target: int) -> Remapped:
    pair = masks.select("mask_id", F.lit(source).alias("source"), F.lit(target).alias("target"))
    return remap(mask, masks, volumes, pair)


def used_class_ids(mask: DataFrame, masks: DataFrame) -> DataFrame:
    """Distinct class ids above 0 per mask."""
    fill = masks.select("mask_id", F.col("fill_value").cast("int").alias("class_id"))
    return mask.select("mask_id", "class_id").distinct().unionByName(fill).where(F.col("class_id") > 0).distinct()


def fill(mask: DataFrame, masks: DataFrame, class_id: int) -> tuple[DataFrame, DataFrame]:
    """Whole grid to one class: the fill value changes and no sparse row is left."""
    value = to_class_id(F.lit(class_id), _max_class())
    return mask.limit(0), masks.withColumn("fill_value", value)


def clear(mask: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    return fill(mask, masks, 0)


def write_selection(mask: DataFrame, masks: DataFrame, volumes: DataFrame, axis: str, selection: DataFrame,
                    class_id: int) -> Written:
    """Writes a class to selected slice cells (volume_id, idx, v, u) of every mask on that volume."""
    picks = selection.select("volume_id", "idx", F.col("u").alias("px"), F.col("v").alias("py"))
    spots = slice_to_voxel(picks, volumes, axis)
    at = attach(spots, masks.select("mask_id", "volume_id"), ["volume_id"], ["z", "y", "x"])
    return set_voxels(mask, masks, volumes, at.select(*MASK_KEY, F.lit(class_id).alias("class_id")))


def with_linear(changes: DataFrame, masks: DataFrame, volumes: DataFrame) -> DataFrame:
    """Changes in the compact undo form (mask_id, linear, before_class)."""
    at = attach(changes, _grids(masks, volumes), ["mask_id"], ["z", "y", "x"])
    return at.select("mask_id", linear_index().alias("linear"), "before_class")


def restore(mask: DataFrame, masks: DataFrame, volumes: DataFrame, undo: DataFrame) -> Written:
    """Writes back (mask_id, linear, before_class)."""
    at = attach(undo, _grids(masks, volumes).select("mask_id", "nx", "ny"), ["mask_id"], ["linear"])
    back = coords_of_linear(at).select(*MASK_KEY, F.col("before_class").alias("class_id"))
    return set_voxels(mask, masks, volumes, back)


def apply_bits(mask: DataFrame, masks: DataFrame, volumes: DataFrame, bits: DataFrame, class_id: int) -> Written:
    """Writes a class wherever (mask_id, linear, bit) has a non-zero bit."""
    at = attach(bits.where(F.col("bit") != 0), _grids(masks, volumes).select("mask_id", "nx", "ny"),
                ["mask_id"], ["linear"])
    rows = coords_of_linear(at).select(*MASK_KEY, F.lit(class_id).alias("class_id"))
    return set_voxels(mask, masks, volumes, rows)


def only_class(mask: DataFrame, active: DataFrame) -> DataFrame:
    """Rows of each mask's active class (mask_id, class_id); the others show as background."""
    return attach(mask, active, ["mask_id", "class_id"], ["z", "y", "x"], "left_semi")


def ensure_mask(mask: DataFrame, masks: DataFrame, volumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keeps masks whose grid (gx, gy, gz) equals the volume's; others start empty with fill 0."""
    same = (F.col("gx") == F.col("nx")) & (F.col("gy") == F.col("ny")) & (F.col("gz") == F.col("nz"))
    at = masks.join(volumes.select("volume_id", "nx", "ny", "nz"), "volume_id").withColumn("kept", F.coalesce(same, F.lit(False)))
    new = at.withColumns({
        "fill_value": F.when(F.col("kept"), F.col("fill_value")).otherwise(0).cast("int"),
        "gx": F.col("nx"), "gy": F.col("ny"), "gz": F.col("nz")}).select(*masks.columns, "kept")
    rows = attach(mask, at.where("kept").select("mask_id"), ["mask_id"], ["z", "y", "x"], "left_semi")
    return rows, new


def union_classes(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.select(*key).unionByName(b.select(*key)).distinct()


def difference_classes(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.select(*key).join(b.select(*key), key, "left_anti")


def intersect_classes(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.select(*key).join(b.select(*key), key, "left_semi")
