"""Edit history: an append-only log of voxel writes, merged into strokes, undone and redone.

Log rows are (mask_id, seq, op_id, merge_key, z, y, x, after_class). ``seq`` orders everything within a
mask; the rows of one operation are consecutive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..model import AXIS_COORDS, MASK_KEY
from ..scale import SCAN_BLOCK, attach, lookup, scan, stage
from .mask import Written, set_voxels


def effective_edits(log: DataFrame, mask: DataFrame, masks: DataFrame, block: int = SCAN_BLOCK) -> DataFrame:
    """Log rows that change their voxel, with the class before and after."""
    prior = scan(log, MASK_KEY, "seq", lags={"_prev": F.col("after_class")}, block=block)
    # The mask is asked once for each voxel of the log; what it holds there is joined over salted keys if it is much.
    held = stage(lookup(mask, log.select(*MASK_KEY).distinct(), MASK_KEY))
    base = attach(prior, held.withColumnRenamed("class_id", "_base"), MASK_KEY, ["seq"], "left")
    fills = masks.select("mask_id", "fill_value")
    at = attach(base, fills, ["mask_id"], ["z", "y", "x"])
    at = at.withColumn("before_class", F.coalesce("_prev", "_base", "fill_value").cast("int"))
    return at.where(F.col("before_class") != F.col("after_class")).select(*log.columns, "before_class")


def apply_edits(log: DataFrame, mask: DataFrame, masks: DataFrame, volumes: DataFrame) -> Written:
    """Mask after the whole log; only the last write of each voxel matters."""
    writes = log.select(*MASK_KEY, "seq", F.col("after_class").alias("class_id"))
    return set_voxels(mask, masks, volumes, writes)


def merge_strokes(changes: DataFrame, block: int = SCAN_BLOCK) -> DataFrame:
    """Recorded operations: neighbours with the same merge key become one.

    ``changes`` are effective edits, so operations without a change are not on the stack and do not
    separate their neighbours. Rows (mask_id, stroke, z, y, x, before_class, after_class, seq_first, seq_last).
    """
    changes = stage(changes)
    ops = changes.groupBy("mask_id", "op_id").agg(
        F.max("merge_key").alias("_key"), F.min("seq").alias("_at"))
    key = F.when(F.col("_key") != "", F.col("_key"))
    ops = stage(scan(ops.withColumn("_key", key), ["mask_id"], "_at", lags={"_before": F.col("_key")}, block=block))
    apart = F.when(F.col("_key") == F.col("_before"), 0).otherwise(1)
    ops = stage(scan(ops.withColumn("_new", apart), ["mask_id"], "_at", {"stroke": F.col("_new")}, block=block))
    named = attach(changes, ops.select("mask_id", "op_id", "stroke"), ["mask_id", "op_id"], ["z", "y", "x"])
    return named.groupBy("mask_id", "stroke", "z", "y", "x").agg(
        F.min_by("before_class", "seq").alias("before_class"), F.max_by("after_class", "seq").alias("after_class"),
        F.min("seq").alias("seq_first"), F.max("seq").alias("seq_last"))


def _last_strokes(strokes: DataFrame, n: int) -> DataFrame:
    """The newest n strokes per mask.

    The rank limit reaches the shuffle: every task passes on at most n strokes per mask.
    """
    ops = strokes.groupBy("mask_id", "stroke").agg(
        F.max((F.col("before_class") != F.col("after_class")).cast("int")).alias("_moves"))
    newest = F.row_number().over(W.partitionBy("mask_id").orderBy(F.desc("stroke")))
    return ops.withColumn("_rank", newest).where(F.col("_rank") <= int(n))


def undo(strokes: DataFrame, mask: DataFrame, masks: DataFrame, volumes: DataFrame, n: int) -> Written:
    """Takes the last n strokes back: every voxel returns to its class before the first of them."""
    last = stage(_last_strokes(strokes, n).select("mask_id", "stroke"))
    hit = attach(strokes, last, ["mask_id", "stroke"], ["z", "y", "x"], "left_semi")
    back = hit.groupBy(*MASK_KEY).agg(F.min_by("before_class", "stroke").alias("class_id"))
    return set_voxels(mask, masks, volumes, back)


def redo(strokes: DataFrame, mask: DataFrame, masks: DataFrame, volumes: DataFrame, undone: int, n: int) -> Written:
    """After ``undone`` strokes were taken back, repeats the first n of them.

    A stroke whose undo changed nothing has left the history, so it is not counted.
    """
    back = undo(strokes, mask, masks, volumes, undone)
    ready = _last_strokes(strokes, undone).where(F.col("_moves") == 1)
    oldest = F.row_number().over(W.partitionBy("mask_id").orderBy("stroke"))  # at most ``undone`` rows per mask
    again = stage(ready.withColumn("_nth", oldest).where(F.col("_nth") <= n).select("mask_id", "stroke"))
    hit = attach(strokes, again, ["mask_id", "stroke"], ["z", "y", "x"], "left_semi")
    writes = hit.select(*MASK_KEY, F.col("stroke").alias("seq"), F.col("after_class").alias("class_id"))
    return set_voxels(back.mask, masks, volumes, writes)


def dirty_slices(changes: DataFrame) -> DataFrame:
    """Slices per axis that a set of changes touches."""
    touched = F.array(*[
        F.struct(F.lit(axis).alias("axis"), F.col(fixed).alias("idx")) for axis, (fixed, _, _) in AXIS_COORDS.items()])
    return changes.select("mask_id", F.explode(touched).alias("t")).select("mask_id", "t.axis", "t.idx").distinct()
