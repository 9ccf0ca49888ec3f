"""Registered queries of the structures that spare reading: data source, brick tree, command history and others."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..model import linear_index
from ..operators import appearance, histogram, history, measure, raymerge, rectindex, rle, runsets, sketches
from ..scale import attach, stage
from ..sources import bricks, bricktree, colocated, pyramidstore, volume_format
from ..streaming import edits as edit_stream, voxel_state
from .grids import EVENT_CLASS, Grids
from .queries import _bright, _projected, _stats, query, r6
from .source_queries import _edit_stream, _folder, _net_moves, _spread_edits


# ---- data source -----------------------------------------------------------------------------

@query
def volume_source(g):
    """Both grids as float32 files, written and read through the data source; slices of one range, others picked out."""
    path = _folder(g, "volumes")
    volume_format.write_volumes(g.voxels, g.volumes.withColumn("data_type", F.lit("float32")), path)
    ranged = volume_format.read_volumes(g.spark, path, "volume_id = 'events' and z between 3 and 9 and x < 15", 8192)
    picked = volume_format.read_volumes(g.spark, path, "volume_id = 'orders' and z in (0, 2, 3) and y >= 10", 8192)
    return ranged.unionByName(picked)


# ---- command history -------------------------------------------------------------------------

LOGS = 16


def _commands(g: Grids) -> DataFrame:
    """Every event is a command; half of them operations, three in ten undo."""
    turn = "event_id * 7919 div 37 % 10"
    return g.table("events").selectExpr(
        f"concat('m_', event_id % {LOGS}) as mask_id", "event_id as seq",
        f"case when {turn} < 5 then 'do' when {turn} < 8 then 'undo' else 'redo' end as kind")


@query
def history_match(g):
    return history.match(_commands(g), depth=20, block=256)


@query
def history_mask(g):
    masks = g.edit_volumes.selectExpr("volume_id", f"explode(sequence(0, {LOGS - 1})) as no").selectExpr(
        "concat('m_', no) as mask_id", "volume_id", "'uint8' as class_data_type", "0 as fill_value")
    changes = g.table("events").selectExpr(
        f"concat('m_', event_id % {LOGS}) as mask_id", "event_id as op_seq", "0 as z",
        "cast(((event_id * 7919) % 500) div 20 as int) as y", "cast((event_id * 7919) % 20 as int) as x", f"{EVENT_CLASS} as after_class")
    return history.replay(_commands(g), changes, g.no_mask, masks, g.edit_volumes, block=256).mask


# ---- brick tree ------------------------------------------------------------------------------

def _tree(g: Grids) -> str:
    path = _folder(g, "tree")
    bricktree.write_tree(g.voxels, g.volumes, path, file_bytes=1 << 16)
    return path


@query
def tree_levels(g):
    return bricktree.read_levels(g.spark, _tree(g))


@query
def project_visible_tree(g):
    return _projected(bricktree.project_visible(g.spark, _tree(g), "xy", 48_000))


@query
def threshold_tree(g):
    return bricktree.threshold(g.spark, _tree(g), 49_000, 1_000_000)


# ---- streams ---------------------------------------------------------------------------------

@query
def stream_voxel_state(g):
    """What a stream of all events changes in a mask; every tenth edit lies outside its grid, every one comes twice."""
    path = _folder(g, "edits")
    edits = _edit_stream(g).withColumns({"mask_id": F.lit("m_type"), "x": F.expr("if(seq % 10 = 0, x + 20, x)")})
    twice = edits.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    voxel_state.follow(twice, path + "/log", path + "/checkpoint", mask=g.mask, masks=g.masks, volumes=g.volumes).awaitTermination()
    return _net_moves(edit_stream.change_log(g.spark, path + "/log"))


@query
def stream_voxel_stats(g):
    """Running statistics per class over all slices of events: one state entry per voxel."""
    path = _folder(g, "stats")
    voxels = g.voxels.where("volume_id = 'events'").withColumn("volume_id", F.lit("edit"))
    voxel_state.follow_stats(_spread_edits(g), g.edit_masks, stage(voxels), path + "/moments", path + "/checkpoint").awaitTermination()
    moments = edit_stream.current_moments(g.spark, path + "/moments").where("class_id > 0")
    return _stats(measure.stats_of(moments, g.edit_volumes))


# ---- co-located bricks, merged rays, run sets ------------------------------------------------

@query
def roi_stats_colocated(g):
    grid, mask = (f"voxelloom_{uuid.uuid4().hex}_{kind}" for kind in ("grid", "mask"))
    colocated.write_grid(g.voxels, g.volumes, grid, buckets=8)
    colocated.write_mask(g.mask, g.masks, g.volumes, mask, buckets=8)
    return _stats(colocated.roi_stats(g.spark, grid, mask, g.volumes, g.rois))


@query
def composite_bricks(g):
    shade = raymerge.tf_shade(appearance.tf_lut(g.spark, "Grayscale"), 0.0, 50_000.0)
    out = raymerge.composite(stage(bricks.to_bricks(g.voxels, g.volumes, 8)), "xy", shade, 8)
    return out.select("volume_id", "row", "col", *[r6(c).alias(c) for c in ("r", "g", "b", "alpha")])


def _run_sets(g: Grids) -> tuple[DataFrame, DataFrame]:
    """Runs of class 1 and of bright voxels."""
    grids = g.masks.join(g.volumes.select("volume_id", "nx", "ny"), "volume_id").select("mask_id", "nx", "ny")

    def runs(cells: DataFrame) -> DataFrame:
        at = attach(cells, grids, ["mask_id"], ["z", "y", "x"])
        return stage(rle.islands(at.select("mask_id", linear_index().alias("linear")), ["mask_id"]))
    return runs(g.mask.where("class_id = 1").drop("class_id")), runs(_bright(g))


@query
def runs_union(g):
    return runsets.union(*_run_sets(g), ["mask_id"])


@query
def runs_difference(g):
    return runsets.difference(*_run_sets(g), ["mask_id"])


@query
def runs_intersection(g):
    return runsets.intersection(*_run_sets(g), ["mask_id"])


@query
def rect_range_indexed(g):
    return rectindex.rect_range(g.rects, g.voxels, g.volumes, "xy", tile=8)


# ---- sketches, pyramid upkeep ----------------------------------------------------------------

def _sketched(g: Grids, some: str) -> DataFrame:
    packed = stage(bricks.to_bricks(g.voxels, g.volumes, 8)).where(some)
    small = stage(sketches.brick_sketches(packed, 16))
    out = sketches.quantiles(small, packed, ["volume_id"], histogram.WINDOW_QUANTILES)
    return out.withColumn("value", r6("value"))


@query
def percentiles_sketched(g):
    return _sketched(g, "true")


@query
def percentiles_brick_range(g):
    """Quantiles of the part of every grid in a range of brick keys."""
    return _sketched(g, "bz <= 1 and by between 1 and 2")


@query
def pyramid_upkeep(g):
    """All levels of the grids after two updates; every event sets a voxel, some of them outside the grid."""
    path = _folder(g, "pyramid")
    pyramidstore.write_pyramid(g.voxels, g.volumes, path, size=8, file_bytes=1 << 16)
    changes = g.table("events").selectExpr(
        "'events' as volume_id", "cast(event_id % 3 as int) as z", "cast(event_id % 7 as int) as y",
        "cast(event_id div 7 % 23 as int) as x", "cast(event_id as double) as v", "event_id as seq")
    for part in (0, 1):
        pyramidstore.update(g.spark, path, changes.where(f"seq % 2 = {part}"), size=8, file_bytes=1 << 16)
    levels = [pyramidstore.read_voxels(g.spark, path, name, 8).select(F.lit(name).alias("level"), "volume_id", "z", "y", "x", r6("v").alias("v"))
              for name in ("low", "mid", "full")]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])
