"""Selections: thresholds, region growing, brush strokes, island removal, mask logits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import clamp, dbl, round_half_up, to_class_id
from ..model import AXES, axis_coords, inside
from ..scale import attach, stage
from .components import components
from .slicing import slices

SLICE_KEY = ["volume_id", "axis", "idx"]
# Smallest kept component as share of the slice, with its bounds, and the logit thresholds.
ISLAND_SHARE = 5e-5
ISLAND_BOUNDS = (12, 96)
LOGIT_THRESHOLD = 0.0
PREVIEW_LOGIT_THRESHOLD = 0.12


def in_band(value: Column, a: float, b: float) -> Column:
    """Inclusive at both ends; the ends may come in either order."""
    return dbl(value).between(F.lit(float(min(a, b))), F.lit(float(max(a, b))))


def threshold_slice(cells: DataFrame, a: float, b: float) -> DataFrame:
    return cells.where(in_band(F.col("value"), a, b)).select(*SLICE_KEY, "v", "u")


def threshold_apply(voxels: DataFrame, volumes: DataFrame, a: float, b: float, radius: int,
                    centers: DataFrame | None = None) -> DataFrame:
    """Voxels in the band on the slices around the current one, on all three axes at once.

    ``centers`` (volume_id, cz, cy, cx) holds the current slices, by default the central ones.
    """
    r = max(0, int(radius))
    if centers is None:
        centers = volumes.select("volume_id", *[
            F.expr(f"cast(n{c} div 2 as int)").alias(f"c{c}") for c in ("z", "y", "x")])
    near = F.lit(False)
    for c in ("z", "y", "x"):
        near = near | F.col(c).between(F.col(f"c{c}") - r, F.col(f"c{c}") + r)
    hits = voxels.where(in_band(F.col("v"), a, b))
    return attach(hits, centers, ["volume_id"], ["z", "y", "x"]).where(near).select("volume_id", "z", "y", "x")


def region_grow(cells: DataFrame, seeds: DataFrame, tolerance: float | Column, connectivity: int = 8,
                tile: int = 256) -> DataFrame:
    """Cells connected to each slice's seed (volume_id, axis, idx, sv, su) within a tolerance of its value.

    Every slice has at most one seed; one outside the slice selects nothing. All slices and volumes grow
    in the same job. ``tolerance`` may be a column of ``seeds``.
    """
    seeds = seeds.select("*").withColumn("_tol", F.greatest(F.lit(0.0), dbl(tolerance)))
    spots = seeds.select(*SLICE_KEY, F.col("sv").alias("v"), F.col("su").alias("u"), "_tol")
    # One row per seed; staged, so that the cells are read once for it.
    valued = stage(attach(cells, spots, [*SLICE_KEY, "v", "u"], ["v", "u"]).select(
        *SLICE_KEY, dbl("value").alias("_seed"), F.col("v").alias("sv"), F.col("u").alias("su"), "_tol"))
    at = attach(cells, valued, SLICE_KEY, ["v", "u"])
    similar = at.where(F.abs(dbl("value") - F.col("_seed")) <= F.col("_tol"))
    parts = components(similar, SLICE_KEY, connectivity, tile)
    start = stage(attach(parts, spots.drop("_tol"), [*SLICE_KEY, "v", "u"], ["v", "u"]).select(*SLICE_KEY, "label"))
    return attach(parts, start, [*SLICE_KEY, "label"], ["v", "u"], "left_semi").select(*SLICE_KEY, "v", "u")


def region_grow_slices(voxels: DataFrame, volumes: DataFrame, axis: str, picks: DataFrame, radius: int,
                       tolerance: float | Column, tile: int = 256) -> DataFrame:
    """Grows on every slice around the pick (volume_id, idx, px, py), each from its own value at the same spot."""
    _, u, v = axis_coords(axis)
    r = max(0, int(radius))
    n = F.col(f"n{axis_coords(axis)[0]}")
    at = attach(picks, volumes.select("volume_id", "nx", "ny", "nz"), ["volume_id"], ["px", "py"])
    low, high = F.greatest(F.lit(0), F.col("idx") - r), F.least(n - 1, F.col("idx") + r)
    seeds = at.where(low <= high).select(
        "volume_id", F.lit(axis).alias("axis"), F.explode(F.sequence(low, high).cast("array<int>")).alias("idx"),
        clamp(F.floor(dbl("py")), 0, F.col(f"n{v}") - 1).cast("int").alias("sv"),
        clamp(F.floor(dbl("px")), 0, F.col(f"n{u}") - 1).cast("int").alias("su"),
        *([] if not isinstance(tolerance, Column) else [tolerance.alias("tolerance")]))
    cells = slices(voxels, axis, seeds)
    return region_grow(cells, seeds, F.col("tolerance") if isinstance(tolerance, Column) else tolerance, tile=tile)


def brush_stamp(strokes: DataFrame, masks: DataFrame, volumes: DataFrame) -> DataFrame:
    """Voxels painted by strokes (mask_id, seq, axis, idx, u, v, radius, class_id, slice_radius).

    A stroke is a disc du^2 + dv^2 <= r^2 (r >= 1) repeated on the slices within ``slice_radius``. Rows
    (mask_id, seq, z, y, x, after_class) form an edit log; which of them change something is decided there.
    """
    s = strokes.withColumns({
        "_r": F.greatest(F.lit(1), F.floor("radius")).cast("int"),
        "_sr": F.greatest(F.lit(0), F.floor(F.coalesce("slice_radius", F.lit(0)))).cast("int"),
        "_cu": F.floor("u").cast("int"), "_cv": F.floor("v").cast("int"),
    })
    s = s.withColumn("_f", F.explode(F.expr("sequence(idx - _sr, idx + _sr)")))
    s = s.withColumn("_dv", F.explode(F.expr("sequence(-_r, _r)")))
    s = s.withColumn("_w", F.floor(F.sqrt(dbl(F.col("_r") * F.col("_r") - F.col("_dv") * F.col("_dv")))).cast("int"))
    s = s.withColumn("_du", F.explode(F.expr("sequence(-_w, _w)")))
    place = {"_f": F.col("_f"), "_u": F.col("_cu") + F.col("_du"), "_v": F.col("_cv") + F.col("_dv")}
    spot = {}
    for c in ("z", "y", "x"):
        when = None
        for axis in AXES:
            fixed, u, v = axis_coords(axis)
            source = place[{fixed: "_f", u: "_u", v: "_v"}[c]]
            test = F.col("axis") == axis
            when = F.when(test, source) if when is None else when.when(test, source)
        spot[c] = when.cast("int")
    known = masks.join(volumes.select("volume_id", "nx", "ny", "nz"), "volume_id").select(
        "mask_id", "class_data_type", "nx", "ny", "nz")
    at = attach(s.withColumns(spot), known, ["mask_id"], ["z", "y", "x"]).where(inside())
    top = F.when(F.col("class_data_type") == "uint16", 65535).otherwise(255)
    return at.select("mask_id", "seq", "z", "y", "x", to_class_id(F.col("class_id"), top).alias("after_class"))


def drop_small_islands(selection: DataFrame, areas: DataFrame, keys: Sequence[str] = SLICE_KEY,
                       tile: int = 256) -> DataFrame:
    """Removes 4-connected components smaller than clamp(round(area / 20000), 12, 96) cells.

    ``areas`` (keys, area) holds the slice areas. Only the sizes of small components are joined back.
    """
    keys = list(keys)
    parts = components(selection, keys, 4, tile)
    sized = parts.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("size"))
    least = clamp(round_half_up(dbl("area") * F.lit(ISLAND_SHARE)), *ISLAND_BOUNDS)
    small = attach(sized, areas.select(*keys, "area"), keys, ["label"]).where(F.col("size") < least)
    return attach(parts, stage(small.select(*keys, "label")), [*keys, "label"], ["v", "u"], "left_anti").select(*keys, "v", "u")


def decode_mask_logits(logits: DataFrame, sizes: DataFrame, threshold: float = LOGIT_THRESHOLD) -> DataFrame:
    """Selection from predicted masks: the best score (the first of equals), stretched to the slice, logit > t.

    ``logits`` (slice_id, mask_no, score, v, u, logit) on rasters of mw x mh; ``sizes`` (slice_id, mw, mh, w, h).
    """
    score = F.when(F.isnan("score") | F.col("score").isNull(), F.lit(float("-inf"))).otherwise(dbl("score"))
    best = stage(logits.groupBy("slice_id").agg(F.max_by("mask_no", F.struct(score, -F.col("mask_no"))).alias("mask_no")))
    chosen = attach(logits, best, ["slice_id", "mask_no"], ["v", "u"]).where(dbl("logit") > F.lit(float(threshold)))
    at = attach(chosen, sizes, ["slice_id"], ["v", "u"])

    def readers(c: str, src: str, dst: str) -> Column:
        first = f"(cast({c} as bigint) * {dst} + {src} - 1) div {src}"
        last = f"((cast({c} as bigint) + 1) * {dst} - 1) div {src}"
        return F.expr(f"case when {first} <= {last} then sequence({first}, {last}) else cast(array() as array<bigint>) end")

    rows = at.withColumn("_v", F.explode(readers("v", "mh", "h"))).withColumn("_u", F.explode(readers("u", "mw", "w")))
    return rows.select("slice_id", F.col("_v").cast("int").alias("v"), F.col("_u").cast("int").alias("u"))
