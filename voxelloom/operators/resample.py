"""Resampling of grids, label masks and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import dbl
from ..model import DIM_OF
from ..scale import attach
from .catalog import LEVELS

MAX_SHOWN_CLASS = 255  # Fixed value: of the 8-bit display form.


def z_decimate(voxels: DataFrame, step: int = 4) -> DataFrame:
    """Every ``step``-th slice, renumbered."""
    return voxels.where(F.col("z") % step == 0).withColumn("z", F.expr(f"cast(z div {step} as int)"))


def z_decimate_volumes(volumes: DataFrame, step: int = 4) -> DataFrame:
    return volumes.withColumns({
        "nz": F.ceil(dbl("nz") / F.lit(float(step))).cast("int"), "sz": F.col("sz") * F.lit(float(step))})


def downsampled_volumes(volumes: DataFrame, k: int) -> DataFrame:
    return volumes.withColumns({
        **{n: F.ceil(dbl(n) / F.lit(float(k))).cast("int") for n in ("nx", "ny", "nz")},
        **{s: F.col(s) * F.lit(float(k)) for s in ("sx", "sy", "sz")},
        "data_type": F.lit("float32"),
    })


def downsample(voxels: DataFrame, volumes: DataFrame, k: int) -> DataFrame:
    """Mean of the corners of each k x k x k block, the first and last index per axis.

    The corner filter runs before the shuffle, so 8 of k^3 voxels travel.
    """
    def corner(c: str) -> Column:
        return (F.col(c) % k).isin(0, k - 1) | (F.col(c) == F.col(DIM_OF[c]) - 1)

    at = attach(voxels, volumes.select("volume_id", "nx", "ny", "nz"), ["volume_id"], ["z", "y", "x"])
    return _block_mean(at.where(corner("x") & corner("y") & corner("z")), k)


def downsample_box(voxels: DataFrame, k: int) -> DataFrame:
    """Mean of all voxels of each block."""
    return _block_mean(voxels, k)


def _block_mean(voxels: DataFrame, k: int) -> DataFrame:
    block = [F.expr(f"cast({c} div {k} as int)").alias(c) for c in ("z", "y", "x")]
    return voxels.groupBy("volume_id", *block).agg(F.avg(dbl("v")).alias("v"))


def pyramid(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """All resolution levels with a ``level`` column."""
    parts = []
    for name, k in LEVELS:
        grid = voxels.withColumn("v", dbl("v")) if k == 1 else downsample(voxels, volumes, k)
        parts.append(grid.select(F.lit(name).alias("level"), "volume_id", "z", "y", "x", "v"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _mask_dims(mask: DataFrame, masks: DataFrame, volumes: DataFrame, targets: DataFrame) -> DataFrame:
    """Mask rows with source extents nx.. and target extents tx, ty, tz (targets: volume_id, tx, ty, tz)."""
    dims = masks.select("mask_id", "volume_id").join(
        volumes.select("volume_id", "nx", "ny", "nz"), "volume_id").join(
        targets.select("volume_id", "tx", "ty", "tz"), "volume_id").drop("volume_id")
    return attach(mask, dims, ["mask_id"], ["z", "y", "x"])


def _shown(display: bool):
    return F.least("class_id", F.lit(MAX_SHOWN_CLASS)) if display else F.col("class_id")


def label_downsample(mask: DataFrame, masks: DataFrame, volumes: DataFrame, targets: DataFrame, display: bool = False) -> DataFrame:
    """Most frequent class above 0 of each target cell; of equal counts, the class that got there first.

    Cell i of d covers [floor(i s / d), max(+1, floor((i + 1) s / d))) of s. The cells of a source index
    follow by integer arithmetic, so no range join is needed. With ``display`` classes above 255 count as 255. Scan order is
    linear, hence the class whose last voxel has the smallest linear index reached the top count first.
    """
    at = _mask_dims(mask.where(F.col("class_id") > 0), masks, volumes, targets)
    at = at.withColumns({
        "class_id": _shown(display),
        "_lin": F.expr("cast(x as bigint) + cast(y as bigint) * nx + cast(z as bigint) * nx * ny"),
    })
    for c in ("z", "y", "x"):
        s, d = DIM_OF[c], f"t{c}"
        last = f"((cast({c} as bigint) + 1) * {d} - 1) div {s}"
        first = f"(cast({c} as bigint) * {d} + {s} - 1) div {s}"
        at = at.withColumn(f"_{c}", F.explode(F.expr(f"sequence(least({first}, {last}), {last})")))
    counted = at.groupBy("mask_id", "_z", "_y", "_x", "class_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("_lin").alias("last"))
    best = counted.groupBy("mask_id", "_z", "_y", "_x").agg(
        F.max_by("class_id", F.struct(F.col("n"), -F.col("last"))).alias("class_id"))
    return best.select("mask_id", *[F.col(f"_{c}").cast("int").alias(c) for c in "zyx"], "class_id")


def label_scatter(mask: DataFrame, masks: DataFrame, volumes: DataFrame, targets: DataFrame, display: bool = False) -> DataFrame:
    """Sparse variant: each voxel goes to floor(s d / n) and the highest class id of a cell wins.

    With ``display`` classes above 255 are left out, as in an 8-bit texture.
    """
    shown = mask.where(F.col("class_id").between(1, MAX_SHOWN_CLASS) if display else F.col("class_id") > 0)
    at = _mask_dims(shown, masks, volumes, targets)
    cell = [
        F.expr(f"cast(least(t{c} - 1, (cast({c} as bigint) * t{c}) div {DIM_OF[c]}) as int)").alias(c)
        for c in ("z", "y", "x")
    ]
    return at.groupBy("mask_id", *cell).agg(F.max("class_id").alias("class_id"))


def label_upsample(mask: DataFrame, masks: DataFrame, volumes: DataFrame, targets: DataFrame, display: bool = False) -> DataFrame:
    """Nearest class for target grids that are at least as fine: every target cell takes the voxel at its start.

    Each mask row is repeated over the cells that start at it, so empty space costs nothing.
    """
    at = _mask_dims(mask.where(F.col("class_id") > 0), masks, volumes, targets)
    for c in ("z", "y", "x"):
        s, d = DIM_OF[c], f"t{c}"
        first = f"(cast({c} as bigint) * {d} + {s} - 1) div {s}"
        last = f"((cast({c} as bigint) + 1) * {d} - 1) div {s}"
        at = at.withColumn(f"_{c}", F.explode(F.expr(f"sequence({first}, {last})")))
    return at.select("mask_id", *[F.col(f"_{c}").cast("int").alias(c) for c in "zyx"],
                     _shown(display).alias("class_id"))


def resize_nearest(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Slice cells (with extents w, h) on a width x height raster: source = min(n - 1, floor(i n / size)).

    Every source cell is repeated over the raster cells that read it; cells that nobody reads drop out.
    """
    def readers(c: str, n: str, size: int) -> Column:
        first = f"(cast({c} as bigint) * {size} + {n} - 1) div {n}"
        last = f"least({size} - 1, ((cast({c} as bigint) + 1) * {size} - 1) div {n})"
        return F.expr(f"case when {first} <= {last} then sequence({first}, {last}) else cast(array() as array<bigint>) end")

    keep = [c for c in cells.columns if c not in ("u", "v", "w", "h")]
    rows = cells.withColumn("_v", F.explode(readers("v", "h", height)))
    full = rows.withColumn("_u", F.explode(readers("u", "w", width)))
    return full.select(*keep, F.col("_v").cast("int").alias("v"), F.col("_u").cast("int").alias("u"))
