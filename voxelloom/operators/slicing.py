"""Orthogonal slices, their low-resolution stand-ins, sampling and orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import clamp, dbl
from ..model import axis_coords, axis_dims
from ..scale import attach, lookup, spread_out, stage


def slices(voxels: DataFrame, axis: str, wanted: DataFrame | None = None) -> DataFrame:
    """Voxels as slice cells (volume_id, axis, idx, v, u, value), for the wanted (volume_id, idx) only.

    The range of wanted indices is a plain filter, so what lies outside is skipped by the scan.
    """
    fixed, u, v = axis_coords(axis)
    if wanted is not None:
        low, high = wanted.agg(F.min("idx"), F.max("idx")).first()
        voxels = voxels.where(F.col(fixed).between(F.lit(low), F.lit(high)))
    cells = voxels.select(
        "volume_id", F.lit(axis).alias("axis"), F.col(fixed).alias("idx"),
        F.col(v).alias("v"), F.col(u).alias("u"), F.col("v").alias("value"))
    if wanted is None:
        return cells
    return attach(cells, wanted.select("volume_id", "idx").distinct(), ["volume_id", "idx"], ["v", "u"], "left_semi")


def slice_at(voxels: DataFrame, axis: str, idx: int) -> DataFrame:
    """One slice per volume; the fixed coordinate is a plain filter, so it reaches the scan."""
    fixed = axis_coords(axis)[0]
    return slices(voxels.where(F.col(fixed) == idx), axis)


def out_of_bounds(volumes: DataFrame, axis: str, idx: int) -> DataFrame:
    """Volumes for which slice ``idx`` does not exist."""
    n = axis_dims(axis)[0]
    return volumes.where((F.lit(idx) < 0) | (F.lit(idx) >= F.col(n))).select("volume_id", F.col(n).alias("slices"))


def slice_grid(volumes: DataFrame, axis: str, wanted: DataFrame) -> DataFrame:
    """Every cell of the wanted slices, generated row by row on the executors."""
    _, nu, nv = axis_dims(axis)
    rows = (
        attach(wanted.select("volume_id", "idx").distinct(), volumes.select("volume_id", "nx", "ny", "nz"),
               ["volume_id"], ["idx"])
        .withColumn("v", F.explode(F.expr(f"sequence(0, {nv} - 1)")))
    )
    return (
        spread_out(rows, "volume_id", "idx", "v", per_task=1024)
        .withColumn("u", F.explode(F.expr(f"sequence(0, {nu} - 1)")))
        .select("volume_id", F.lit(axis).alias("axis"), "idx", "v", "u")
    )


def lowres_slice(volumes: DataFrame, lowres: DataFrame, low_volumes: DataFrame, axis: str,
                 wanted: DataFrame) -> DataFrame:
    """Full-size slices filled from the low-resolution grid, floor(c / scale) with scale = round(nx / low nx)."""
    fixed, u, v = axis_coords(axis)
    dims = volumes.select("volume_id", "nx").join(
        low_volumes.select("volume_id", *[F.col(c).alias(f"l{c}") for c in ("nx", "ny", "nz")]), "volume_id",
    ).withColumn("_scale", F.floor(dbl("nx") / dbl("lnx") + 0.5).cast("int"))
    grid = attach(slice_grid(volumes, axis, wanted), dims.drop("nx"), ["volume_id"], ["v", "u"])

    def low(c: str, n: str) -> Column:
        return F.least(F.expr(f"cast({c} div _scale as int)"), F.col(n) - 1)

    names = {fixed: "idx", u: "u", v: "v"}
    for c in ("z", "y", "x"):
        grid = grid.withColumn(f"_{c}", low(names[c], f"ln{c}"))
    cells = lowres.select("volume_id", *[F.col(c).alias(f"_{c}") for c in "zyx"], F.col("v").alias("value"))
    layers = attach(wanted.select("volume_id", "idx").distinct(), dims.drop("nx"), ["volume_id"], ["idx"]).select(
        "volume_id", low("idx", f"ln{fixed}").alias(f"_{fixed}")).distinct()
    cells = attach(cells, layers, ["volume_id", f"_{fixed}"], [f"_{u}", f"_{v}"], "left_semi")
    return grid.join(cells, ["volume_id", "_z", "_y", "_x"]).select("volume_id", "axis", "idx", "v", "u", "value")


def bilinear_sample(samples: DataFrame, cells: DataFrame, volumes: DataFrame, axis: str) -> DataFrame:
    """Samples (sample_id, volume_id, idx, px, py) interpolated between the four neighbouring cells."""
    _, nu, nv = axis_dims(axis)
    at = attach(samples, volumes.select("volume_id", F.col(nu).alias("_w"), F.col(nv).alias("_h")),
                ["volume_id"], ["sample_id"])
    at = at.withColumns({
        "_px": clamp(dbl("px"), F.lit(0.0), dbl("_w") - F.lit(1.001)),
        "_py": clamp(dbl("py"), F.lit(0.0), dbl("_h") - F.lit(1.001)),
    }).withColumns({
        "_px": F.greatest(F.lit(0.0), F.col("_px")), "_py": F.greatest(F.lit(0.0), F.col("_py")),
    })
    at = at.withColumns({
        "_x0": F.floor("_px").cast("int"), "_y0": F.floor("_py").cast("int"),
        "_fx": F.col("_px") - F.floor("_px"), "_fy": F.col("_py") - F.floor("_py"),
    })
    corners = []
    for dx, dy in ((0, 0), (1, 0), (0, 1), (1, 1)):
        wx = F.col("_fx") if dx else F.lit(1.0) - F.col("_fx")
        wy = F.col("_fy") if dy else F.lit(1.0) - F.col("_fy")
        corners.append(F.struct(
            F.least(F.col("_x0") + dx, F.col("_w") - 1).alias("u"),
            F.least(F.col("_y0") + dy, F.col("_h") - 1).alias("v"),
            (wx * wy).alias("weight")))
    parts = at.select("sample_id", "volume_id", "idx", F.explode(F.array(*corners)).alias("c")).select(
        "sample_id", "volume_id", "idx", "c.v", "c.u", "c.weight")
    spot = ["volume_id", "idx", "v", "u"]
    asked = stage(lookup(cells.select(*spot, "value"), parts.select(*spot).distinct(), spot))
    hit = attach(parts, asked, spot, ["sample_id"])
    return hit.groupBy("sample_id", "volume_id", "idx").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def rotate(cells: DataFrame, quarter: int) -> DataFrame:
    """Turns slice cells about the slice centre: (x, y) -> (-y, x), (-x, -y), (y, -x).

    Needs the extents w and h as columns; coordinates are shifted back so that they start at 0.
    """
    q = quarter % 4
    u, v = F.col("u"), F.col("v")
    last_u, last_v = F.col("w") - 1, F.col("h") - 1
    turned = {0: (u, v), 1: (last_v - v, u), 2: (last_u - u, last_v - v), 3: (v, last_u - u)}[q]
    extent = (F.col("h"), F.col("w")) if q % 2 else (F.col("w"), F.col("h"))
    return cells.withColumns({"_u": turned[0], "_v": turned[1], "_w": extent[0], "_h": extent[1]}).drop(
        "u", "v", "w", "h").withColumnsRenamed({"_u": "u", "_v": "v", "_w": "w", "_h": "h"})


def with_extent(cells: DataFrame, volumes: DataFrame, axis: str) -> DataFrame:
    _, nu, nv = axis_dims(axis)
    return attach(cells, volumes.select("volume_id", F.col(nu).alias("w"), F.col(nv).alias("h")),
                  ["volume_id"], ["idx", "v", "u"])


def slice_to_voxel(picks: DataFrame, volumes: DataFrame, axis: str) -> DataFrame:
    """Picks (volume_id, idx, px, py) to voxels; coordinates are floored and clamped to the grid."""
    fixed, u, v = axis_coords(axis)
    at = attach(picks, volumes.select("volume_id", "nx", "ny", "nz"), ["volume_id"], ["px", "py"])
    spot = {
        u: clamp(F.floor(dbl("px")), 0, F.col(f"n{u}") - 1).cast("int"),
        v: clamp(F.floor(dbl("py")), 0, F.col(f"n{v}") - 1).cast("int"),
        fixed: F.col("idx").cast("int"),
    }
    return at.withColumns(spot).select(*picks.columns, "z", "y", "x")
