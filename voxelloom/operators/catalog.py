"""Volume catalogue, look-ups of single voxels, zone maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import bytes_per_voxel, dbl, number_or_null, round_half_up
from ..model import AXES, VOXEL_KEY, axis_dims, inside
from ..scale import attach, lookup, stage

# Resolution levels (name, reduction), the upload budget and the overhead factor.
LEVELS = (("low", 4), ("mid", 2), ("full", 1))
UPLOAD_BUDGET = 384 * 1024 * 1024
UPLOAD_OVERHEAD = 1.15
ZONE = 8


def min_max(voxels: DataFrame) -> DataFrame:
    """Range per volume. NaN never wins a comparison, so it is left out."""
    return (
        voxels.where(~F.isnan(F.col("v").cast("double")))
        .groupBy("volume_id")
        .agg(F.min("v").cast("double").alias("vmin"), F.max("v").cast("double").alias("vmax"))
    )


def with_range(volumes: DataFrame, voxels: DataFrame) -> DataFrame:
    """Fills vmin/vmax; a range declared in the metadata wins only if both ends are given."""
    found = min_max(voxels).withColumnsRenamed({"vmin": "_lo", "vmax": "_hi"})
    declared = F.col("vmin").isNotNull() & F.col("vmax").isNotNull()
    return (
        volumes.join(found, "volume_id", "left")
        .withColumn("_min", F.when(declared, F.col("vmin")).otherwise(F.col("_lo")))
        .withColumn("_max", F.when(declared, F.col("vmax")).otherwise(F.col("_hi")))
        .withColumns({"vmin": F.col("_min"), "vmax": F.col("_max")})
        .drop("_lo", "_hi", "_min", "_max")
    )


def voxel_count() -> Column:
    return F.col("nx").cast("bigint") * F.col("ny") * F.col("nz")


def estimate_bytes() -> Column:
    return voxel_count() * bytes_per_voxel(F.col("data_type"))


def volume_info(volumes: DataFrame) -> DataFrame:
    return volumes.select(
        "volume_id", "nx", "ny", "nz", "data_type", "sx", "sy", "sz", "vmin", "vmax",
        voxel_count().alias("total_voxels"),
        estimate_bytes().alias("total_bytes"),
        F.round(dbl(estimate_bytes()) / F.lit(1048576.0), 2).alias("size_mb"),
        (F.col("nz") == 1).alias("single_slice"),
    )


def channel_label(z: Column) -> Column:
    """Channel name of a slice of an RGB volume, null otherwise."""
    names = F.array(F.lit("Red"), F.lit("Green"), F.lit("Blue"))
    return F.when(F.col("is_rgb") & (F.col("nz") == 3) & z.between(0, 2), F.element_at(names, (z + 1).cast("int")))


def slice_bounds(volumes: DataFrame) -> DataFrame:
    """Per volume and axis: number of slices, centre slice and last slice."""
    axes = [
        F.struct(F.lit(a).alias("axis"), F.col(axis_dims(a)[0]).alias("slices")) for a in AXES
    ]
    return (
        volumes.select("volume_id", F.explode(F.array(*axes)).alias("a"))
        .select("volume_id", "a.axis", "a.slices")
        .withColumns({
            "center": F.expr("cast(slices div 2 as int)"),
            "last": F.col("slices") - 1,
        })
    )


def slice_range(volumes: DataFrame, axis: str, center: Column | None = None, radius: float = 0) -> DataFrame:
    """Slice indices within ``radius`` of the centre, clipped to the grid."""
    r = max(0, int(radius // 1))
    n = F.col(axis_dims(axis)[0])
    mid = F.expr(f"cast({axis_dims(axis)[0]} div 2 as int)") if center is None else center
    first, last = F.greatest(F.lit(0), mid - r), F.least(n - 1, mid + r)
    spread = F.when(first <= last, F.sequence(first, last))
    return volumes.select("volume_id", F.lit(axis).alias("axis"), F.explode(spread.cast("array<int>")).alias("idx"))


def value_at(points: DataFrame, voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Points (volume_id, z, y, x, ...) with their value, null outside the grid.

    Points are reduced to distinct coordinates before the voxels are looked up, so a coordinate that is
    asked for very often is searched once.
    """
    asked = points.select(*VOXEL_KEY).distinct()
    dims = volumes.select("volume_id", "nx", "ny", "nz")
    asked = attach(asked, dims, ["volume_id"], ["z", "y", "x"]).where(inside()).select(*VOXEL_KEY)
    found = stage(lookup(voxels.select(*VOXEL_KEY, "v"), asked, VOXEL_KEY))
    return attach(points, found, VOXEL_KEY, points.columns, "left")


def value_at_lowres(points: DataFrame, lowres: DataFrame, volumes: DataFrame, low_volumes: DataFrame) -> DataFrame:
    """Value of the low-resolution cell that covers each point; the scale is nx / low nx on all axes."""
    dims = volumes.select("volume_id", "nx", "ny", "nz").join(
        low_volumes.select("volume_id", *[F.col(c).alias(f"l{c}") for c in ("nx", "ny", "nz")]), "volume_id")
    scale = dbl("nx") / dbl("lnx")

    def cell(c: str, n: str) -> Column:
        return F.least(F.col(n) - 1, F.floor(dbl(c) / scale)).cast("int")

    at = attach(points, dims, ["volume_id"], ["z", "y", "x"], "left").withColumns({
        "_z": F.when(inside(), cell("z", "lnz")),
        "_y": F.when(inside(), cell("y", "lny")),
        "_x": F.when(inside(), cell("x", "lnx")),
    })
    low = lowres.select("volume_id", *[F.col(c).alias(f"_{c}") for c in "zyx"], "v")
    # Cells are looked up once each; a cell that very many points ask for is split over salts if they are not broadcast.
    cell_key = ["volume_id", "_z", "_y", "_x"]
    held = stage(lookup(low, at.select(*cell_key).distinct(), cell_key))
    return attach(at, held, cell_key, points.columns, "left").select(*points.columns, "v")


def probe(points: DataFrame, voxels: DataFrame, volumes: DataFrame, mask: DataFrame, masks: DataFrame) -> DataFrame:
    """Rounded value and class at each point (mask_id, z, y, x); class 0 outside the grid."""
    known = masks.select("mask_id", "volume_id", "fill_value")
    at = attach(points, known, ["mask_id"], ["z", "y", "x"])
    valued = value_at(at, voxels, volumes)
    key = ["mask_id", "z", "y", "x"]
    classes = stage(lookup(mask, points.select(*key).distinct(), key))
    return attach(valued, classes, key, points.columns, "left").select(
        *points.columns,
        round_half_up(dbl("v")).cast("bigint").alias("value"),
        F.when(F.col("v").isNull(), 0)
        .otherwise(F.coalesce(F.col("class_id"), F.col("fill_value"))).cast("int").alias("class_id"),
    )


def pyramid_plan(volumes: DataFrame, budget: int = UPLOAD_BUDGET, max_dim: int = 2048,
                 wanted: str = "low", streaming: bool = False) -> DataFrame:
    """Resolution levels of each volume with their size, whether they fit, and the level to use."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(name).alias("level"), F.lit(k).alias("factor"))
        for i, (name, k) in enumerate(LEVELS)
    ])
    lv = volumes.select("volume_id", "nx", "ny", "nz", F.explode(rows).alias("l")).select(
        "volume_id", "nx", "ny", "nz", "l.rank", "l.level", "l.factor")
    for n in ("nx", "ny", "nz"):
        lv = lv.withColumn(f"l{n}", F.ceil(dbl(n) / dbl("factor")).cast("int"))
    zones = [F.ceil(dbl(f"l{n}") / F.lit(float(ZONE))).cast("bigint") for n in ("nx", "ny", "nz")]
    voxels = F.col("lnx").cast("bigint") * F.col("lny") * F.col("lnz")
    size = F.ceil((dbl(voxels) * 2 + dbl(zones[0] * zones[1] * zones[2]) * 4) * F.lit(UPLOAD_OVERHEAD))
    lv = lv.withColumn("bytes", size.cast("bigint"))
    shape = F.greatest("lnx", "lny", "lnz") <= max_dim
    thick = (F.col("nx") > 1) & (F.col("ny") > 1) & (F.col("nz") > 1)
    fits = (F.col("bytes") <= budget) & shape
    fits = F.when(F.col("level") == "mid", fits & thick).when(
        F.col("level") == "full", fits & F.lit(not streaming)).otherwise(fits)
    lv = lv.withColumn("fits", fits)
    # At most three rows per volume: the wanted level if it fits, else the first that does (low, mid, full).
    order = F.struct(F.when(F.col("level") == wanted, 0).otherwise(1), F.col("rank"))
    pick = lv.groupBy("volume_id").agg(
        F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), order)).alias("chosen"))
    return lv.join(pick, "volume_id").select(
        "volume_id", "level", "factor", "lnx", "lny", "lnz", "bytes", "fits",
        F.coalesce(F.col("level") == F.col("chosen"), F.lit(False)).alias("chosen"))


def brick_of(size: int = ZONE) -> dict[str, Column]:
    return {f"b{c}": F.expr(f"cast({c} div {int(size)} as int)") for c in ("z", "y", "x")}


def brick_minmax(voxels: DataFrame, size: int = ZONE) -> DataFrame:
    """Range and size of every brick. NaN has no part in a range; a brick of nothing else has none."""
    v = number_or_null("v")
    return (
        voxels.withColumns(brick_of(size))
        .groupBy("volume_id", "bz", "by", "bx")
        .agg(F.min(v).alias("vmin"), F.max(v).alias("vmax"), F.count(F.lit(1)).alias("n"))
    )


def bricks_hit(bricks: DataFrame, display_min) -> DataFrame:
    """Bricks that can show something: those whose maximum reaches the display minimum."""
    return bricks.where(F.col("vmax") >= F.lit(display_min))
