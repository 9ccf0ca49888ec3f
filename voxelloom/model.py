"""Data model: table schemas, the axis map and the linear voxel index.

A grid is a table keyed by ``(volume_id, z, y, x)``; a label mask is a sparse table keyed by
``(mask_id, z, y, x)`` that holds only the rows whose class differs from the mask's fill value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed values of the data model.
AXES = ("xy", "xz", "yz")
VOXEL_TYPES = ("uint8", "uint16", "float32")
MAX_CLASS = {"uint8": 255, "uint16": 65535}

# axis -> (coordinate that is fixed, horizontal coordinate, vertical coordinate)
AXIS_COORDS = {"xy": ("z", "x", "y"), "xz": ("y", "x", "z"), "yz": ("x", "y", "z")}
DIM_OF = {"x": "nx", "y": "ny", "z": "nz"}

VOXEL_KEY = ["volume_id", "z", "y", "x"]
MASK_KEY = ["mask_id", "z", "y", "x"]

VOLUMES = T.StructType([
    T.StructField("volume_id", T.StringType()),
    T.StructField("nx", T.IntegerType()),
    T.StructField("ny", T.IntegerType()),
    T.StructField("nz", T.IntegerType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("sx", T.DoubleType()),
    T.StructField("sy", T.DoubleType()),
    T.StructField("sz", T.DoubleType()),
    T.StructField("byte_order", T.StringType()),
    T.StructField("is_rgb", T.BooleanType()),
    T.StructField("vmin", T.DoubleType()),
    T.StructField("vmax", T.DoubleType()),
    T.StructField("description", T.StringType()),
])
VOXELS = T.StructType([
    T.StructField("volume_id", T.StringType()),
    T.StructField("z", T.IntegerType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("x", T.IntegerType()),
    T.StructField("v", T.DoubleType()),
])
MASK = T.StructType([
    T.StructField("mask_id", T.StringType()),
    T.StructField("z", T.IntegerType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("x", T.IntegerType()),
    T.StructField("class_id", T.IntegerType()),
])
ROIS = T.StructType([
    T.StructField("mask_id", T.StringType()),
    T.StructField("roi_id", T.StringType()),
    T.StructField("class_id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("color_hex", T.StringType()),
    T.StructField("visible", T.BooleanType()),
    T.StructField("locked", T.BooleanType()),
    T.StructField("ordinal", T.IntegerType()),
])


def axis_coords(axis: str) -> tuple[str, str, str]:
    if axis not in AXIS_COORDS:
        raise ValueError(f"axis must be one of {AXES}, got {axis!r}")
    return AXIS_COORDS[axis]


def axis_dims(axis: str) -> tuple[str, str, str]:
    """Names of the volume columns that bound (fixed, u, v) on this axis."""
    return tuple(DIM_OF[c] for c in axis_coords(axis))


def linear_index(x="x", y="y", z="z", nx="nx", ny="ny") -> Column:
    """64-bit linear index, x fastest."""
    nx_, ny_ = F.col(nx).cast("bigint"), F.col(ny).cast("bigint")
    return F.col(x).cast("bigint") + F.col(y) * nx_ + F.col(z) * nx_ * ny_


def coords_of_linear(df: DataFrame, linear="linear", nx="nx", ny="ny") -> DataFrame:
    """Adds z, y, x from a linear index and the grid extents."""
    return df.withColumns({
        "z": F.expr(f"cast({linear} div (cast({nx} as bigint) * {ny}) as int)"),
        "y": F.expr(f"cast(({linear} div {nx}) % {ny} as int)"),
        "x": F.expr(f"cast({linear} % {nx} as int)"),
    })


def inside(x="x", y="y", z="z") -> Column:
    """True where a coordinate lies on the grid given by nx, ny, nz."""
    return (
        F.col(x).between(0, F.col("nx") - 1)
        & F.col(y).between(0, F.col("ny") - 1)
        & F.col(z).between(0, F.col("nz") - 1)
    )
