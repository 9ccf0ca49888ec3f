"""Bricks along a space-filling curve with a tree of value ranges above them, to read only what can matter.

Bricks are clustered by Morton code, so that an eighth of a cube of bricks is a range of codes, eight ranges of a level
make one of the next, and every level is a table of such nodes with their least and greatest value. A search starts at
the root and looks only below nodes that can hold what is wanted; what it finds becomes a few ranges of codes, which
Parquet prunes by its statistics, and an exact semi-join.

NaN has no part in a range; a node of nothing else has none and is never visited.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numeric import number_or_null
from ..model import axis_coords, axis_dims
from ..scale import spread_out
from .bricks import to_bricks, voxels_of

SIZE = 8
NODES = 4096  # surviving nodes of a level that are turned into ranges at the driver
RANGES = 64
FILE_BYTES = 64 << 20
# Masks that pull the bits of a 21-bit number three places apart.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))

Keep = Callable[[], Column]


class Range(NamedTuple):
    volume_id: str
    first: int
    last: int


def morton(z: str = "bz", y: str = "by", x: str = "bx") -> Column:
    """Interleaved bits of three coordinates below 2^21, x lowest."""
    def spread(c: str) -> Column:
        v = F.col(c).cast("bigint")
        for shift, bits in SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(bits))
        return v
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))


def write_tree(voxels: DataFrame, volumes: DataFrame, path: str, size: int = SIZE, file_bytes: int = FILE_BYTES) -> int:
    """Writes bricks and levels below ``path``; returns the number of the level that holds one node per volume.

    Files hold bricks of about ``file_bytes``: the least that a search reads or skips.
    """
    spark = voxels.sparkSession
    volumes.write.mode("overwrite").parquet(f"{path}/volumes")
    packed = to_bricks(voxels, volumes, size).withColumn("code", morton())
    packed.repartitionByRange("volume_id", "code").sortWithinPartitions("volume_id", "code").write.mode("overwrite").option(
        "maxRecordsPerFile", max(1, file_bytes // (8 * size ** 3))).parquet(f"{path}/bricks")
    most = volumes.agg(F.max(F.greatest("nx", "ny", "nz"))).first()[0] or 1
    top = ((most - 1) // size).bit_length()
    below = spark.read.parquet(f"{path}/bricks").select("volume_id", "code", "vmin", "vmax", F.lit(1).cast("bigint").alias("bricks"))
    for level in range(top + 1):
        if level:
            below = spark.read.parquet(f"{path}/levels/level={level - 1}").groupBy(
                "volume_id", F.shiftright("code", 3).alias("code")).agg(
                F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"), F.sum("bricks").alias("bricks"))
        below.sortWithinPartitions("volume_id", "code").write.mode("overwrite").parquet(f"{path}/levels/level={level}")
    return top


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """(volume_id, level, code, vmin, vmax, bricks) of all nodes; level 0 holds the bricks themselves."""
    return spark.read.parquet(f"{path}/levels").select("volume_id", "level", "code", "vmin", "vmax", "bricks")


def ranges_of(nodes: list[tuple[str, int]], most: int = RANGES) -> list[Range]:
    """Few ranges of codes that cover the nodes: those with the smallest gaps in between are joined."""
    out: list[Range] = []
    for volume_id, code in sorted(nodes):
        if out and out[-1].volume_id == volume_id and out[-1].last + 1 == code:
            out[-1] = out[-1]._replace(last=code)
        else:
            out.append(Range(volume_id, code, code))
    gaps = sorted((b.first - a.last, i) for i, (a, b) in enumerate(zip(out, out[1:])) if a.volume_id == b.volume_id)
    joined = {i for _, i in gaps[:max(0, len(out) - most)]}
    few: list[Range] = []
    for i, r in enumerate(out):
        if i - 1 in joined:
            few[-1] = few[-1]._replace(last=r.last)
        else:
            few.append(r)
    return few


def within(ranges: list[Range] | None, levels_up: int) -> Column:
    """Whether a code lies below one of the ranges of nodes, which are so many levels up."""
    if ranges is None:
        return F.lit(True)
    out = F.lit(False)
    for r in ranges:
        first, last = r.first << 3 * levels_up, ((r.last + 1) << 3 * levels_up) - 1
        out = out | ((F.col("volume_id") == r.volume_id) & F.col("code").between(first, last))
    return out


class Found(NamedTuple):
    codes: DataFrame  # (volume_id, code) of the bricks that can matter
    pruned: Column  # a condition on volume_id and code that Parquet understands, true for all of them


def search(spark: SparkSession, path: str, keep: Column) -> Found:
    """Bricks all of whose ancestors meet ``keep``, a condition on vmin and vmax that holds for a node if for a child.

    The driver sees at most ``NODES`` nodes of a level; from the first wider level on, the last ranges prune the rest.
    """
    top = max((int(r["level"]) for r in spark.read.parquet(f"{path}/levels").select("level").distinct().collect()), default=0)
    alive: DataFrame | None = None
    ranges, at, narrow = None, top, True
    for level in range(top, -1, -1):
        nodes = spark.read.parquet(f"{path}/levels/level={level}").where(within(ranges, at - level)).where(keep).select("volume_id", "code")
        if alive is not None:
            above = alive.select("volume_id", F.col("code").alias("_up"))
            same = (nodes["volume_id"] == above["volume_id"]) & (F.shiftright(nodes["code"], 3) == above["_up"])
            nodes = nodes.join(above, same, "left_semi")
        if narrow:
            some = [(r[0], r[1]) for r in nodes.limit(NODES + 1).collect()]
            narrow = len(some) <= NODES
            if narrow:
                ranges, at = ranges_of(some), level
                nodes = spark.createDataFrame(some, nodes.schema)
        alive = nodes
    return Found(alive, within(ranges, at))


def read_found(spark: SparkSession, path: str, found: Found) -> DataFrame:
    """The bricks of a search, with their values."""
    return spark.read.parquet(f"{path}/bricks").where(found.pruned).join(found.codes, ["volume_id", "code"], "left_semi")


def project_visible(spark: SparkSession, path: str, axis: str, display_min: float, size: int = SIZE) -> DataFrame:
    """As ``projection.project_visible``: bricks below the display minimum contribute nothing, and are not read either."""
    _, u, v = axis_coords(axis)
    _, nu, nv = axis_dims(axis)
    seen = voxels_of(read_found(spark, path, search(spark, path, F.col("vmax") >= F.lit(float(display_min)))), size)
    value = number_or_null("v")
    drawn = seen.groupBy("volume_id", F.col(v).alias("row"), F.col(u).alias("col")).agg(
        F.max(value).alias("vmax"), F.min(value).alias("vmin"), F.avg(value).alias("vavg"))
    rows = spread_out(spark.read.parquet(f"{path}/volumes").select(
        "volume_id", nu, F.explode(F.sequence(F.lit(0), F.col(nv) - 1)).alias("row")), "volume_id", "row", per_task=1024)
    rays = rows.select("volume_id", "row", F.explode(F.sequence(F.lit(0), F.col(nu) - 1)).alias("col"))
    zero = F.lit(0.0)
    return rays.join(drawn, ["volume_id", "row", "col"], "left").select(
        "volume_id", "row", "col", *[F.coalesce(c, zero).alias(c) for c in ("vmax", "vmin", "vavg")])


def threshold(spark: SparkSession, path: str, low: float, high: float, size: int = SIZE) -> DataFrame:
    """Voxels with a value from ``low`` to ``high``."""
    bricks = read_found(spark, path, search(spark, path, (F.col("vmax") >= F.lit(float(low))) & (F.col("vmin") <= F.lit(float(high)))))
    return voxels_of(bricks, size).where(F.col("v").between(float(low), float(high)))
