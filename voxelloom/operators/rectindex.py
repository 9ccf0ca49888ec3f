"""Value ranges of many rectangles from a structure over tiles and their dyadic blocks.

A slice is cut into tiles. A rectangle is made of whole tiles and of parts of tiles along its border. Whole tiles are
covered by blocks of 2^i x 2^j tiles, a logarithm of them per side, whose ranges are summed up once from the tiles'. Parts
are asked of their tile: a task holds a tile with the distinct parts that any rectangle wants of it and answers each from
four entries of a sparse table. Neither joins rectangles with cells; equal parts are asked once, however many rectangles
share them, and the parts of a hot tile are split over ``CHUNKS`` tasks.

NaN has no part in a range. Rectangles without area and flat ones give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import number_or_null
from ..scale import salted_join
from .measure import clipped
from .slicing import slices

TILE, CHUNKS, LEVELS = 64, 64, 20
_TILE_KEY = ["volume_id", "idx", "tv", "tu"]
_PART = ["v0", "v1", "u0", "u1"]


def tiles(voxels: DataFrame, axis: str, tile: int = TILE) -> DataFrame:
    """(volume_id, idx, tv, tu, cells): one row per tile, its cells as (p, v) with p = row * tile + column."""
    at = slices(voxels, axis)
    cell = F.struct(F.expr(f"cast(v % {tile} * {tile} + u % {tile} as int)").alias("p"), number_or_null("value").cast("double").alias("v"))
    return at.groupBy("volume_id", "idx", F.expr(f"cast(v div {tile} as int)").alias("tv"), F.expr(f"cast(u div {tile} as int)").alias("tu")).agg(
        F.collect_list(cell).alias("cells"))


def dyadic(first: Column, end: Column) -> Column:
    """Blocks (level, no) that cover the numbers from ``first`` up to before ``end``: at most two of a level."""
    nodes = []
    for k in range(LEVELS):
        low, high = F.ceil(first / F.lit(float(1 << k))), F.floor(end / F.lit(float(1 << k)))
        for use, no in ((low % 2 == 1, low), (high % 2 == 1, high - 1)):
            nodes.append(F.when((low < high) & use, F.struct(F.lit(k).alias("level"), no.cast("int").alias("no"))))
    return F.filter(F.array(*nodes), lambda n: n.isNotNull())


def block_ranges(held: DataFrame) -> DataFrame:
    """(volume_id, idx, lv, lu, bv, bu, vmin, vmax) of all blocks of tiles, single tiles included."""
    own = held.select(*_TILE_KEY, F.array_min("cells.v").alias("vmin"), F.array_max("cells.v").alias("vmax"))
    # A block is wanted only where it lies inside the slice, so levels end with the largest tile number.
    far = own.agg(F.max("tv").alias("tv"), F.max("tu").alias("tu")).first()
    levels = {c: int(far[c] or 0).bit_length() + 1 for c in ("tv", "tu")}
    up = own.withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(levels["tv"] - 1)))).withColumn(
        "lu", F.explode(F.sequence(F.lit(0), F.lit(levels["tu"] - 1))))
    return up.groupBy("volume_id", "idx", "lv", "lu", F.expr("shiftright(tv, lv)").alias("bv"), F.expr("shiftright(tu, lu)").alias("bu")).agg(
        F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))


def cut(at: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Blocks (lv, bv, lu, bu) and parts of tiles (tv, tu, v0, v1, u0, u1 within the tile) of clipped rectangles."""
    key = ["rect_id", "volume_id", "idx"]
    at = at.select(*key, *_spans("v", tile), *_spans("u", tile))
    inner = (F.col("fv") < F.col("ev")) & (F.col("fu") < F.col("eu"))
    blocks = at.where(inner).select(*key, F.explode(dyadic(F.col("fv"), F.col("ev"))).alias("v"), "fu", "eu").select(
        *key, "v", F.explode(dyadic(F.col("fu"), F.col("eu"))).alias("u")).select(
        *key, F.col("v.level").alias("lv"), F.col("v.no").alias("bv"), F.col("u.level").alias("lu"), F.col("u.no").alias("bu"))
    rows = at.withColumn("inner", inner).withColumn("tv", F.explode(F.sequence("av", "zv")))
    beside = F.col("inner") & (F.col("tv") >= F.col("fv")) & (F.col("tv") < F.col("ev"))
    ends = F.filter(F.array_distinct(F.array("au", "zu")), lambda t: (t < F.col("fu")) | (t >= F.col("eu")))
    border = rows.withColumn("tu", F.explode(F.when(beside, ends).otherwise(F.sequence("au", "zu"))))
    parts = border.select(*key, "tv", "tu", *[
        f(F.lit(bound), F.col(f"_{c}{i}") - F.col(f"t{c}") * tile).alias(f"{c}{i}")
        for c in "vu" for i, f, bound in ((0, F.greatest, 0), (1, F.least, tile - 1))])
    return blocks, parts


def _spans(c: str, tile: int) -> list[Column]:
    """Cells, tiles (a to z) and whole tiles (f up to before e) of a rectangle along one side."""
    low, high = F.col(f"_{c}0"), F.col(f"_{c}1")
    return [low, high, *(F.floor(x / F.lit(float(tile))).cast("int").alias(n) for n, x in (
        (f"a{c}", low), (f"z{c}", high), (f"f{c}", low + tile - 1), (f"e{c}", high + 1)))]


def _table(grid: np.ndarray, pick: np.ufunc) -> list[list[np.ndarray]]:
    """Entry [i][j] at (y, x): the pick of the 2^i x 2^j cells from there on."""
    out = [[grid]]
    while 2 << len(out) - 1 <= grid.shape[0]:
        half = 1 << len(out) - 1
        out.append([pick(out[-1][0][:-half], out[-1][0][half:])])
    for row in out:
        while 2 << len(row) - 1 <= grid.shape[1]:
            half = 1 << len(row) - 1
            row.append(pick(row[-1][:, :-half], row[-1][:, half:]))
    return out


def part_ranges(cells: list[dict], parts: list[dict], tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each part of a tile; infinities where it has none."""
    grid = np.full(tile * tile, np.nan)
    grid[[c["p"] for c in cells]] = [np.nan if c["v"] is None else c["v"] for c in cells]
    v0, v1, u0, u1 = (np.array([p[c] for p in parts], np.int64) for c in _PART)
    high, wide = (np.frexp(n)[1] - 1 for n in (v1 - v0 + 1, u1 - u0 + 1))
    out = []
    for pick, none in ((np.minimum, np.inf), (np.maximum, -np.inf)):
        table = _table(np.where(np.isnan(grid), none, grid).reshape(tile, tile), pick)
        found = np.empty(len(parts))
        for i, j in set(zip(high.tolist(), wide.tolist())):
            at = np.flatnonzero((high == i) & (wide == j))
            y, x, t = (v0[at], v1[at] - (1 << i) + 1), (u0[at], u1[at] - (1 << j) + 1), table[i][j]
            found[at] = pick(pick(t[y[0], x[0]], t[y[0], x[1]]), pick(t[y[1], x[0]], t[y[1], x[1]]))
        out.append(found)
    return out[0], out[1]


def _answer(tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low, high = part_ranges(row["cells"], row["parts"], tile)
                n = len(low)
                columns = [[row[c]] * n for c in _TILE_KEY] + [[p[c] for p in row["parts"]] for c in _PART]
                kinds = [pa.string(), *[pa.int32()] * 7]
                some = low <= high
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(low, mask=~some), pa.array(high, mask=~some)],
                    [*_TILE_KEY, *_PART, "vmin", "vmax"])
    return run


def rect_range(rects: DataFrame, voxels: DataFrame, volumes: DataFrame, axis: str, tile: int = TILE) -> DataFrame:
    """As ``measure.rect_range``."""
    held = tiles(voxels, axis, tile)
    blocks, parts = cut(clipped(rects, volumes, axis), tile)
    key = ["rect_id", "volume_id", "idx"]
    where = ["volume_id", "idx", "lv", "lu", "bv", "bu"]
    whole = salted_join(blocks, block_ranges(held), where, ["rect_id"], salts=8)
    asked = parts.select(*_TILE_KEY, *_PART).distinct().groupBy(
        *_TILE_KEY, F.pmod(F.xxhash64(*_PART), F.lit(CHUNKS)).alias("_chunk")).agg(F.collect_list(F.struct(*_PART)).alias("parts"))
    answers = asked.join(held, _TILE_KEY).select(*_TILE_KEY, "cells", "parts").mapInArrow(
        _answer(tile), "volume_id string, " + ", ".join(f"{c} int" for c in (*_TILE_KEY[1:], *_PART)) + ", vmin double, vmax double")
    edge = salted_join(parts, answers, [*_TILE_KEY, *_PART], ["rect_id"], salts=8)
    kind = voxels.schema["v"].dataType
    found = whole.select(*key, "vmin", "vmax").unionByName(edge.select(*key, "vmin", "vmax")).groupBy(*key).agg(
        F.min("vmin").cast(kind).alias("vmin"), F.max("vmax").cast(kind).alias("vmax"))
    return found.where(F.col("vmax") > F.col("vmin"))
