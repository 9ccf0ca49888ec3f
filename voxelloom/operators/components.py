"""Connected components of 2D selections, for slices of any size.

A selection is cut into square tiles that are labelled independently. What crosses a tile border becomes an
edge between tile components; that graph, far smaller than the selection, is contracted round by round with
joins and aggregations. A component's label is its first cell in row-major order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..scale import attach, salted_join, stage

TILE = 256
# Half of the neighbours; the other half follows by symmetry.
FORWARD = {4: ((0, 1), (1, 0)), 8: ((0, 1), (1, 0), (1, 1), (1, -1))}
_ROW_BITS = 31


def cell_code(v="v", u="u"):
    """Row-major order of a cell as one integer, independent of the slice width."""
    return F.shiftleft(F.col(v).cast("bigint"), _ROW_BITS) + F.col(u)


def label_tile(v: np.ndarray, u: np.ndarray, connectivity: int) -> np.ndarray:
    """Index of the first cell of each cell's component; cells must be sorted by (v, u)."""
    row, col = v - v.min() + 1, u - u.min() + 1
    place = np.full((row.max() + 2, col.max() + 2), -1, dtype=np.int64)
    place[row, col] = np.arange(len(v))
    pairs = []
    for dv, du in FORWARD[connectivity]:
        other = place[row + dv, col + du]
        here = np.flatnonzero(other >= 0)
        pairs.append((here, other[here]))
    a = np.concatenate([p[0] for p in pairs])
    b = np.concatenate([p[1] for p in pairs])
    label = np.arange(len(v))
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def components(cells: DataFrame, keys: Sequence[str], connectivity: int = 8, tile: int = TILE) -> DataFrame:
    """Cells (keys, v, u) with the ``label`` of their component.

    Work per task is bounded by a tile; the number of rounds grows with the logarithm of how many tiles a
    component winds through.
    """
    keys = list(keys)
    tiled = cells.select(
        *keys, "v", "u", F.expr(f"v div {tile}").alias("_tv"), F.expr(f"u div {tile}").alias("_tu"))
    fields = {f.name: f.dataType.simpleString() for f in tiled.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in [*keys, "v", "u"]) + ", local bigint"

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["v", "u"], ignore_index=True)
        v, u = part["v"].to_numpy(np.int64), part["u"].to_numpy(np.int64)
        first = label_tile(v, u, connectivity)
        out = part[[*keys, "v", "u"]].copy()
        out["local"] = (v[first] << _ROW_BITS) + u[first]
        return out

    local = stage(tiled.groupBy(*keys, "_tv", "_tu").applyInPandas(work, schema))
    edges = stage(_crossing(local, keys, connectivity, tile))
    if edges.isEmpty():
        return local.withColumnRenamed("local", "label")
    roots = contract(edges, keys)
    # At most tile x tile cells share a local label, so this join has no hot key.
    named = attach(local, roots.withColumnRenamed("node", "local"), [*keys, "local"], ["v", "u"], "left")
    return named.select(*keys, "v", "u", F.coalesce("root", "local").alias("label"))


def _crossing(local: DataFrame, keys: list[str], connectivity: int, tile: int) -> DataFrame:
    """Distinct pairs (a > b) of tile components that touch across a tile border."""
    last = tile - 1
    border = local.where(F.expr(f"v % {tile} in (0, {last}) or u % {tile} in (0, {last})"))
    steps = F.array(*[F.struct(F.lit(dv).alias("dv"), F.lit(du).alias("du")) for dv, du in FORWARD[connectivity]])
    reach = border.select(*keys, "v", "u", F.col("local").alias("a"), F.explode(steps).alias("_s")).select(
        *keys, (F.col("v") + F.col("_s.dv")).alias("nv"), (F.col("u") + F.col("_s.du")).alias("nu"), "v", "u", "a")
    reach = reach.where(F.expr(f"nu >= 0 and (nv div {tile} <> v div {tile} or nu div {tile} <> u div {tile})"))
    reach = reach.select(*keys, F.col("nv").alias("v"), F.col("nu").alias("u"), "a")
    met = reach.join(border.select(*keys, "v", "u", F.col("local").alias("b")), [*keys, "v", "u"])
    return met.where(F.col("a") != F.col("b")).select(
        *keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def contract(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest node reachable from every node of an undirected graph: (keys, node, root).

    Each round hooks every node to its smallest neighbour, follows two hooks, and rewrites the edges between
    the merged nodes. Joins on nodes are salted, since one node may end up with most of the edges.
    """
    keys = list(keys)
    mapping = None
    while True:
        both = edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            edges.select(*keys, F.col("b").alias("node"), F.col("a").alias("other")))
        hooks = stage(both.groupBy(*keys, "node").agg(F.min("other").alias("up")).withColumn(
            "up", F.least("node", "up")))
        for _ in range(2):
            above = hooks.select(*keys, F.col("node").alias("up"), F.col("up").alias("top"))
            hooks = salted_join(hooks, above, [*keys, "up"], ["node"]).select(*keys, "node", F.col("top").alias("up"))
        hooks = stage(hooks)
        if mapping is None:
            mapping = hooks.withColumnRenamed("up", "root")
        else:
            moved = hooks.withColumnRenamed("node", "root")
            mapping = stage(salted_join(mapping, moved, [*keys, "root"], ["node"], "left").select(
                *keys, "node", F.coalesce("up", "root").alias("root")))
        to_a = hooks.select(*keys, F.col("node").alias("a"), F.col("up").alias("na"))
        to_b = hooks.select(*keys, F.col("node").alias("b"), F.col("up").alias("nb"))
        moved = salted_join(salted_join(edges, to_a, [*keys, "a"], ["b"]), to_b, [*keys, "b"], ["a"])
        edges = stage(moved.where(F.col("na") != F.col("nb")).select(
            *keys, F.greatest("na", "nb").alias("a"), F.least("na", "nb").alias("b")).distinct())
        if edges.isEmpty():
            return mapping
