import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.operators import components, select, slicing


def fill(mask, connectivity):
    """Plain flood fill; label = first cell in row-major order."""
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    out = {}
    for start in zip(*np.nonzero(mask)):
        if start in out:
            continue
        todo, out[start] = [start], start
        while todo:
            v, u = todo.pop()
            for dv, du in steps:
                n = (v + dv, u + du)
                if 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and mask[n] and n not in out:
                    out[n] = start
                    todo.append(n)
    return out


def run(spark, masks, connectivity, tile):
    rows = [(i, int(v), int(u)) for i, m in enumerate(masks) for v, u in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows, "s int, v int, u int")
    found = components.components(df, ["s"], connectivity, tile).collect()
    return {(r.s, r.v, r.u): (r.label >> 31, r.label & 0x7FFFFFFF) for r in found}


@pytest.mark.parametrize("connectivity,tile", [(4, 5), (8, 5), (8, 256)])
def test_random_masks(spark, connectivity, tile):
    rng = np.random.default_rng(3)
    masks = [rng.random((23, 31)) < p for p in (0.35, 0.55, 0.9)]
    want = {(i, int(v), int(u)): (int(r[0]), int(r[1])) for i, m in enumerate(masks) for (v, u), r in fill(m, connectivity).items()}
    assert run(spark, masks, connectivity, tile) == want


def corridor(n):
    m = np.zeros((n, n), bool)
    m[::2] = True
    for i, row in enumerate(range(1, n, 2)):
        m[row, -1 if i % 2 == 0 else 0] = True
    return m


def test_winding_corridor_longer_than_width_plus_height(spark):
    m = corridor(33)
    got = run(spark, [m], 4, 4)
    assert len(got) == m.sum() > 500 and set(got.values()) == {(0, 0)}


def test_spiral_with_hot_root(spark):
    edges = spark.createDataFrame([("k", i, 0) for i in range(1, 300)] + [("k", i + 1, i) for i in range(300, 400)], "k string, a bigint, b bigint")
    roots = {r.node: r.root for r in components.contract(edges, ["k"]).collect()}
    assert all(roots[i] == 0 for i in range(300)) and all(roots[i] == 300 for i in range(300, 401))


def grow(values, v, u, tol):
    ok = np.abs(values - values[v, u]) <= tol
    labels = fill(ok, 8)
    return {c for c, r in labels.items() if r == labels[(v, u)]}


def test_region_grow(spark, grid):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 10, (4, 12, 15)).astype(float)
    voxels, _ = grid(a=a)
    seeds = [(0, 0, 0), (1, 11, 14), (2, 5, 5), (3, 40, 2)]  # the last lies outside
    frame = spark.createDataFrame([("a", "xy", z, v, u) for z, v, u in seeds], "volume_id string, axis string, idx int, sv int, su int")
    got = select.region_grow(slicing.slices(voxels, "xy"), frame, 3.0, tile=4).collect()
    for z, v, u in seeds[:3]:
        assert {(r.v, r.u) for r in got if r.idx == z} == {(int(p), int(q)) for p, q in grow(a[z], v, u, 3.0)}
    assert not [r for r in got if r.idx == 3]


def test_drop_small_islands(spark):
    m = np.zeros((20, 30), bool)
    m[2:6, 2:6] = True       # 16 cells, kept
    m[10:13, 10:13] = True   # 9 cells, dropped
    m[6, 6] = True           # touches the first only by a corner
    rows = [("a", "xy", 0, int(v), int(u)) for v, u in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows, "volume_id string, axis string, idx int, v int, u int")
    areas = spark.createDataFrame([("a", "xy", 0, 600)], "volume_id string, axis string, idx int, area int")
    left = select.drop_small_islands(df, areas, tile=3)
    assert left.count() == 16 and left.where(F.col("v") >= 6).count() == 0
