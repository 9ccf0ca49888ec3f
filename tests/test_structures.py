"""The structures that spare reading, against brute force and with what they read as evidence."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, Not

from voxelloom.operators import histogram, history, measure, projection, raymerge, rectindex, resample, runsets, sketches
from voxelloom.sources import bricks, bricktree, colocated, pyramidstore, volume_format
from voxelloom.streaming import edits as edit_stream, voxel_state


# ---- data source -----------------------------------------------------------------------------

@pytest.fixture
def stored(grid, tmp_path):
    rng = np.random.default_rng(1)
    arrays = {"a": rng.integers(0, 200, (12, 4, 5)), "b": rng.integers(0, 200, (3, 2, 2))}
    voxels, volumes = grid(**arrays)
    path = str(tmp_path / "volumes")
    volume_format.write_volumes(voxels, volumes.replace("float32", "uint8"), path)
    return path, arrays


def cells(df):
    return {(r.volume_id, r.z, r.y, r.x, r.v) for r in df.collect()}


def test_source_reads_what_was_written(spark, stored):
    path, arrays = stored
    want = {(n, z, y, x, float(v)) for n, a in arrays.items() for (z, y, x), v in np.ndenumerate(a)}
    assert cells(volume_format.read_volumes(spark, path)) == want
    where = "volume_id = 'a' and z > 2 and z <= 7 and y = 1"
    assert cells(volume_format.read_volumes(spark, path, where)) == {c for c in want if c[0] == "a" and 2 < c[1] <= 7 and c[2] == 1}
    assert cells(volume_format.read_volumes(spark, path, "z in (1, 2, 9) or v < 0")) == {c for c in want if c[1] in (1, 2, 9)}


def test_filters_cut_partitions(spark, stored):
    """A slab holds two slices of volume a; only those that are wanted are planned."""
    path, _ = stored
    every = volume_format.read_volumes(spark, path, slab_bytes=40)
    some = volume_format.read_volumes(spark, path, "volume_id = 'a' and z between 4 and 6", slab_bytes=40)
    assert every.rdd.getNumPartitions() >= 7 and some.rdd.getNumPartitions() == 2
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    reader = volume_format.VolumeReader({"path": path, "slabBytes": "40"})
    left = list(reader.pushFilters([GreaterThan(("z",), 2), LessThanOrEqual(("z",), 9), In(("z",), (1, 3, 4, 9, 11)),
                                    EqualTo(("y",), 1), Not(EqualTo(("z",), 4)), EqualTo(("volume_id",), "a")]))
    assert [type(f).__name__ for f in left] == ["EqualTo", "Not"]
    runs = [(s["z0"], s["slices"]) for p in reader.partitions() for s in p.slabs]
    assert sorted(runs) == [(3, 2), (9, 1)]


def test_source_appends_and_overwrites(spark, grid, stored):
    path, arrays = stored
    more, volumes = grid(c=np.full((2, 1, 1), 7))
    volume_format.write_volumes(more, volumes, path)
    assert {c[0] for c in cells(volume_format.read_volumes(spark, path))} == {"a", "b", "c"}
    volume_format.write_volumes(more, volumes, path, mode="overwrite")
    assert cells(volume_format.read_volumes(spark, path)) == {("c", z, 0, 0, 7.0) for z in (0, 1)}
    assert volume_format.read_volumes(spark, path, "z > 5").count() == 0


def test_source_refuses_holes(grid, tmp_path):
    voxels, volumes = grid(a=np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="slice 1 has 3 of 4"):
        volume_format.write_volumes(voxels.where("not (z = 1 and y = 1 and x = 1)"), volumes, str(tmp_path / "holes"))


# ---- command history -------------------------------------------------------------------------

def queue(kinds, depth=None):
    """A queue with two stacks: yields (level, operation) of each command."""
    undo, redo, gone = [], [], 0
    for seq, kind in enumerate(kinds):
        if kind == "do":
            undo.append(seq)
            redo.clear()
            if depth is not None and len(undo) > depth:
                undo.pop(0)
                gone += 1
            yield gone + len(undo), seq
        elif kind == "undo" and undo:
            redo.append(undo.pop())
            yield gone + len(undo) + 1, redo[-1]
        elif kind == "redo" and redo:
            undo.append(redo.pop())
            yield gone + len(undo), undo[-1]
        else:
            yield None, None


@pytest.mark.parametrize("depth", [None, 1, 6])
def test_block_summaries(depth):
    rng = np.random.default_rng(0)
    for _ in range(400):
        codes = rng.choice([1, -1, 0], int(rng.integers(1, 14)), p=rng.dirichlet([1, 1, 1]))
        t = int(rng.integers(0, depth + 1 if depth else 30))
        d = int(rng.integers(0, t + 1))
        got = history.after(history.summary(codes, depth), d, t, 5)
        dropped = 5
        for c in codes.tolist():
            if c == history.DO:
                dropped += depth is not None and d == depth
                d = min(d + 1, depth or 100)
                t = d
            else:
                d = max(d - 1, 0) if c == history.UNDO else min(d + 1, t)
        assert got == (d, t, dropped)


@pytest.mark.parametrize("depth, block", [(None, 7), (None, 1000), (4, 7), (1, 50)])
def test_history(spark, depth, block):
    rng = np.random.default_rng(block)
    logs = {"hot": rng.choice(["do", "undo", "redo"], 700, p=[.4, .35, .25]).tolist(),
            "deep": ["do"] * 60 + ["undo"] * 45 + ["redo"] * 30 + ["undo"] * 70 + ["redo"] * 90 + ["do", "redo", "undo", "undo"],
            "none": ["undo", "redo", "redo"], "one": ["do"]}
    rows = [(m, i * 3, k) for m, kinds in logs.items() for i, k in enumerate(kinds)]
    got = {(r.mask_id, r.seq): (r.level, r.op_seq) for r in history.match(
        spark.createDataFrame(rows, "mask_id string, seq bigint, kind string"), depth, block).collect()}
    want = {(m, i * 3): (level, None if op is None else op * 3) for m, kinds in logs.items()
            for i, (level, op) in enumerate(queue(kinds, depth))}
    assert got == want


def test_history_mask(spark, grid, labels):
    """Against two stacks that hold operations as they are done, taken back and repeated."""
    rng = np.random.default_rng(8)
    _, volumes = grid(a=np.zeros((1, 4, 4)))
    held = rng.integers(0, 3, (1, 4, 4))
    mask, masks = labels(held)
    kinds = rng.choice(["do", "undo", "redo"], 120).tolist()
    writes = {s: [(int(p) // 4, int(p) % 4, int(rng.integers(5))) for p in rng.choice(16, 3, replace=False)] for s in range(120)}
    state, before = held.copy(), {}
    for s, (kind, (_, op)) in enumerate(zip(kinds, queue(kinds, 5))):
        for y, x, c in writes[op] if op is not None else ():
            if kind == "undo":
                state[0, y, x] = before[op][y, x]
        if op is not None and kind != "undo":
            before[op] = state[0].copy()
            for y, x, c in writes[op]:
                state[0, y, x] = c
    out = history.replay(
        spark.createDataFrame([("m", s, k) for s, k in enumerate(kinds)], "mask_id string, seq bigint, kind string"),
        spark.createDataFrame([("m", s, 0, *w) for s, ws in writes.items() for w in ws],
                              "mask_id string, op_seq bigint, z int, y int, x int, after_class int"),
        mask, masks, volumes, depth=5, block=16).mask
    got = np.zeros((1, 4, 4), int)
    for r in out.collect():
        got[r.z, r.y, r.x] = r.class_id
    assert (got == state).all()


# ---- brick tree ------------------------------------------------------------------------------

def rows_read(df):
    """Rows that the scan of a plan without a shuffle hands on."""
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()  # the metrics belong to this frame's own plan
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value(), len(rows)


@pytest.fixture
def tree(spark, grid, tmp_path):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 50, (20, 37, 70)).astype(float)
    a[3:6, 30:, 60:] = 900
    a[8:16, 8:16, 8:16] = np.nan
    arrays = {"a": a, "b": rng.integers(0, 40, (3, 2, 2)).astype(float)}
    voxels, volumes = grid(**arrays)
    path = str(tmp_path / "tree")
    top = bricktree.write_tree(voxels.repartition(4), volumes, path, 4, file_bytes=8 * 64 * 30)
    return path, arrays, top, voxels


def test_tree_levels(spark, tree):
    path, arrays, top, _ = tree
    levels = {}
    for r in bricktree.read_levels(spark, path).collect():
        levels.setdefault((r.volume_id, r.level), {})[r.code] = (r.vmin, r.vmax, r.bricks)
    assert top == 5 and set(levels) == {(v, n) for v in "ab" for n in range(6)}
    for (name, level), nodes in levels.items():
        a, side = arrays[name], 4 << level
        want = {}
        for z in range(0, a.shape[0], side):
            for y in range(0, a.shape[1], side):
                for x in range(0, a.shape[2], side):
                    part = a[z:z + side, y:y + side, x:x + side]
                    code = sum((c // side >> i & 1) << 3 * i + k for i in range(8) for k, c in enumerate((x, y, z)))
                    known = part[~np.isnan(part)]
                    bricks = int(np.prod([-(-n // 4) for n in part.shape]))
                    want[code] = (known.min() if len(known) else None, known.max() if len(known) else None, bricks)
        assert nodes == want


def test_search_reads_few_bricks(spark, tree):
    path, arrays, _, _ = tree
    every = spark.read.parquet(f"{path}/bricks").count()
    found = bricktree.search(spark, path, F.col("vmax") >= 800.0)
    scanned, kept = rows_read(spark.read.parquet(f"{path}/bricks").where(found.pruned))
    assert kept == found.codes.count() == 18 and scanned < every / 4
    got = {(r.volume_id, r.z, r.y, r.x) for r in bricktree.threshold(spark, path, 800, 1000, 4).collect()}
    assert got == {("a", *map(int, at)) for at in np.argwhere(arrays["a"] >= 800)}
    assert bricktree.threshold(spark, path, 5000, 9000, 4).count() == 0


@pytest.mark.parametrize("nodes", [bricktree.NODES, 3])
def test_threshold_at_any_width(spark, tree, monkeypatch, nodes):
    """With few nodes at the driver, the last narrow level prunes and the joins do the rest."""
    path, arrays, _, _ = tree
    monkeypatch.setattr(bricktree, "NODES", nodes)
    got = {(r.volume_id, r.z, r.y, r.x) for r in bricktree.threshold(spark, path, 48, 1000, 4).collect()}
    assert got == {(n, *map(int, at)) for n, a in arrays.items() for at in np.argwhere(a >= 48)}


@pytest.mark.parametrize("axis", ["xy", "xz", "yz"])
def test_project_visible_tree(spark, tree, axis):
    path, _, _, voxels = tree
    want = {(r.volume_id, r.row, r.col): (r.vmax, r.vmin, round(r.vavg, 9)) for r in projection.project_visible(voxels, axis, 48, 4).collect()}
    got = {(r.volume_id, r.row, r.col): (r.vmax, r.vmin, round(r.vavg, 9)) for r in bricktree.project_visible(spark, path, axis, 48, 4).collect()}
    assert got == want


def test_ranges():
    nodes = [("a", c) for c in (1, 2, 3, 9, 10, 50)] + [("b", 4)]
    assert bricktree.ranges_of(nodes) == [("a", 1, 3), ("a", 9, 10), ("a", 50, 50), ("b", 4, 4)]
    assert bricktree.ranges_of(nodes, 3) == [("a", 1, 10), ("a", 50, 50), ("b", 4, 4)]
    assert bricktree.ranges_of(nodes, 1) == [("a", 1, 50), ("b", 4, 4)]  # volumes are never joined
    assert bricktree.ranges_of([]) == []


# ---- stream state per voxel ------------------------------------------------------------------

def test_voxel_state_over_batches_and_a_restart(spark, grid, labels, tmp_path):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 50, (2, 20, 20)).astype(float)
    voxels, volumes = grid(a=a)
    _, masks = labels(np.zeros((1, 1, 1), int))
    edits = "mask_id string, seq bigint, z int, y int, x int, after_class int"
    rows = [("m", i, int(rng.integers(2)), int(rng.integers(20)), int(rng.integers(20)), int(rng.integers(3))) for i in range(900)]
    rows += [("m", 900 + i, 1, 1, 1, i % 3) for i in range(300)]  # one voxel gets a quarter of all edits
    source = tmp_path / "in"

    def arrive(part):
        spark.createDataFrame(part, edits).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema(edits).option("maxFilesPerTrigger", 1).parquet(str(source))
        voxel_state.follow_stats(stream, masks, voxels, str(tmp_path / "out"), str(tmp_path / "check"), volumes=volumes).awaitTermination()

    before = spark.conf.get(voxel_state._SETTING)
    arrive(rows[:400])
    arrive(rows[400:800])
    run()
    arrive(rows[800:])
    arrive(rows[100:300])  # repeated
    arrive([("m", 3, 1, 1, 1, 9)])  # late
    run()  # a new query goes on where the first one ended
    assert spark.conf.get(voxel_state._SETTING) == before
    cls = np.zeros(a.shape, int)
    for _, _, z, y, x, c in rows:
        cls[z, y, x] = c
    got = {r.class_id: r for r in measure.stats_of(edit_stream.current_moments(spark, str(tmp_path / "out")), volumes).collect()}
    for c in (1, 2):
        v = a[cls == c]
        assert got[c].voxels == len(v) and abs(got[c].mean - v.mean()) < 1e-9 and abs(got[c]["std"] - v.std()) < 1e-6
    assert 9 not in got or got[9].voxels == 0


# ---- co-located bricks -----------------------------------------------------------------------

def test_colocated_stats_need_no_shuffle_below_the_sum(spark, grid, labels):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(7, 10, 13))
    cls = rng.integers(0, 4, a.shape)
    voxels, volumes = grid(a=a)
    mask, masks = labels(cls)
    more, more_masks = labels(rng.integers(0, 2, a.shape), mask_id="n")
    names = [f"t{uuid.uuid4().hex}" for _ in range(2)]
    colocated.write_grid(voxels, volumes, names[0], 4, 4)
    colocated.write_mask(mask.unionByName(more), masks.unionByName(more_masks), volumes, names[1], 4, 4)
    got = colocated.class_moments(spark, *names)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("HashAggregate") < plan.index("Exchange") < plan.index("SortMergeJoin")
    rows = {(r.mask_id, r.class_id): r for r in got.collect()}
    for c in (1, 2, 3):
        v = a[cls == c]
        r = rows["m", c]
        assert (r.voxels, r.samples) == (len(v), len(v)) and np.allclose([r.total, r.total_sq], [v.sum(), (v * v).sum()])
    assert ("n", 1) in rows
    for n in names:
        spark.sql(f"drop table {n}")


# ---- merged rays -----------------------------------------------------------------------------

@pytest.mark.parametrize("axis", ["xy", "xz", "yz"])
def test_composite_by_segments(spark, grid, axis):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 100, (11, 9, 14)).astype(float)
    a[:, 2, 3] = 100.0  # opaque at once
    a[:, 5, 6] = 0.0
    voxels, volumes = grid(a=a)
    shade = lambda v: np.stack([v / 100, 1 - v / 100, np.full_like(v, 0.5), np.where(v == 100, 1.0, v / 400)], axis=-1)
    got = raymerge.composite(bricks.to_bricks(voxels, volumes, 4), axis, shade, 4)
    fixed = {"xy": 0, "xz": 1, "yz": 2}[axis]
    rays = np.moveaxis(a, fixed, 2)
    seen = set()
    for r in got.collect():
        want, front = np.zeros(4), 1.0
        for v in rays[r.row, r.col]:
            if 1 - front >= 0.95:
                break
            red, green, blue, alpha = shade(np.array(v))
            want += front * alpha * np.array([red, green, blue, 1.0])
            front *= 1 - alpha
        assert np.allclose([r.r, r.g, r.b, r.alpha], want, atol=1e-9)
        seen.add((r.row, r.col))
    assert seen == set(np.ndindex(rays.shape[:2]))


# ---- run sets --------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [5, 1 << 20])
def test_run_sets(spark, block):
    rng = np.random.default_rng(block)

    def runs(sets):
        out = []
        for key, bits in sets.items():
            at = np.flatnonzero(np.diff(np.concatenate([[0], bits, [0]])))
            for st, end in zip(at[::2], at[1::2]):
                middle = (st + end) // 2  # neighbours may touch
                out += [(key, int(st), int(end - st))] if end - st < 4 else [(key, int(st), int(middle - st)), (key, int(middle), int(end - middle))]
        return spark.createDataFrame(out, "k string, st bigint, len bigint")

    a = {k: (rng.random(n) < p).astype(int) for k, n, p in (("x", 200, .5), ("y", 60, .9), ("only a", 20, .5))}
    b = {k: (rng.random(n) < p).astype(int) for k, n, p in (("x", 200, .3), ("y", 60, .2), ("only b", 20, .5))}
    for fn, holds in ((runsets.union, np.logical_or), (runsets.difference, lambda p, q: p & ~q), (runsets.intersection, np.logical_and)):
        got = {}
        for r in fn(runs(a), runs(b), ["k"], block).collect():
            got.setdefault(r.k, []).append((r.st, r.st + r.len))
        for k in {*a, *b}:
            n = len(a.get(k, b.get(k)))
            bits = holds(*(s.get(k, np.zeros(n, int)).astype(bool) for s in (a, b)))
            edges = np.flatnonzero(np.diff(np.concatenate([[0], bits.astype(int), [0]])))
            assert sorted(got.get(k, [])) == [(int(s), int(e)) for s, e in zip(edges[::2], edges[1::2])]


# ---- rectangles ------------------------------------------------------------------------------

@pytest.mark.parametrize("tile", [4, 64])
def test_rectangles_by_blocks(spark, grid, tile):
    rng = np.random.default_rng(tile)
    a = rng.normal(size=(2, 37, 45))
    a[0, 5:9, 5:30] = np.nan
    a[1] = 3.0  # flat
    voxels, volumes = grid(a=a)
    rects = [(i, "a", int(rng.integers(3)), *(float(x) for x in rng.uniform(-4, 50, 4))) for i in range(150)]
    rects += [(200 + i, "a", 0, 0.0, 0.0, 44.9, 36.0) for i in range(50)] + [(300, "a", 0, 3.0, 3.0, 3.5, 9.0)]
    frame = spark.createDataFrame(rects, "rect_id int, volume_id string, idx int, x1 double, y1 double, x2 double, y2 double")
    want = {(r.rect_id, r.vmin, r.vmax) for r in measure.rect_range(frame, voxels, volumes, "xy").collect()}
    got = {(r.rect_id, r.vmin, r.vmax) for r in rectindex.rect_range(frame, voxels, volumes, "xy", tile).collect()}
    assert got == want and len(want) > 60


def test_dyadic_cover(spark):
    rows = spark.createDataFrame([(a, b) for a in range(0, 40, 3) for b in range(a + 1, 45)], "a int, b int")
    for r in rows.select("a", "b", rectindex.dyadic(F.col("a"), F.col("b")).alias("n")).collect():
        cells = [x for n in r.n for x in range(n.no << n.level, n.no + 1 << n.level)]
        assert sorted(cells) == list(range(r.a, r.b)) and len(r.n) <= 2 * 6


# ---- sketches --------------------------------------------------------------------------------

PROBS = (0.0, 0.01, 0.37, 0.5, 0.99, 1.0)


@pytest.mark.parametrize("points", [3, 16, 1000])
def test_quantiles_from_sketches(spark, grid, points):
    rng = np.random.default_rng(8)
    a = np.round(rng.normal(0, 40, (9, 14, 11)))
    a[:4, :4, :4] = np.nan
    a[5, 5, :3] = (np.inf, -np.inf, np.nan)
    b = rng.integers(0, 3, (2, 3, 2)).astype(float)
    voxels, volumes = grid(a=a, b=b, c=np.full((2, 2, 2), np.nan), d=np.full((1, 1, 1), 5.0))
    packed = bricks.to_bricks(voxels, volumes, 4).cache()
    small = sketches.brick_sketches(packed, points)
    for r in small.collect():
        assert sum(p.w for p in r.points) == r.n and [p.val for p in r.points] == sorted(p.val for p in r.points)
        assert max(p.w for p in r.points) <= r.slack + 1 and r.points[-1].val == r.vmax
    got = {(r.volume_id, r.q): r.value for r in sketches.quantiles(small, packed, ["volume_id"], PROBS).collect()}
    want = {(r.volume_id, r.q): r.value for r in histogram.exact_quantiles(voxels, ["volume_id"], "v", PROBS).collect()}
    assert got == want and len(got) == 3 * len(PROBS)
    some = "bz <= 1 and by between 1 and 2"
    part = {(r.volume_id, r.q): r.value for r in sketches.quantiles(small.where(some), packed.where(some), ["volume_id"], PROBS).collect()}
    cut = voxels.where("z < 8 and y between 4 and 11")
    assert part == {(r.volume_id, r.q): r.value for r in histogram.exact_quantiles(cut, ["volume_id"], "v", PROBS).collect()}
    assert sketches.quantiles(small.limit(0), packed.limit(0), ["volume_id"], PROBS).count() == 0


def test_quantiles_open_few_bricks(spark, grid):
    """Where values rise through a grid, only the bricks around the wanted rank are read."""
    voxels, volumes = grid(a=np.arange(32 * 8 * 8, dtype=float).reshape(32, 8, 8))
    packed = bricks.to_bricks(voxels, volumes, 4).cache()
    small = sketches.brick_sketches(packed, 16).cache()
    spans = sketches.enclose(small, ["volume_id"], [0.5])
    opened = packed.where(sketches._reaching(spans, ["volume_id"])).count()
    assert 0 < opened <= packed.count() / 4
    for r in spans.first().spans:
        assert (r.lo is None or r.lo < r.rank) and r.hi >= r.rank


# ---- pyramid upkeep --------------------------------------------------------------------------

def test_pyramid_upkeep(spark, grid, tmp_path):
    """Equal to a full rebuild after every update; an update reads the touched bricks only; a lost update changes nothing."""
    rng = np.random.default_rng(9)
    arrays = {"a": rng.integers(0, 90, (18, 21, 33)).astype(float), "b": rng.integers(0, 90, (3, 5, 2)).astype(float)}
    voxels, volumes = grid(**arrays)
    path, other = str(tmp_path / "p"), str(tmp_path / "q")
    pyramidstore.write_pyramid(voxels, volumes, path, size=4, file_bytes=8 * 64 * 20)
    kind = "volume_id string, z int, y int, x int, v double, seq int"
    batches = [
        [("a", 17, 20, 32, 5.0, 1), ("a", 0, 0, 0, 7.0, 2), ("a", 0, 0, 0, 6.0, 1), ("a", 18, 0, 0, 1.0, 3), ("no", 0, 0, 0, 1.0, 4)],
        [("a", 0, 0, 3, -4.0, 9), ("b", 2, 4, 1, 8.0, 9), ("b", 2, 3, 1, None, 10)],
        []]

    def levels(where):
        return {(n, r.volume_id, r.z, r.y, r.x): r.v for n in ("low", "mid", "full")
                for r in pyramidstore.read_voxels(spark, where, n, 4).collect()}

    def rebuilt():
        return {(r.level, r.volume_id, r.z, r.y, r.x): r.v for r in resample.pyramid(grid(**arrays)[0], volumes).collect()}

    assert levels(path) == pytest.approx(rebuilt())
    for no, batch in enumerate(batches, 1):
        assert pyramidstore.update(spark, path, spark.createDataFrame(batch, kind), size=4) == no
        for name, z, y, x, v, _ in sorted(batch, key=lambda c: c[-1]):
            if v is not None and name in arrays and all(c < n for c, n in zip((z, y, x), arrays[name].shape)):
                arrays[name][z, y, x] = v
        assert levels(path) == pytest.approx(rebuilt())
    assert spark.read.parquet(f"{path}/full").where("version = 1").count() == 2
    keys = spark.createDataFrame([("a", 4, 5, 8)], "volume_id string, bz int, by int, bx int").withColumn("code", bricktree.morton())
    scanned, kept = rows_read(spark.read.parquet(f"{path}/full").where(bricktree.within(bricktree.ranges_of([("a", keys.first().code)]), 0)))
    assert kept == 2 and scanned < spark.read.parquet(f"{path}/full").count() / 4  # version 0 and version 1
    assert pyramidstore.read_touched(spark, path, keys).count() == 1
    spark.read.parquet(f"{path}/full/version=1").withColumn("vmax", F.lit(0.0)).write.parquet(f"{path}/full/version=4")  # a lost update
    assert levels(path) == pytest.approx(rebuilt())
    pyramidstore.compact(spark, path, other, size=4)
    assert levels(other) == pytest.approx(rebuilt())
