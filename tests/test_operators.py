import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelloom.functions import color, numeric
from voxelloom.operators import (
    appearance, catalog, edits, histogram, mask as masking, measure, projection, resample, rle, roi, select, slicing,
)


def cells(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_flat_volume(spark, grid):
    voxels, volumes = grid(a=np.full((1, 3, 4), 7.0))
    assert histogram.histogram256(voxels, volumes).agg(F.sum("n")).first()[0] == 0
    assert measure.tolerance(volumes).first().tolerance == 0
    assert histogram.otsu_binary(histogram.binned(slicing.slices(voxels, "xy"), ["volume_id"]), ["volume_id"]).count() == 0
    assert catalog.volume_info(volumes).first().single_slice


def test_nan_is_left_out_of_the_range(spark):
    df = spark.createDataFrame([("a", 0, 0, 0, float("nan")), ("a", 0, 0, 1, 2.0)], "volume_id string, z int, y int, x int, v double")
    assert catalog.min_max(df).collect()[0][1:] == (2.0, 2.0)


def test_downsample_odd_extents(spark, grid):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 100, (5, 6, 9)).astype(float)
    voxels, volumes = grid(a=a)
    got = {(r.z, r.y, r.x): r.v for r in resample.downsample(voxels, volumes, 4).collect()}

    def ends(i, n):
        return sorted({i * 4, min(i * 4 + 4, n) - 1})
    for z in range(2):
        for y in range(2):
            for x in range(3):
                want = np.mean([a[k, j, i] for k in ends(z, 5) for j in ends(y, 6) for i in ends(x, 9)])
                assert got[z, y, x] == pytest.approx(want)
    assert len(got) == 12
    assert resample.downsample(voxels, volumes, 1).count() == a.size


@pytest.mark.parametrize("dst", [(2, 3, 4), (5, 6, 9), (3, 9, 4)])
def test_label_downsample_brute(spark, grid, labels, dst):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 4, (5, 6, 9))
    _, volumes = grid(a=a.astype(float))
    mask, masks = labels(a)
    targets = spark.createDataFrame([("a", dst[2], dst[1], dst[0])], "volume_id string, tx int, ty int, tz int")
    got = {(r.z, r.y, r.x): r.class_id for r in resample.label_downsample(mask, masks, volumes, targets).collect()}

    def span(i, s, d):
        lo = i * s // d
        return range(lo, max(lo + 1, (i + 1) * s // d))
    want = {}
    for z in range(dst[0]):
        for y in range(dst[1]):
            for x in range(dst[2]):
                count, best, top = {}, 0, 0
                for k in span(z, 5, dst[0]):
                    for j in span(y, 6, dst[1]):
                        for i in span(x, 9, dst[2]):
                            c = int(a[k, j, i])
                            if c:
                                count[c] = count.get(c, 0) + 1
                                if count[c] > top:
                                    best, top = c, count[c]
                if best:
                    want[z, y, x] = best
    assert got == want


def test_gradient_across_bricks(spark, grid):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 100, (5, 7, 6)).astype(float)
    voxels, _ = grid(a=a)
    p = np.pad(a, 1, mode="edge")
    want = {"gx": (p[1:-1, 1:-1, 2:] - p[1:-1, 1:-1, :-2]) / 2, "gy": (p[1:-1, 2:, 1:-1] - p[1:-1, :-2, 1:-1]) / 2,
            "gz": (p[2:, 1:-1, 1:-1] - p[:-2, 1:-1, 1:-1]) / 2}
    rows = appearance.gradient(voxels, 2).collect()
    assert len(rows) == a.size
    for r in rows:
        assert (r.gx, r.gy, r.gz) == tuple(want[k][r.z, r.y, r.x] for k in ("gx", "gy", "gz"))


def test_gradient_tasks_follow_the_rows(spark, grid, monkeypatch):
    monkeypatch.setattr(appearance, "GRADIENT_ROWS", 50)
    voxels, _ = grid(a=np.random.default_rng(5).integers(0, 100, (8, 8, 8)).astype(float))
    found = appearance.gradient(voxels, 2)
    # With bricks of two voxels each one is a halo row on three axes, but not those at coordinate 0: 512 + 3 * 8 * 8 * 7 rows.
    assert found.rdd.getNumPartitions() == -(-(512 + 1344) // 50)
    assert found.count() == 512


def test_composite_stops_and_opaque(spark):
    rows = [("a", z, 0, 0, a, float(z)) for z, a in enumerate([0.5, 0.5, 0.9, 0.9])] + [("a", z, 0, 1, a, 1.0 + z) for z, a in enumerate([0.2, 1.0, 0.7])]
    df = spark.createDataFrame(rows, "volume_id string, z int, y int, x int, alpha double, c double")
    got = {r.col: (r.c, r.alpha) for r in projection.composite(df, "xy", ["c"]).collect()}
    for x in (0, 1):
        c = a = 0.0
        for r in sorted(r for r in rows if r[3] == x):
            if a >= 0.95:
                break
            c, a = c + (1 - a) * r[4] * r[5], a + (1 - a) * r[4]
        assert got[x] == pytest.approx((c, a))


def test_rotation_returns_after_four_turns(spark, grid):
    voxels, volumes = grid(a=np.arange(12.0).reshape(1, 3, 4))
    start = slicing.with_extent(slicing.slices(voxels, "xy"), volumes, "xy")
    turned = start
    for _ in range(4):
        turned = slicing.rotate(turned, 1)
    assert cells(turned, "v", "u", "value") == cells(start, "v", "u", "value")
    assert cells(slicing.rotate(start, 2), "v", "u", "value") == cells(slicing.rotate(slicing.rotate(start, 1), 1), "v", "u", "value")


def test_quantiles_refine_until_small(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(0, 1, 3000), [1e12], np.full(500, 0.25)])
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double")
    got = {r.q: r.value for r in histogram.exact_quantiles(df, ["k"], "v", (0.0, 0.01, 0.5, 0.99, 1.0), limit=50).collect()}
    for q, v in got.items():
        assert v == pytest.approx(np.quantile(values, q))


def test_systematic_sample_matches_its_definition(spark):
    df = spark.range(1003).select(F.col("id").alias("linear"))
    for cap in (2, 7, 100, 1003, 5000):
        got = [r.linear for r in histogram.sample_systematic(df, F.lit(1003), cap).orderBy("linear").collect()]
        want = range(1003) if cap >= 1003 else sorted({int(i * (1002 / (cap - 1))) for i in range(cap)})
        assert got == list(want)


def test_multi_otsu_fallback(spark):
    hist = spark.createDataFrame([("a", 0.0, 255.0, 0, 5), ("a", 0.0, 255.0, 255, 5)], "k string, lo double, hi double, b int, n bigint")
    r = histogram.otsu_multi3(hist, ["k"]).first()
    assert (r.t1, r.t2) == (0, 42)
    assert histogram.otsu_multi3_strict(hist, ["k"]).count() == 0


def test_hex_and_rounding(spark):
    df = spark.createDataFrame([("#FF8000",), ("0a0B0c",), (" #zz0000",), ("#fff",)], "t string")
    rows = df.select(color.normalize_hex(F.col("t")).alias("n"), color.hex_to_rgb(F.col("t")).alias("c")).collect()
    assert [r.n for r in rows] == ["#ff8000", "#0a0b0c", None, None]
    assert rows[0].c == (1.0, 128 / 255, 0.0) and rows[2].c == (1.0, 0.0, 0.0)
    half = spark.range(1).select(numeric.round_half_up(F.lit(-0.5)).alias("a"), numeric.round_half_up(F.lit(2.5)).alias("b")).first()
    assert (half.a, half.b) == (0, 3)
    ids = spark.createDataFrame([(float("nan"),), (-3.0,), (2.5,), (900.0,), (float("inf"),)], "c double")
    assert [r[0] for r in ids.select(numeric.to_class_id(F.col("c"))).collect()] == [0, 0, 3, 255, 0]


# ---- masks and encodings -----------------------------------------------------------------------

def random_mask(seed=7, shape=(4, 6, 7), top=4):
    return np.random.default_rng(seed).integers(0, top, shape)


@pytest.mark.parametrize("block", [8, 64, 1 << 20])
@pytest.mark.parametrize("fill", [0, 2])
def test_binary_rle_equals_dense_scan(spark, grid, labels, block, fill):
    a = random_mask()
    a[1] = 1  # a run longer than several blocks
    _, volumes = grid(a=a.astype(float))
    mask, masks = labels(a, fill=fill)
    wanted = spark.createDataFrame([("m", c) for c in (0, 1, 2, 9)], "mask_id string, class_id int")
    runs = rle.rle_binary(mask, masks, volumes, wanted, block=block)
    flat = a.ravel()
    for c in (0, 1, 2, 9):
        bits = (flat == c).astype(int)
        cuts = np.flatnonzero(np.diff(bits)) + 1
        want = [(i + 1, int(p[0]), len(p)) for i, p in enumerate(np.split(bits, cuts))]
        assert cells(runs.where(F.col("class_id") == c), "run_no", "bit", "len") == want


@pytest.mark.parametrize("shape,value", [((2, 3, 4), 0), ((2, 3, 4), 3)])
def test_empty_and_full_mask(spark, grid, labels, shape, value):
    a = np.full(shape, value)
    _, volumes = grid(a=a.astype(float))
    mask, masks = labels(a)
    wanted = spark.createDataFrame([("m", 3)], "mask_id string, class_id int")
    assert cells(rle.rle_binary(mask, masks, volumes, wanted), "run_no", "bit", "len") == [(1, int(value == 3), 24)]
    assert cells(measure.class_counts(mask, masks, volumes), "class_id", "n") == [(value, 24)]


def test_binary_decode_rules(spark):
    lists = {1: ([0, 3, 0, 2, 5], 10), 2: ([4, 4], 9), 3: ([5, 5, 7], 10), 4: ([], 0), 5: ([12], 10)}
    runs = spark.createDataFrame([(k, i + 1, n) for k, (ns, _) in lists.items() for i, n in enumerate(ns)], "k int, run_no bigint, length bigint")
    heads = spark.createDataFrame([(k, t, 0) for k, (_, t) in lists.items()], "k int, total_voxels bigint, starts_with int")
    positions, refused = rle.rle_binary_decode(runs, heads, ["k"], block=2)
    assert cells(refused, "k") == [(2,), (5,)]
    # 0 zeros, 3 ones, 0 zeros, 2 ones, 5 zeros; and 5 zeros, 5 ones with a trailing run that is ignored
    assert cells(positions, "k", "linear") == [(1, i) for i in range(5)] + [(3, i) for i in range(5, 10)]


def test_expanded_runs_share_tasks(spark):
    """Many short runs and a long one: tasks follow the positions, not the runs."""
    short = spark.range(5000).select(F.lit("a").alias("k"), (F.col("id") * 3).alias("st"), F.lit(1).cast("bigint").alias("len"))
    long = spark.range(1).select(F.lit("b").alias("k"), F.lit(7).cast("bigint").alias("st"), F.lit(600_000).cast("bigint").alias("len"))
    found = rle.expand_runs(short.unionByName(long), ["k"])
    assert found.rdd.getNumPartitions() == -(-605_000 // rle.EXPAND_ROWS)
    got = {r.k: tuple(r)[1:] for r in found.groupBy("k").agg(
        F.count("linear"), F.countDistinct("linear"), F.min("linear"), F.max("linear"), F.sum("linear")).collect()}
    assert got == {"a": (5000, 5000, 0, 14_997, 3 * 4999 * 2500), "b": (600_000, 600_000, 7, 600_006, sum(range(7, 600_007)))}
    assert rle.expand_runs(short.limit(0), ["k"]).count() == 0


def test_tiles_roundtrip_and_refusal(spark, grid, labels):
    a = random_mask(shape=(9, 10, 17))
    a[:8, :8, :8] = 0
    _, volumes = grid(a=a.astype(float))
    mask, masks = labels(a)
    packed = rle.pack_tiles(rle.tile_runs(mask, masks, volumes, 8))
    assert packed.where("cz = 0 and cy = 0 and cx = 0").count() == 0
    rows, refused = rle.tiles_restore(packed, masks, volumes, 8)
    assert cells(rows, "z", "y", "x", "class_id") == cells(mask, "z", "y", "x", "class_id") and refused.count() == 0
    short = packed.withColumn("lengths", F.slice("lengths", 1, 1))
    rows, refused = rle.tiles_restore(short, masks, volumes, 8)
    assert rows.count() == 0 and refused.count() == packed.count()


def test_label_runs(spark):
    labels_ = [3, 3, 0, 0, 0, 1, 3, 3, 3, 3]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(labels_)], "k string, p bigint, v int")
    assert cells(rle.rle_label(df, ["k"], "p", "v", block=3), "st", "value", "len") == [(0, 3, 2), (2, 0, 3), (5, 1, 1), (6, 3, 4)]


def test_set_operations_and_remap_with_fill(spark, grid, labels):
    a = random_mask(top=3)
    _, volumes = grid(a=a.astype(float))
    mask, masks = labels(a, fill=1)
    out = masking.remap_class(mask, masks, volumes, 1, 2)
    assert cells(out.changed, "source", "changed") == [(1, int((a == 1).sum()))]
    assert out.masks.first().fill_value == 2
    b = np.where(a == 1, 2, a)
    assert cells(out.mask, "z", "y", "x", "class_id") == [(int(z), int(y), int(x), int(b[z, y, x])) for z, y, x in zip(*np.nonzero(b != 2))]
    assert masking.remap_class(mask, masks, volumes, 1, 1).changed.count() == 0
    assert masking.remap_class(mask, masks, volumes, 1, 900).changed.count() == 0


def test_write_and_restore(spark, grid, labels):
    a = random_mask()
    voxels, volumes = grid(a=a.astype(float))
    mask, masks = labels(a)
    chosen = select.threshold_slice(slicing.slices(voxels, "yz"), 3, 1)
    out = masking.write_selection(mask, masks, volumes, "yz", chosen, 2)
    hit = (a >= 1) & (a != 2)
    assert out.changes.count() == hit.sum()
    back = masking.restore(out.mask, masks, volumes, masking.with_linear(out.changes, masks, volumes))
    assert cells(back.mask, "z", "y", "x", "class_id") == cells(mask, "z", "y", "x", "class_id")


@pytest.mark.parametrize("fill", [0, 2])
def test_few_writes_and_many_give_the_same_mask(spark, grid, labels, fill):
    a = random_mask()
    _, volumes = grid(a=a.astype(float))
    mask, masks = labels(a, fill=fill)
    nz, ny, nx = a.shape
    up = spark.createDataFrame([("m", i % nz, i % ny, i * 7 % nx, i, float(i % 5)) for i in range(40)] + [("none", 0, 0, 0, 0, 1.0)],
                               "mask_id string, z int, y int, x int, seq int, class_id double")
    few, many = (masking.set_voxels(mask, masks, volumes, up, limit=n) for n in (100, 0))
    for x, y in zip(few, many):
        assert cells(x, *x.columns) == cells(y, *y.columns) and x.count() > 0
    b = a.copy()
    for i in range(40):
        b[i % nz, i % ny, i * 7 % nx] = i % 5
    assert cells(few.mask, "z", "y", "x", "class_id") == sorted(
        (int(z), int(y), int(x), int(b[z, y, x])) for z, y, x in zip(*np.nonzero(b != fill)))


def test_wanted_slices_reach_the_scan(spark, grid, tmp_path):
    voxels, _ = grid(a=np.arange(60.0).reshape(5, 3, 4))
    voxels.write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    wanted = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "volume_id string, idx int")
    got = slicing.slices(stored, "xy", wanted)
    assert {r.idx for r in got.collect()} == {1, 3} and got.count() == 24
    assert "GreaterThanOrEqual(z,1)" in got._jdf.queryExecution().executedPlan().toString()
    assert slicing.slices(stored, "xy", wanted.limit(0)).count() == 0


def test_set_voxels_last_write_wins_and_ignores_outside(spark, grid, labels):
    a = np.zeros((1, 2, 2), int)
    _, volumes = grid(a=a.astype(float))
    mask, masks = labels(np.where(a == 0, 1, a))
    up = spark.createDataFrame([("m", 0, 0, 0, 1, 5.0), ("m", 0, 0, 0, 2, 0.0), ("m", 0, 1, 1, 3, 300.0), ("m", 0, 9, 0, 4, 1.0)],
                               "mask_id string, z int, y int, x int, seq int, class_id double")
    out = masking.set_voxels(mask, masks, volumes, up)
    assert cells(out.mask, "y", "x", "class_id") == [(0, 1, 1), (1, 0, 1), (1, 1, 255)]
    assert cells(out.changes, "y", "x", "before_class", "after_class") == [(0, 0, 1, 0), (1, 1, 1, 255)]


# ---- history and registry ------------------------------------------------------------------------

class Stack:
    """Sequential replay of the edit history."""

    def __init__(self, depth=512):
        self.cls, self.undo_, self.redo_, self.depth = {}, [], [], depth

    def apply(self, key, edits_):
        delta = {}
        for vox, c in edits_:
            b = self.cls.get(vox, 0)
            if b != c:
                delta[vox] = (delta[vox][0] if vox in delta else b, c)
                self.cls[vox] = c
        if not delta:
            return
        if self.undo_ and key and self.undo_[-1][0] == key:
            top = self.undo_[-1][1]
            for vox, (b, c) in delta.items():
                top[vox] = (top[vox][0] if vox in top else b, c)
        else:
            self.undo_.append((key, delta))
            self.undo_ = self.undo_[-self.depth:]

    def step(self, source, sink, side):
        op = source.pop()
        changed = False
        for vox, pair in op[1].items():
            if self.cls.get(vox, 0) != pair[side]:
                self.cls[vox], changed = pair[side], True
        if changed:
            sink.append(op)


def test_history_equals_replay(spark, grid, labels):
    rng = np.random.default_rng(11)
    _, volumes = grid(a=np.zeros((1, 4, 4)))
    mask, masks = labels(np.zeros((1, 4, 4), int))
    stack, rows, seq = Stack(), [], 0
    for op in range(60):
        key = [None, "", "a", "a", "b"][rng.integers(5)]
        edits_ = [((0, int(rng.integers(4)), int(rng.integers(4))), int(rng.integers(3))) for _ in range(rng.integers(1, 4))]
        for vox, c in edits_:
            rows.append(("m", seq, op, key, *vox, c))
            seq += 1
        stack.apply(key, edits_)
    log = spark.createDataFrame(rows, "mask_id string, seq bigint, op_id bigint, merge_key string, z int, y int, x int, after_class int")
    strokes = edits.merge_strokes(edits.effective_edits(log, mask, masks, block=16), block=8).cache()
    assert strokes.select("stroke").distinct().count() == len(stack.undo_)
    now = edits.apply_edits(log, mask, masks, volumes).mask.cache()
    # Voxels set and reset within an operation keep a delta without effect; compare resulting states only.
    for _ in range(12):
        stack.step(stack.undo_, stack.redo_, 0)
    got = edits.undo(strokes, now, masks, volumes, 12).mask
    assert cells(got, "z", "y", "x", "class_id") == sorted((*v, c) for v, c in stack.cls.items() if c)
    for _ in range(5):
        stack.step(stack.redo_, stack.undo_, 1)
    got = edits.redo(strokes, now, masks, volumes, 12, 5).mask
    assert cells(got, "z", "y", "x", "class_id") == sorted((*v, c) for v, c in stack.cls.items() if c)


def test_registry_takes_candidates_in_order(spark):
    rows = [("m", 1, 1.0, "roi-7"), ("m", 2, 1.9, "roi-8"), ("m", 3, 2.0, "roi-8"), ("m", 4, 3.0, ""), ("m", 5, 0.2, None),
            ("m", 6, 4.0, None), ("m", 7, 5.0, "ROI-20"), ("m", 8, 6.0, None)]
    df = spark.createDataFrame(rows, "mask_id string, nth int, class_id double, roi_id string").selectExpr(
        "*", "cast(null as string) as name", "cast(null as string) as color_hex", "cast(null as boolean) as visible", "cast(null as boolean) as locked")
    got = cells(roi.add_rois_with_class(df), "ordinal", "class_id", "roi_id", "name")
    assert got == [(1, 1, "roi-7", "ROI 1"), (2, 2, "roi-8", "ROI 2"), (3, 3, "roi-9", "ROI 3"), (4, 4, "roi-10", "ROI 4"),
                   (5, 5, "ROI-20", "ROI 5"), (6, 6, "roi-21", "ROI 6")]


def test_no_class_id_left(spark, labels):
    _, masks = labels(np.ones((1, 1, 1), int))
    full = spark.createDataFrame([("m", f"roi-{i}", i) for i in range(1, 4)], "mask_id string, roi_id string, class_id int")
    assert roi.next_class_id(masks, full, 3).first().next_class_id is None
    assert roi.next_class_id(masks, full, 4).first().next_class_id == 4


def test_requests_beyond_the_last_class_id_are_refused(spark):
    masks = spark.createDataFrame([("a", "uint8"), ("b", "uint16")], "mask_id string, class_data_type string")
    rois = spark.createDataFrame([("a", "roi-1", 2, 1), ("b", "roi-1", 300, 1)], "mask_id string, roi_id string, class_id int, ordinal int")
    wanted = masks.select("mask_id", F.explode(F.sequence(F.lit(1), F.lit(300))).alias("nth"))
    added = roi.add_rois(masks, rois, wanted).groupBy("mask_id").agg(F.count("*").alias("n"), F.max("class_id").alias("top"))
    assert cells(added, "mask_id", "n", "top") == [("a", 254, 255), ("b", 300, 301)]
    late = roi.refused_rois(masks, rois, wanted)
    assert cells(late, "mask_id", "nth", "reject_reason") == [("a", n, "no free class id") for n in range(255, 301)]
    all_taken = masks.select("mask_id", F.explode(F.sequence(F.lit(1), F.lit(255))).alias("class_id"))
    assert cells(roi.next_class_id(masks, all_taken), "mask_id", "next_class_id") == [("a", None), ("b", 256)]


def test_invariants(spark, grid):
    a = np.random.default_rng(9).integers(0, 1000, (6, 9, 10)).astype(float)
    voxels, volumes = grid(a=a)
    p = projection.project(voxels, "xz")
    assert p.where("vmax < vavg or vavg < vmin").count() == 0
    assert histogram.histogram256(voxels, volumes).agg(F.sum("n")).first()[0] == a.size
    b = catalog.brick_minmax(voxels, 4)
    inside = voxels.withColumns(catalog.brick_of(4)).join(b, ["volume_id", "bz", "by", "bx"])
    assert inside.where("v < vmin or v > vmax").count() == 0


def test_slice_bounds_error(spark, grid):
    _, volumes = grid(a=np.zeros((2, 3, 4)))
    assert slicing.out_of_bounds(volumes, "xy", 2).count() == 1 and slicing.out_of_bounds(volumes, "xy", 1).count() == 0


def test_nan_has_no_part_in_ranges_and_bins(spark):
    values = [float("nan"), 1.0, 5.0, 3.0, float("nan"), float("nan")]
    voxels = spark.createDataFrame([("v", 0, i // 3 * 8, i % 3, x) for i, x in enumerate(values)], "volume_id string, z int, y int, x int, v double")
    volumes = spark.createDataFrame([("v", 3, 9, 1, 1.0, 5.0)], "volume_id string, nx int, ny int, nz int, vmin double, vmax double")
    assert histogram.histogram256(voxels, volumes).agg(F.sum("n")).first()[0] == 3
    got = {r.by: (r.vmin, r.vmax, r.n) for r in catalog.brick_minmax(voxels).collect()}
    assert got == {0: (1.0, 5.0, 3), 1: (3.0, 3.0, 3)}
    rays = {r.col: (r.vmin, r.vmax, r.vavg) for r in projection.project(voxels, "xz").collect()}
    assert all(None in x or not np.isnan(x).any() for x in rays.values())
    assert projection.project_visible(voxels, "xz", 4.0).agg(F.max("vmax")).first()[0] == 5.0


@pytest.mark.parametrize("values", [
    [float("-inf"), -1.0, 0.5, 0.5, 2.0, 7.0, float("inf"), float("inf")], [-1.7e308, 1.0, 1.7e308, 3.0, 2.0, -5.0],
    [5e-324, 1e-323, 1.5e-323, 0.0, 2e-323, 3e-323], [float("inf"), float("-inf"), 1.0]])
def test_quantiles_with_infinities_end(spark, values):
    cells = spark.createDataFrame([("g", x, i) for i, x in enumerate(values)], "g string, value double, idx int")
    probs = [i / (len(values) - 1) for i in range(len(values))]
    got = histogram.exact_quantiles(cells, ["g"], "value", probs, limit=2).collect()
    assert sorted(r.q for r in got) == probs
    middle = {round(r.q * (len(values) - 1)): r.value for r in got}
    want = sorted(values)
    assert [middle[i] for i in range(len(want))] == want


def test_class_ids_above_255_are_kept(spark):
    mask = spark.createDataFrame([("m", 0, 0, 0, 300), ("m", 0, 0, 1, 70)], "mask_id string, z int, y int, x int, class_id int")
    masks = spark.createDataFrame([("m", "v")], "mask_id string, volume_id string")
    volumes = spark.createDataFrame([("v", 2, 1, 1)], "volume_id string, nx int, ny int, nz int")
    targets = spark.createDataFrame([("v", 1, 1, 1)], "volume_id string, tx int, ty int, tz int")
    assert [r.class_id for r in resample.label_scatter(mask, masks, volumes, targets).collect()] == [300]
    assert [r.class_id for r in resample.label_scatter(mask, masks, volumes, targets, display=True).collect()] == [70]
    assert [r.class_id for r in resample.label_downsample(mask, masks, volumes, targets).collect()] == [300]


def test_pictures_of_several_masks_on_a_volume(spark, grid, labels):
    """Each mask colours its own picture; a mask without marked cells leaves the grey one."""
    rng = np.random.default_rng(12)
    a = rng.integers(0, 100, (3, 4, 5)).astype(float)
    voxels, volumes = grid(a=a)
    classes = {"m": rng.integers(0, 3, a.shape), "n": rng.integers(0, 3, a.shape), "none": np.zeros(a.shape, int)}
    built = {k: labels(c, mask_id=k) for k, c in classes.items()}
    mask, masks = built["m"]
    for k in ("n", "none"):
        mask, masks = mask.unionByName(built[k][0]), masks.unionByName(built[k][1])
    colour = {("m", 1): (1.0, 0.0, 0.0), ("m", 2): (0.0, 1.0, 0.0), ("n", 1): (0.0, 0.0, 1.0), ("n", 2): (0.5, 0.5, 0.0)}
    palette = spark.createDataFrame([(m, c, *rgb, 1.0) for (m, c), rgb in colour.items()], "mask_id string, class_id int, r double, g double, b double, a double")
    cells = mask.selectExpr("mask_id", "z as idx", "y as v", "x as u", "class_id")
    out = appearance.overlay_blend(slicing.slices(voxels, "xy"), masks, cells, palette, 0.0, 100.0, 0.25).collect()
    assert len(out) == 3 * a.size
    for r in out:
        grey, c = a[r.idx, r.v, r.u] / 100, classes[r.mask_id][r.idx, r.v, r.u]
        top = colour.get((r.mask_id, c))
        want = [grey if top is None else grey * 0.75 + top[k] * 0.25 for k in range(3)]
        assert np.allclose([r.r, r.g, r.b], want)
    base = spark.createDataFrame([("a", y, x, 0.5, 0.5, 0.5) for y in range(4) for x in range(5)],
                                 "volume_id string, row int, col int, r double, g double, b double")
    lit = mask.join(palette, ["mask_id", "class_id"]).withColumn("alpha", F.lit(0.5))
    mixed = projection.blend(base, masks, projection.composite(lit, "xy", ["r", "g", "b"]), ["r", "g", "b"]).collect()
    assert len(mixed) == 3 * 20
    for r in mixed:
        total, front = np.zeros(4), 1.0
        for z in range(3):
            top = colour.get((r.mask_id, classes[r.mask_id][z, r.row, r.col]))
            if top is not None:
                total += front * 0.5 * np.array([*top, 1.0])
                front *= 0.5
        assert np.allclose([r.r, r.g, r.b], 0.5 * (1 - total[3]) + total[:3] * total[3])
