import numpy as np
from pyspark.sql import functions as F

from voxelloom.operators import measure
from voxelloom.streaming import edits, slabs

EDITS = "mask_id string, seq bigint, z int, y int, x int, after_class int"


def test_edits_over_several_batches(spark, grid, labels, tmp_path):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 50, (2, 20, 20)).astype(float)
    voxels, volumes = grid(a=a)
    _, masks = labels(np.zeros((1, 1, 1), int))
    rows = [("m", i, int(rng.integers(2)), int(rng.integers(20)), int(rng.integers(20)), int(rng.integers(3))) for i in range(1500)]
    rows += [("m", 1500 + i, 1, 1, 1, i % 3) for i in range(500)]  # one voxel gets a quarter of all edits
    source = tmp_path / "in"
    for lo in range(0, 2000, 500):
        spark.createDataFrame(rows[lo:lo + 500], EDITS).coalesce(1).write.mode("append").parquet(str(source))
    spark.createDataFrame([("m", 3, 1, 1, 1, 9)], EDITS).coalesce(1).write.mode("append").parquet(str(source))  # late
    stream = spark.readStream.schema(EDITS).option("maxFilesPerTrigger", 1).parquet(str(source))
    edits.follow_stats(stream, masks, voxels, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert len(list((tmp_path / "out").glob("batch=*"))) >= 4
    cls = np.zeros(a.shape, int)
    for _, _, z, y, x, c in rows:
        cls[z, y, x] = c
    got = {r.class_id: r for r in measure.stats_of(edits.current_moments(spark, str(tmp_path / "out")), volumes).collect()}
    for c in (1, 2):
        v = a[cls == c]
        assert got[c].voxels == len(v) and abs(got[c].mean - v.mean()) < 1e-9 and abs(got[c]["std"] - v.std()) < 1e-6
    assert 9 not in got or got[9].voxels == 0
    # A second run over the same folder finds nothing new.
    edits.follow_stats(stream, masks, voxels, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    again = {r.class_id: r.voxels for r in edits.current_moments(spark, str(tmp_path / "out")).collect()}
    assert again[1] == got[1].voxels


def test_edits_start_from_a_mask(spark, grid, labels, tmp_path):
    rng = np.random.default_rng(4)
    _, volumes = grid(a=np.zeros((2, 9, 18)))
    held = rng.integers(0, 4, (2, 9, 18))
    mask, masks = labels(held, fill=2)
    rows = [("m", i, int(rng.integers(2)), int(rng.integers(9)), int(rng.integers(18)), int(rng.integers(4))) for i in range(300)]
    source = tmp_path / "in"
    outside = [("m", 400, 2, 0, 0, 1), ("m", 401, 0, -1, 0, 1), ("m", 402, 0, 0, 18, 1), ("other", 403, 0, 0, 0, 1)]
    for part in (rows[150:], rows[:150], outside):  # the first batch holds the later edits
        spark.createDataFrame(part, EDITS).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(EDITS).option("maxFilesPerTrigger", 1).parquet(str(source))
    edits.follow(stream, str(tmp_path / "out"), str(tmp_path / "check"), mask=mask, masks=masks, volumes=volumes).awaitTermination()
    want, net = held.copy(), {}
    for _, _, z, y, x, c in rows:
        want[z, y, x] = c
    for r in edits.change_log(spark, str(tmp_path / "out")).collect():
        assert r.before_class != r.after_class
        cell = net.setdefault((r.z, r.y, r.x), {})
        cell[r.before_class] = cell.get(r.before_class, 0) - 1
        cell[r.after_class] = cell.get(r.after_class, 0) + 1
    got = held.copy()
    for at, moves in net.items():
        assert moves.get(int(held[at]), 0) in (-1, 0)
        got[at] = next((c for c, n in moves.items() if n == 1), held[at])
    assert np.array_equal(got, want)


def test_slabs_complete_in_any_order(spark, tmp_path):
    source = tmp_path / "in"
    for part in ([("a", 0), ("a", 2), ("b", 40000)], [("a", 1), ("a", 1), ("b", 0)]):
        spark.createDataFrame(part, "volume_id string, slab_no bigint").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("volume_id string, slab_no bigint").option("maxFilesPerTrigger", 1).parquet(str(source))
    slabs.follow(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    volumes = spark.createDataFrame([("a", 3), ("b", 3), ("c", 1)], "volume_id string, slabs int")
    state = slabs.progress(spark, str(tmp_path / "out"), volumes)
    assert sorted((r.volume_id, r.seen, r.complete) for r in state.collect()) == [("a", 3, True), ("b", 2, False), ("c", 0, False)]
    full = spark.createDataFrame([(v, 0, 0, 1.0) for v in "abc"], "volume_id string, v int, u int, value double")
    best = slabs.best_available(full, full.withColumn("value", F.lit(0.0)), state).collect()
    assert {r.volume_id: (r.value, r.is_low_res) for r in best} == {"a": (1.0, False), "b": (0.0, True), "c": (0.0, True)}
