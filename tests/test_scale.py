import random

from pyspark.sql import functions as F

from voxelloom import scale


def test_scan_crosses_blocks(spark):
    rng = random.Random(1)
    rows = [(k, p, rng.randint(0, 9), rng.choice([None, "a", "b"])) for k in "xyz" for p in sorted(rng.sample(range(500), 60))]
    df = spark.createDataFrame(rows, "k string, p bigint, n int, t string")
    got = {(r.k, r.p): (r.s, r.prev) for r in scale.scan(df, ["k"], "p", {"s": F.col("n")}, {"prev": F.col("t")}, block=16).collect()}
    want, total, last = {}, {}, {}
    for k, p, n, t in sorted(rows, key=lambda r: (r[0], r[1])):
        total[k] = total.get(k, 0) + n
        want[k, p] = (total[k], last.get(k))
        last[k] = t
    assert got == want


def test_attach_is_the_same_when_salted(spark):
    cells = spark.range(5000).select((F.col("id") % 7).alias("k"), "id")
    small = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = scale.attach(cells, small, ["k"], ["id"], how).orderBy("id").collect()
        b = scale.attach(cells, small, ["k"], ["id"], how, limit=0).orderBy("id").collect()
        assert a == b and len(a) > 0


def test_salted_join_gathers_nothing_at_the_driver(spark):
    """Spark takes the small side for 32 times smaller than it is."""
    cells = spark.range(5000).select((F.col("id") % 7).alias("k"), "id")
    small = spark.range(5).select(F.col("id").alias("k"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        joined = scale.salted_join(cells, small, ["k"], ["id"], how)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_salted_join_spreads_a_hot_key(spark):
    hot = spark.range(20_000).select(F.lit(1).alias("k"), "id")
    joined = scale.salted_join(hot, spark.createDataFrame([(1, "x")], "k int, v string").hint("merge"), ["k"], ["id"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_000 and max(sizes) < 12_000


def test_ordered_scan_ranks_a_single_group(spark):
    df = spark.range(1000).select(F.lit("s").alias("k"), ((F.col("id") * 7919) % 1009).alias("key"))
    ordered = scale.with_order(df, ["k", "key"])
    ranks = scale.scan(ordered, ["k"], "_pos", {"n": F.lit(1)}, block=scale.ORDER_BLOCK).orderBy("key").collect()
    assert [r.n for r in ranks] == list(range(1, 1001))
