"""Exact quantiles from sketches that are kept with bricks.

A brick's sketch holds every ``step``-th of its ordered values, each standing for the values since the one before. Sketches
of any set of bricks add up: the weights of the points up to a value count its lower ranks, short of at most ``step - 1``
for each brick. So a first pass, over sketches alone, encloses every wanted rank between two values, and a second one, over the bricks
that reach into such a span, counts what is inside. No other pass follows, however many values there are.

NaN has no rank; a brick of nothing else has no sketch. Infinities are values like others. Groups without values have no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import dbl
from ..scale import ORDER_BLOCK, attach, is_small, scan, stage, with_order
from ..sources.bricks import BRICK

POINTS = 64
PUSHED = 64  # spans that become conditions on the scan of bricks


def _numbers(values: str = "vals") -> Column:
    return F.filter(values, lambda v: ~F.isnan(v))  # null is no number either: the condition is null


def brick_sketches(bricks: DataFrame, points: int = POINTS) -> DataFrame:
    """(volume_id, bz, by, bx, vmin, vmax, n, slack, points): a row per brick with numbers; points are (val, w) in order."""
    ordered = bricks.select(*BRICK, F.array_sort(_numbers()).alias("_v")).withColumn("n", F.size("_v").cast("bigint"))
    # Bricks without numbers go last, since a filter may run after what follows it.
    some = F.greatest(F.lit(1).cast("bigint"), "n")
    at = ordered.withColumn("_step", F.ceil(some / F.lit(points))).withColumn(
        "_at", F.transform(F.sequence(F.lit(1).cast("bigint"), F.ceil(some / F.col("_step"))), lambda k: F.least(some, k * F.col("_step"))))
    marks = F.transform("_at", lambda p, i: F.struct(
        F.try_element_at("_v", p.cast("int")).alias("val"), (p - i.cast("bigint") * F.col("_step")).alias("w")))
    return at.where("n > 0").select(
        *BRICK, F.try_element_at("_v", F.lit(1)).alias("vmin"), F.try_element_at("_v", F.lit(-1)).alias("vmax"), "n",
        (F.col("_step") - 1).alias("slack"), marks.alias("points"))


def enclose(sketches: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(keys, total, spans): per group its number of values and, for every rank that ``probs`` need, (rank, lo, hi).

    The value of the rank is above ``lo`` (null: no bound) and at most ``hi``.
    """
    keys = list(keys)
    totals = stage(sketches.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum("slack").alias("slack")))
    places = [F.lit(float(q)) * dbl(F.col("total") - 1) for q in probs]
    ranks = F.array_distinct(F.array(*[f(p).cast("bigint") for p in places for f in (F.floor, F.ceil)]))
    points = sketches.select(*keys, F.explode("points").alias("p")).groupBy(*keys, F.col("p.val").alias("val")).agg(F.sum("p.w").alias("w"))
    below = scan(with_order(points, [*keys, "val"]), keys, "_pos", sums={"upto": F.col("w")}, block=ORDER_BLOCK)
    placed = attach(below, totals.withColumn("rank", ranks), keys, ["val"]).withColumn("rank", F.explode("rank"))
    spans = placed.groupBy(*keys, "total", "rank").agg(
        F.max(F.when(F.col("upto") + F.col("slack") <= F.col("rank"), F.col("val"))).alias("lo"),
        F.min(F.when(F.col("upto") > F.col("rank"), F.col("val"))).alias("hi"))
    return spans.groupBy(*keys, "total").agg(F.array_sort(F.collect_list(F.struct("rank", "lo", "hi"))).alias("spans"))


def _reaching(spans: DataFrame, keys: Sequence[str]) -> Column:
    """A condition on vmin and vmax that Parquet can use, if the spans are few."""
    flat = spans.select(*keys, F.explode("spans").alias("s")).select(*keys, "s.lo", "s.hi")
    if not is_small(flat, PUSHED):
        return F.lit(True)
    out = F.lit(False)
    for r in flat.collect():
        inside = F.col("vmin") <= F.lit(r["hi"])
        if r["lo"] is not None:
            inside = inside & (F.col("vmax") > F.lit(r["lo"]))
        for k in keys:
            inside = inside & F.col(k).eqNullSafe(F.lit(r[k]))
        out = out | inside
    return out


def quantiles(sketches: DataFrame, bricks: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Interpolated quantiles (keys, q, value) of the values in a set of bricks.

    ``sketches`` and ``bricks`` hold the same set, for example one range of brick keys; ``keys`` are columns of both.
    """
    keys = list(keys)
    spans = stage(enclose(sketches, keys, probs))
    each = [*keys, "rank"]
    lists = spans.select(*keys, "spans")
    # Bricks that end below a span are counted by their sketches, unread.
    under = attach(sketches.select(*keys, *[c for c in BRICK if c not in keys], "vmax", "n"), lists, keys, BRICK)
    under = under.select(*keys, "vmax", "n", F.explode("spans").alias("s")).where(F.col("vmax") <= F.col("s.lo")).groupBy(
        *keys, F.col("s.rank").alias("rank")).agg(F.sum("n").alias("n"))
    read = bricks.where(_reaching(spans, keys))
    opened = attach(read, lists, keys, BRICK).select(*keys, "vmin", "vmax", _numbers().alias("_v"), F.explode("spans").alias("s")).where(
        (F.col("s.lo").isNull() | (F.col("vmax") > F.col("s.lo"))) & (F.col("vmin") <= F.col("s.hi")))
    parts = opened.select(
        *keys, F.col("s.rank").alias("rank"),
        F.size(F.filter("_v", lambda v: v <= F.col("s.lo"))).cast("bigint").alias("n"),
        F.filter("_v", lambda v: (F.col("s.lo").isNull() | (v > F.col("s.lo"))) & (v <= F.col("s.hi"))).alias("vals"))
    before = under.unionByName(parts.select(*each, "n")).groupBy(*each).agg(F.sum("n").alias("before"))
    inside = parts.select(*each, F.explode("vals").alias("val")).groupBy(*each, "val").agg(F.count(F.lit(1)).alias("n"))
    run = scan(with_order(inside, [*each, "val"]), each, "_pos", sums={"upto": F.col("n")}, block=ORDER_BLOCK)
    last = attach(run, stage(before), each, ["val"]).withColumn("end", F.col("before") + F.col("upto"))
    hit = stage(last.where((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n"))).select(*each, "val"))
    wanted = spans.select(*keys, "total", F.explode(F.array(*[F.lit(float(q)) for q in probs])).alias("q")).withColumn(
        "_at", F.col("q") * dbl(F.col("total") - 1)).withColumns({
            "_r0": F.floor("_at"), "_r1": F.ceil("_at"), "_t": F.col("_at") - F.floor("_at")})
    low = wanted.join(hit.withColumnsRenamed({"rank": "_r0", "val": "_v0"}), [*keys, "_r0"])
    both = low.join(hit.withColumnsRenamed({"rank": "_r1", "val": "_v1"}), [*keys, "_r1"])
    return both.select(*keys, "q", F.when(F.col("_t") == 0, F.col("_v0")).otherwise(
        F.col("_v0") * (F.lit(1.0) - F.col("_t")) + F.col("_v1") * F.col("_t")).alias("value"))
